"""Every query with an oracle agrees with it on the smallest tables; the others run."""

import pytest

from tests.oracle import connect, difference
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    sql = catalog.oracle_sql().get(name)
    if sql:
        c = connect(SF)
        assert difference(spark, SF, catalog.queries()[name], sql, c) is None
        assert c.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0, "an empty result compares nothing"
    else:
        assert catalog.queries()[name](spark, SF).count() > 0
