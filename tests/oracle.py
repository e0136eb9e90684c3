"""Compares a query with its oracle: row count, column names and values in any order."""

import math

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, sf_dir, query, sql, c=None):
    """None when both agree, else a short account."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = (c or connect(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return None
    left, right = set(got), set(want)
    a, b = [x for x in got if x not in right][:3], [x for x in want if x not in left][:3]
    return f"{len(got)} rows, oracle {len(want)}; columns {sorted(names)}; only here {a}; only there {b}"
