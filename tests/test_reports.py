"""Known answers for event studies on the calendar, calendar-time tests, listings and declared data sets."""

import datetime
import math
import statistics as plain

from pyspark.sql import functions as F

from tidemark.operators import disclosures, identity, metrics, statistics, tables


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_calendar_study(spark):
    bench = [(0, day(i), 100.0 + i) for i in range(0, 20, 2)]  # trades on even days
    own = [(1, day(i), 10.0 + i) for i in range(0, 12, 2) if i != 6]  # no close on day 6, none after day 10
    closes = spark.createDataFrame([*bench, *own, (1, day(14), None)], "security_id long, date date, close double")
    events = spark.createDataFrame([(1, day(0)), (1, day(1)), (1, day(5)), (1, day(19)), (1, None), (9, day(1)), (9, day(2))], "security_id long, event_date date")
    out = {r.h: r for r in disclosures.calendar_study(events, closes, [1, 2, 3]).collect()}
    # events of days 0 and 1 enter on day 2; that of day 5 would enter on day 6, where there is no close; two days on is day 6 again
    assert set(out) == {1, 3}
    assert out[1].n == 2 and math.isclose(out[1].mean, 14 / 12 - 104 / 102) and math.isclose(out[1].mean_return, 14 / 12 - 1) and out[1].t is None
    assert math.isclose(out[3].mean, 18 / 12 - 108 / 102) and out[3].hit_rate == 1
    assert [tuple(r) for r in disclosures.unpriced(events, closes).collect()] == [(9, 2)]
    assert disclosures.calendar_study(events.limit(0), closes, [1]).count() == 0
    assert disclosures.calendar_study(events, closes.limit(0), [1]).count() == 0


def test_calendar_time(spark):
    rows = [(g, day(31 * k), 0.01 * ((k * (g + 2)) % 5 - 1)) for g in (0, 1) for k in range(12) for _ in range(g + 1)] + [(0, day(0), None), (2, day(0), 0.5)]
    df = spark.createDataFrame(rows, "group long, period date, excess double")

    def error(v, lags):
        e = [x - plain.fmean(v) for x in v]
        s = sum(x * x for x in e) + sum(2 * (1 - j / (lags + 1)) * sum(a * b for a, b in zip(e[j:], e, strict=False)) for j in range(1, lags + 1))
        return math.sqrt(max(s, 0)) / len(v)

    series = {g: [0.01 * ((k * (g + 2)) % 5 - 1) for k in range(12)] for g in (0, 1)}
    out = {r.group: r for r in statistics.calendar_time_error(df, lags=2).collect()}
    assert set(out) == {0, 1}  # one period is too few
    for g, v in series.items():
        assert math.isclose(out[g].mean, plain.fmean(v), abs_tol=1e-12) and math.isclose(out[g].error, error(v, 2), rel_tol=1e-9) and out[g].names_per_period == g + 1
        assert math.isclose(out[g].p, 1 - plain.NormalDist().cdf(out[g].t), abs_tol=1e-6)
    pairs = spark.createDataFrame([(0, 1), (0, 7)], "first long, second long")
    (r,) = statistics.calendar_time_difference(df, pairs, lags=1).collect()
    diff = [a - b for a, b in zip(series[0], series[1], strict=True)]
    assert (r.first, r.second, r.n) == (0, 1, 12) and math.isclose(r.mean, plain.fmean(diff), abs_tol=1e-12) and math.isclose(r.error, error(diff, 1), rel_tol=1e-9)


def test_interval_after_controls(spark):
    rows = [("a", day(31 * (k % 8)), float(k % 8), 1) for k in range(80)] + [("a", day(0), 99.0, None), ("a", day(0), None, 1), ("b", day(0), 1.0, 1)]
    out = statistics.after_controls_interval(spark.createDataFrame(rows, "group string, period date, excess double, momentum int"), ["momentum"], replicates=400).collect()
    assert [r.group for r in out] == ["a"] and out[0].n == 80 and out[0].mean == 3.5
    spread = plain.pstdev(range(8)) / math.sqrt(8)  # whole periods are drawn, so eight values count
    assert math.isclose(out[0].error, spread, rel_tol=0.15) and out[0].low < 3.5 < out[0].high


def test_runs_past_the_holdout(spark):
    log = spark.createDataFrame([("h", "a", "run", day(9)), ("h", "b", "run", day(10)), ("h", "c", "holdout", day(30)), ("h", "d", "validation", None)], "hypothesis string, variant string, kind string, data_end date")
    assert [(r.variant, r.days_past) for r in statistics.past_holdout(log, F.lit(day(10))).collect()] == [("b", 1)]


def test_listing_with_history(spark):
    s = spark.createDataFrame([(1, "ABC", "Alpha Works", "CS", True), (2, "XYZ", "Grand alphabet", "ETF", True), (3, "AAA", None, "CS", False), (4, "ALP", "Other", "CS", True)], "security_id long, ticker string, name string, security_type string, active boolean")
    ids = lambda df: [r.security_id for r in df.collect()]
    assert ids(identity.list_securities(s, "ALPHA")) == [1, 2] and ids(identity.list_securities(s, "al", kind="cs", active=True)) == [1, 4]
    assert ids(identity.list_securities(s)) == [3, 1, 4, 2] and ids(identity.list_securities(s, active=False)) == [3] and ids(identity.list_securities(s, limit=1)) == [3]
    history = spark.createDataFrame([(1, "NEW", day(5), None), (1, "OLD", day(1), day(4)), (9, "NO", day(1), None)], "security_id long, symbol string, first_seen date, last_seen date")
    out = {r.security_id: [x.symbol for x in r.symbols] for r in identity.with_history(s, history).collect()}
    assert out == {1: ["OLD", "NEW"], 2: [], 3: [], 4: []}


def test_latest_balance(spark):
    items = spark.createDataFrame([(1, day(0), day(10), 5.0), (1, day(0), day(20), 6.0), (1, day(30), day(90), 7.0), (2, day(-500), day(-400), 1.0), (3, day(0), day(5), None)], "cik long, period_end date, filed date, value double")
    out = metrics.latest_balance(items, F.lit(day(40)), ["cik"]).collect()
    assert [(r.cik, r.period_end, r.value) for r in out] == [(1, day(0), 6.0)]


def test_declared_rows(spark):
    rows = spark.createDataFrame([("p", "s", "k", day(1), 1), ("p", "s", "k", day(2), 2), ("p", "s", "j", day(1), 3), ("p", "r", "k", day(1), 4), ("p", "r", "k", day(3), 5), ("p", "r", "j", day(3), 6), ("p", "l", "k", day(1), 7), ("p", "l", "k", day(1), 7), ("p", "x", "k", day(1), 8)], "provider string, dataset string, item string, day date, id long")
    sets = spark.createDataFrame([("p", "s", "snapshot"), ("p", "r", "reference"), ("p", "l", "log")], "provider string, dataset string, kind string")
    assert sorted(r.id for r in tables.declared_rows(rows, sets, ["item"], "day", ["id"]).collect()) == [2, 3, 5, 6, 7, 7]
    assert tables.declared_rows(rows.limit(0), sets, ["item"], "day", ["id"]).count() == 0
