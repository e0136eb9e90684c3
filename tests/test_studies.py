"""Fits, draws and fixpoints against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fundamentals, identity, premiums, statistics

D = dt.date.fromisoformat


def newton(x, y, rounds=60):
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return beta


@pytest.fixture(scope="module")
def sample():
    draw = np.random.default_rng(11)
    n = 600
    group, a, b = draw.integers(0, 5, n), draw.normal(3, 2, n), draw.normal(-1, 0.5, n)
    y = draw.random(n) < 1 / (1 + np.exp(-(0.6 * (a - 3) - 1.2 * (b + 1) + 0.3 * group - 1)))
    return group, a, b, y.astype(float)


def frame(spark, sample):
    rows = [(f"g{g}", float(a), float(b), int(y)) for g, a, b, y in zip(*sample)] + [("g0", None, 1.0, 1), ("g1", 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "country string, a double, b double, hit int")


def test_clustered_logit(spark, sample):
    group, a, b, y = sample
    x = np.column_stack([np.ones(len(y)), (a - a.mean()) / a.std(), (b - b.mean()) / b.std()])
    beta = newton(x, y)
    p = 1 / (1 + np.exp(-x @ beta))
    h = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    scores = np.array([(x * (y - p)[:, None])[group == g].sum(0) for g in range(5)])
    error = np.sqrt(np.diag(h @ scores.T @ scores @ h) * 5 / 4 * (len(y) - 1) / (len(y) - 3))
    got = {r.term: r for r in statistics.logit(frame(spark, sample), ["a", "b"], "hit", "country").collect()}
    for i, t in enumerate(["constant", "a", "b"]):
        assert abs(got[t].coef - beta[i]) < 1e-7 and abs(got[t].error / error[i] - 1) < 1e-6
    assert (got["a"].n, got["a"].events, got["a"].clusters) == (600, int(y.sum()), 5)
    assert statistics.logit(frame(spark, sample).limit(20), ["a", "b"], "hit", "country").count() == 0


def test_out_of_group_fits_run_together(spark, sample):
    group, a, b, y = sample
    x = np.column_stack([np.ones(len(y)), a, b])
    want = np.concatenate([x[group == g] @ newton(x[group != g], y[group != g]) for g in range(5)])
    got = statistics.out_of_group(frame(spark, sample), "country", ["a", "b"], "hit").collect()
    assert np.allclose(sorted(r.score for r in got), sorted(want), atol=1e-6)
    report = {r.model: r for r in statistics.out_of_group_report(frame(spark, sample), "country", {"one": ["a"], "two": ["a", "b"]}, "hit").collect()}
    labels = np.concatenate([y[group == g] for g in range(5)])
    flagged = want >= np.quantile(want, 0.9)
    pairs = want[labels == 1][:, None] - want[labels == 0][None, :]
    assert abs(report["two"].precision - labels[flagged].mean()) < 1e-9 and abs(report["two"].auc - ((pairs > 0) + 0.5 * (pairs == 0)).mean()) < 1e-9
    assert report["two"].auc > report["one"].auc and report["one"].n == 600


def test_block_and_cluster_draws(spark):
    rows = spark.createDataFrame([("k", i, i // 4, float(i % 7)) for i in range(22)], "key string, i long, c long, value double")
    draws = statistics.block_draws(rows, ["key"], 50, 6)
    by = {r.rep: sorted(r.i) for r in draws.groupBy("rep").agg(F.collect_list("i").alias("i")).collect()}
    assert len(by) == 50 and all(len(i) == 22 and 0 <= i[0] and i[-1] < 22 for i in by.values())
    whole = statistics.cluster_draws(rows, ["key"], "c", 50)
    for r in whole.join(rows, ["key", "i"]).groupBy("rep", "c").agg(F.count("i").alias("n")).collect():
        assert r.n % (2 if r.c == 5 else 4) == 0
    spread = statistics.bootstrap(rows, draws, lambda: F.percentile("value", F.lit(0.5)), ["key"]).first()
    assert 0 <= spread.low <= 3 <= spread.high <= 6


def regimes(spark, ends):
    df = spark.createDataFrame([(1, D(d), int(d[:4]) + o) for d, o in ends], "cik long, period_end date, fiscal_year int")
    return [(r.month, r.day, r.offset, r.last_end.isoformat()) for r in fundamentals.year_end_regimes(df).orderBy("segment").collect()]


def test_regimes_regroup_until_nothing_changes(spark):
    plain = [("2010-12-31", 0), ("2011-12-30", 0), ("2013-01-02", -1)]  # round New Year
    assert regimes(spark, plain) == [(1, 2, -1, "2013-01-02")]
    kept = [("2010-06-30", 0), ("2011-06-30", 0), ("2012-09-30", 0)]  # the last may be alone
    assert regimes(spark, kept) == [(6, 30, 0, "2011-06-30"), (9, 30, 0, "2012-09-30")]
    lone = [("2010-06-30", 0), ("2011-06-30", 0), ("2012-03-31", 0), ("2012-06-30", 0), ("2013-06-29", 0)]
    assert regimes(spark, lone) == [(6, 29, 0, "2013-06-29")]
    drifting = [(f"20{y:02d}-{m:02d}-28", 0) for y, m in zip(range(1, 13), [1, 3, 5, 7, 9, 11, 1, 3, 5, 7, 9, 9])]
    assert regimes(spark, drifting) == [(9, 28, 0, "2012-09-28")]


def test_transition_reports_end_a_year(spark):
    rows = [("a", 1, "us-gaap", "10-K", "2010-07-01", "2011-06-30", "2011-08-01", 2011, "FY"), ("b", 1, "us-gaap", "10-KT", "2011-07-01", "2011-12-31", "2012-02-01", 2011, "FY"), ("c", 1, "us-gaap", "10-K", "2011-10-01", "2011-12-31", "2012-02-01", 2011, "FY"), ("d", 1, "us-gaap", "10-K", "2012-01-01", "2012-12-31", "2013-02-01", 2012, "Q2"), ("e", 1, "dei", "10-KT", "2012-01-01", "2012-03-31", "2013-02-01", 2012, "FY"), ("f", 1, "us-gaap", "40-F/A", "2012-01-01", "2012-12-31", "2013-02-01", 2013, "FY")]
    df = spark.createDataFrame([(a, c, t, f, D(s), D(e), D(d), y, p) for a, c, t, f, s, e, d, y, p in rows], "accession string, cik long, taxonomy string, form string, period_start date, period_end date, filed date, fiscal_year int, filing_period string")
    assert sorted((r.period_end.isoformat(), r.fiscal_year) for r in fundamentals.fiscal_ends(df).collect()) == [("2011-06-30", 2011), ("2011-12-31", 2011), ("2012-12-31", 2013)]


def test_premium_months_and_rule(spark):
    days = [D("2020-01-01") + dt.timedelta(days=i) for i in range(900)]
    draw = np.random.default_rng(8)
    index = 100 * np.exp(np.cumsum(draw.normal(0, 0.01, len(days))))
    rows = [("k", d, float(50 + i % 31), float(index[i]), float(15 + i % 9), None, 2.4) for i, d in enumerate(days)]
    months = premiums.premium_months(spark.createDataFrame(rows, "key string, date date, price double, index double, implied double, implied3 double, bill double"))
    got = months.orderBy("end").collect()
    ends = [i for i, d in enumerate(days) if i + 1 == len(days) or days[i + 1].month != d.month]
    assert [r.end for r in got] == [days[i] for i in ends[:-1]] and all(r.slope is None and abs(r.rf - 0.002) < 1e-12 for r in got)
    i, j = ends[5], ends[6]
    assert abs(got[5].ret - ((50 + j % 31) / (50 + i % 31) - 1)) < 1e-12
    assert abs(got[5].vrp - (15 + i % 9 - np.std(np.diff(np.log(index[i - 21 : i + 1])), ddof=1) * 252**0.5 * 100)) < 1e-9
    ranked = premiums.with_history(months, "vrp", 6).orderBy("end").collect()
    vrp = [r.vrp for r in got]
    for k, r in enumerate(ranked):
        past = [v for v in vrp[:k] if v is not None]
        ok = len(past) >= 6 and vrp[k] is not None
        assert (r.rank, r.above) == ((sum(v < vrp[k] for v in past) / len(past), vrp[k] > np.median(past)) if ok else (None, None))
    test = premiums.rule_test(premiums.with_history(months, "vrp", 6), least=12, block=6, replicates=50).first()
    on = [r for r in ranked if r.above is not None]
    rule = np.array([r.ret - r.rf if r.above else 0.0 for r in on])
    always = np.array([r.ret - r.rf for r in on])
    ratio = lambda e: e.mean() / e.std(ddof=1) * 12**0.5
    assert test.months == len(on) and abs(test.difference - (ratio(rule) - ratio(always))) < 1e-9 and test.low <= test.high


def test_members_link_by_seat_or_name(spark):
    terms = [("a", "house", "TX", 3, "Ortega Ruiz", "Lena", None, "2021-01-03", "2023-01-03"), ("b", "house", "TX", 3, "Mills", "Gus", None, "2023-01-03", "2025-01-03"), ("c", "house", "WY", 0, "Ortega", "Tom", "Tommy", "2021-01-03", "2025-01-03"), ("d", "senate", "OH", None, "Mills", "Anna", None, "2019-01-03", "2025-01-03"), ("e", "senate", "IA", None, "Mills", "Bert", "Buddy", "2019-01-03", "2025-01-03"), ("d", "senate", "OH", None, "Mills", "Anna", None, "2025-01-03", "2031-01-03")]
    reports = [
        ("1", "house", "TX03", "Somebody Else", "2022-05-01", None), ("2", "house", "tx3 ", "Hon. Gus Mills", "2023-02-01", None), ("3", "house", "WYAL", None, "2022-05-01", None), ("4", "house", None, "Órtega  Ruiz, L. Jr", "2022-05-01", None),
        ("5", "house", "TX03", "Nobody", "2023-02-01", None), ("6", "senate", "OH", "MILLS, ANNA B.", "2025-02-01", None), ("7", "senate", None, "Mills", "2022-05-01", None), ("8", "senate", None, "Buddy Mills III", None, 2022), ("9", "senate", None, "Mills", None, None), ("10", "senate", "", "Mills", "2027-05-01", None), ("11", "house", None, "Tommy Ortega", "2022-05-01", None),
    ]
    t = spark.createDataFrame([(*r[:7], D(r[7]), D(r[8])) for r in terms], "member string, chamber string, state string, district int, last string, first string, nickname string, start date, end date")
    r = spark.createDataFrame([(*x[:4], x[4] and D(x[4]), x[5]) for x in reports], "doc_id string, chamber string, state string, name string, filed date, year int")
    got = {x.doc_id: (x.member, x.method) for x in identity.member_links(r, t).collect()}
    assert got == {"1": ("a", "district"), "2": ("b", "district"), "3": ("c", "district"), "6": ("d", "name"), "8": ("e", "name"), "10": ("d", "name"), "11": ("c", "name")}
