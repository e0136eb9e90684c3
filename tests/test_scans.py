"""Ranks, counts and filters that run in blocks, against plain loops; small blocks stand for long series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import fundamentals, indicators

SCHEMA = "key long, date date, value double"


def rows(sizes, gaps=0.1, seed=1):
    draw = random.Random(seed)
    return [(k, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if draw.random() < gaps else float(draw.randint(0, 30)) + draw.choice([0, 0.5])) for k, n in enumerate(sizes) for i in range(n)]


def by_key(data):
    out = {}
    for k, d, v in data:
        out.setdefault(k, []).append((d, v))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_expanding_counts(spark, strict):
    data = rows([1, 2, 7, 8, 9, 70, 150])
    want = {}
    for k, series in by_key(data).items():
        known = [(d, v) for d, v in series if v is not None]
        for i, (d, v) in enumerate(known):
            want[k, d] = (i + 1, sum(x < v or (x == v and not strict) for _, x in known[: i + 1]))
    got = ranks.expanding_counts(spark.createDataFrame(data, SCHEMA), "key", "date", "value", strict=strict, block=8)
    assert {(r.key, r.date): (r.seen, r.below) for r in got.collect()} == want
    assert ranks.expanding_counts(spark.createDataFrame([], SCHEMA), "key", "date", "value").count() == 0


def plain_ema(x, n):
    out, state = [], None
    for i, v in enumerate(x):
        window = x[max(0, i - n + 1) : i + 1]
        if state is None:
            state = sum(window) / n if len(window) == n and None not in window else None
        elif v is not None:
            state += (v - state) * 2 / (n + 1)
        out.append(None if v is None else state)
    return out


def plain_rsi(x, n):
    out, run, mean = [None] * len(x), [], None
    for i in range(1, len(x)):
        if x[i] is None or x[i - 1] is None:
            run, mean = [], None
            continue
        step = x[i] - x[i - 1]
        sides = (max(step, 0.0), max(-step, 0.0))
        if mean is None:
            run.append(sides)
            if len(run) == n:
                mean = tuple(sum(s) / n for s in zip(*run))
        else:
            mean = tuple((m * (n - 1) + s) / n for m, s in zip(mean, sides))
        if mean is not None:
            out[i] = 100.0 if mean[1] == 0 else 100 - 100 / (1 + mean[0] / mean[1])
    return out


def close(a, b):
    return (a is None or a != a) and b is None or a is not None and b is not None and abs(a - b) < 1e-9 * max(1, abs(b))


@pytest.mark.parametrize("gaps", [0.0, 0.02, 0.3])
def test_recursive_filters_over_many_blocks(spark, gaps):
    data = rows([1, 11, 12, 40, 33, 1300], gaps)
    got = {(r.key, r.date): r for r in indicators.recursive(spark.createDataFrame(data, SCHEMA), block=32).collect()}
    assert len(got) == len(data)
    for k, series in by_key(data).items():
        x = [v for _, v in series]
        fast, slow, rsi = plain_ema(x, 12), plain_ema(x, 26), plain_rsi(x, 14)
        for i, (d, _) in enumerate(series):
            r = got[k, d]
            macd = None if fast[i] is None or slow[i] is None else fast[i] - slow[i]
            assert close(r.ema, fast[i]) and close(r.macd, macd) and close(r.rsi, rsi[i]), (k, i)


def test_filter_gap_over_many_blocks(spark):
    df = spark.createDataFrame(rows([1, 2, 3, 20, 130], 0.1), SCHEMA)
    whole = {(r.key, r.date): r.gap for r in indicators.one_sided_gap(df, 100.0).collect()}
    cut = {(r.key, r.date): r.gap for r in indicators.one_sided_gap(df, 100.0, block=4).collect()}
    assert whole.keys() == cut.keys() and all(close(cut[k], whole[k]) for k in whole) and any(whole.values())


def test_global_ranks_have_no_single_task(spark):
    data = [(i, float(i * 7 % 13), None if i % 11 == 0 else float(i % 5)) for i in range(200)]
    got = fundamentals.magic_rank(spark.createDataFrame(data, "security_id long, earnings_yield double, roic double"))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    first = sorted(data, key=lambda r: (-r[1], r[0]))
    second = sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert {r.security_id: r["rank"] for r in got.collect()} == {r[0]: first.index(r) + second.index(r) for r in data}
    assert got.select(F.sum("rank")).first()[0] == 200 * 199
