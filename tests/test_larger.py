"""What only larger tables showed: small cases of the same kind."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import portfolio, statistics, tables, text

D = lambda s: dt.date.fromisoformat(s)


def test_code_ranges_that_gain_a_digit(spark):
    one = lambda c: spark.range(1).select(tables.expand_codes(F.lit(c))).first()[0]
    assert one("999-1002") == ["999", "1000", "1001", "1002"] and one("098-101") == ["098", "099", "100", "101"]


def test_split_factors_are_exact(spark):
    t = spark.createDataFrame([(1, 1, D("2024-01-02"), "buy", "X", 3.0, 30.0), (2, 1, D("2024-02-01"), "buy", "X", 1.0, 30.0), (3, 1, D("2024-12-31"), "sell", "X", 0.000003, 1.0)], "id long, account_id long, trade_date date, action string, symbol string, quantity double, amount double")
    splits = spark.createDataFrame([("X", D("2024-01-10") + dt.timedelta(days=i), r) for i, r in enumerate([0.5, 2.0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 2.0, 0.5])] + [("X", D("2024-03-01") + dt.timedelta(days=i), 0.5) for i in range(11)], "symbol string, ex_date date, ratio double")
    factors = {r.id: r.factor for r in portfolio.adjusted_ledger(t, splits).collect()}
    assert factors == {1: 2.0**-18, 2: 2.0**-11, 3: 1.0}
    got = {(r.buy and r.buy.id, r.sell and r.sell.id): r.quantity for r in portfolio.lots(t, splits, places=6).collect()}
    assert got == {(1, 3): 0.000003, (1, None): 0.000008, (2, None): 0.000488}  # 3 / 2**18 and 1 / 2**11 in millionths
    one = portfolio.lots(t.where("id = 2"), splits.withColumn("ratio", F.when(F.col("ex_date") < "2024-03-10", 0.5).otherwise(0.25)), places=6).first()
    assert one.quantity == 0.000122  # 9 halves and 2 quarters: 2**-13


def test_block_bootstrap_equals_joined_draws(spark):
    rows = spark.createDataFrame([(k, i, float(i * i % 13)) for k, n in (("a", 40), ("b", 17), ("c", 4)) for i in range(n)], "key string, i long, value double")
    middle = lambda: F.percentile("value", F.lit(0.5)) + F.max("value")
    got = statistics.block_bootstrap(rows, middle, ["key"], 60, 5)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # joined draws were broadcast, which failed on more keys
    joined = statistics.bootstrap(rows, statistics.block_draws(rows, ["key"], 60, 5), middle, ["key"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect())) and got.count() == 2
    assert "broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_means_store_no_draws(spark):
    values = [float(i * 7 % 11) for i in range(33)]
    series = spark.createDataFrame([("k", D("2024-01-01") + dt.timedelta(days=i), v) for i, v in enumerate(values)], "key string, date date, value double")
    out = statistics.bootstrap_means(series, 40, 10)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    starts = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("rep"), F.lit("k").alias("key")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("rep", F.pmod(F.xxhash64(F.lit(7), "key", "rep", "b"), F.lit(24).cast("long")).alias("s")).collect()
    means = [np.mean([np.mean(values[r.s : r.s + 10]) for r in starts if r.rep == rep]) for rep in range(1, 41)]
    got = out.first()
    assert got.replicates == 40 and abs(got.low - np.quantile(means, 0.025)) < 1e-9 and abs(got.high - np.quantile(means, 0.975)) < 1e-9


def test_tracking_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(portfolio, "BLOCK", 2)
    monkeypatch.setattr(portfolio, "SPAN", 7)
    draw = np.random.default_rng(3)
    rets = {s: {d: 0.5 if s == 6 else float(x) for d, x in enumerate(draw.normal(0.001, 0.01, 40)) if draw.random() < 0.7} for s in range(7)}
    rows = [(s, D("2024-01-01") + dt.timedelta(days=d), x) for s, xs in rets.items() for d, x in xs.items()] + [(0, D("2025-01-01"), None)]
    funds = spark.createDataFrame([(s,) for s in (1, 2, 5, 6)], "security_id long")
    out = portfolio.tracking(spark.createDataFrame(rows, "security_id long, date date, ret double"), funds, least=15, most=9.0)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for a day of a pair
    got = {(r.held, r.fund): (r.n, r.corr, r.beta, r.error) for r in out.collect()}
    want = {}
    for h in rets:
        for f in (1, 2, 5, 6):
            days = sorted(set(rets[h]) & set(rets[f]))
            if h != f and len(days) >= 15:
                x, y = (np.array([rets[s][d] for d in days]) for s in (h, f))
                c = np.cov(x, y)
                want[h, f] = (len(days), None if 6 in (h, f) else np.corrcoef(x, y)[0, 1], None if f == 6 else c[0, 1] / c[1, 1], np.std(x - y, ddof=1) * 252**0.5)
    assert got.keys() == want.keys() and len(got) > 15
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for k in want for a, b in zip(got[k], want[k], strict=True))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("Exchange hashpartitioning")


def trades(spark, rows):
    kind = "id long, account_id long, trade_date date, action string, symbol string, quantity double, price double"
    return spark.createDataFrame([(i, a, D(d), w, s, q, p) for i, (a, d, w, s, q, p) in enumerate(rows)], kind).withColumn("fees", F.lit(0.0))


def test_lots_take_one_shuffle(spark):
    t = trades(spark, [(1, "2024-01-02", "buy", "X", 10.0, 5.0), (1, "2024-01-03", "dividend", "X", 4.0, 1.0), (1, "2024-01-04", "buy", "X", 3.0, 6.0), (1, "2024-02-01", "sell", "X", 12.0, 4.0), (1, "2024-02-02", "sell", "X", 2.0, 4.0), (1, "2024-02-03", "sell", "Y", 1.0, 4.0)])
    gains = portfolio.realized_gains(portfolio.fifo_lots(t))
    assert exchanges(gains) == 1
    got = sorted(((r.buy_id, r.sell_id, r.quantity) for r in gains.collect()), key=repr)
    assert got == [(0, 3, 10.0), (2, 3, 2.0), (2, 4, 1.0), (None, 4, 1.0), (None, 5, 1.0)]  # other records cut no lot


def test_wash_sales_meet_days_of_the_symbol(spark):
    t = trades(spark, [(1, "2024-01-02", "buy", "X", 1.0, 9.0), (1, "2024-01-20", "sell", "X", 1.0, 5.0), (2, "2024-02-19", "reinvest", "Y", 1.0, 5.0), (1, "2024-01-02", "buy", "Y", 1.0, 9.0), (1, "2024-01-20", "sell", "Y", 1.0, 5.0), (1, "2024-01-02", "buy", "Z", 1.0, 9.0), (1, "2024-01-20", "sell", "Z", 1.0, 5.0), (2, "2024-02-20", "buy", "Z", 1.0, 5.0), (1, "2024-03-01", "sell", "Z", 1.0, 5.0)])
    out = portfolio.wash_sales(portfolio.realized_gains(portfolio.fifo_lots(t.repartition("symbol"))), t)
    assert {(r.symbol, r.sell_id): r.wash for r in out.collect()} == {("X", 1): False, ("Y", 4): True, ("Z", 6): False, ("Z", 8): False}
    assert exchanges(out) <= 2  # the trades, and a symbol's days of purchase


def test_ledger_takes_one_shuffle(spark):
    t = trades(spark, [(1, "2024-01-02", "buy", "X", 10.0, 5.0), (1, "2024-02-01", "split", "X", 10.0, None), (1, "2024-03-01", "sell", "X", 15.0, 4.0), (1, "2024-03-02", "split", "X", 5.0, None), (1, "2024-03-04", "transfer_out", "X", 12.0, None), (2, "2024-01-02", "buy", "X", 1.0, 5.0), (1, "2024-01-02", "sell", "Y", 2.0, 4.0), (1, "2024-01-05", "buy", "Y", 2.0, 4.0)]).withColumn("amount", F.lit(None).cast("double"))
    splits = spark.createDataFrame([("X", D("2024-02-01"), 7.0), ("Y", D("2024-02-01"), 3.0)], "symbol string, ex_date date, ratio double")
    parts = portfolio.lots(t, splits)
    assert exchanges(parts) <= 3  # the rows, once for the join with the splits at most, and the splits
    got = sorted(((r.symbol, r.buy and r.buy.id, r.sell and r.sell.id, round(r.quantity, 6), round(r.shares, 6)) for r in parts.collect()), key=repr)
    # X: 10 shares are 20 after the first record, 5 left are 10 after the second, 2 of 12 were never held; of account 2 no split is recorded
    assert got == [("X", 0, 2, 30.0, 15.0), ("X", 0, 4, 10.0, 10.0), ("X", 5, None, 1.0, 1.0), ("X", None, 4, 2.0, 2.0), ("Y", 7, None, 6.0, 6.0), ("Y", None, 6, 6.0, 2.0)]


def test_search_reads_the_words_asked_for_once(spark):
    docs = spark.createDataFrame([(1, "Tariffs and tariff talk"), (2, "no tariff here, no war"), (3, "war tariffs, tariff war"), (4, None)], "id long, text string")
    found = text.search(text.inverted_index(docs, "id"), docs, "id", 'tariff -war OR "tariff war"')
    keys = found.select("id")
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.index("Aggregate [term") < plan.index(" IN (ta,wa)")  # the filter lies under the index's grouping
    assert sorted(r.id for r in keys.collect()) == [1, 3]
    scores = {r.id: r.score for r in found.collect()}
    part = lambda n, df, tf: np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)
    assert scores == {1: round(part(4, 3, 2), 6), 3: round(part(4, 3, 2) + part(4, 2, 2), 6)}


def test_running_sums_and_report_in_parts(spark):
    rows = [(g, float(i), i % 3, 1) for g, n in (("a", 50), ("b", 3)) for i in range(n)]
    out = ranks.running_sums(spark.createDataFrame(rows, "g string, v double, x long, c long").repartition(7), ["g"], "v", ["x", "c"])
    got = {(r.g, r.v): (r.before_x, r.all_x, r.before_c, r.all_c) for r in out.collect()}
    assert got == {(g, float(i)): (sum(k % 3 for k in range(i)), sum(k % 3 for k in range(n)), i, n) for g, n in (("a", 50), ("b", 3)) for i in range(n)}
    draw = np.random.default_rng(5)
    people = [(i % 3, float(draw.normal()), int(draw.random() < 0.3)) for i in range(300)]
    report = statistics.out_of_group_report(spark.createDataFrame(people, "g long, a double, hit int"), "g", {"one": ["a"]}, "hit")
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan and "percentile(" not in plan  # neither takes a model's scores into one task
    assert report.first().n == 300
