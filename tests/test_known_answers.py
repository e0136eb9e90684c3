"""Hand-made cases with known answers."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.operators import backtests, disclosures, fundamentals, identity, indicators, metrics, portfolio, prices, rules, series, statistics, tables, text
from tidemark.plans import research
from tidemark.streaming import streams

D = lambda s: dt.date.fromisoformat(s)


def as_series(spark, values):
    return spark.createDataFrame([(1, D("2024-01-01") + dt.timedelta(days=i), v) for i, v in enumerate(values)], "key long, date date, value double")


def values(df, column):
    return [None if r[0] is None or r[0] != r[0] else round(r[0], 6) for r in df.orderBy("date").select(column).collect()]


def test_windows_are_full_or_null(spark):
    assert values(as_series(spark, [1.0, 2.0, 3.0, 4.0]), indicators.sma(2)) == [None, 1.5, 2.5, 3.5]
    assert values(as_series(spark, [1.0, None, 3.0, 4.0]), indicators.sma(2)) == [None, None, None, 3.5]
    assert values(as_series(spark, [100.0, 110.0, 99.0]), indicators.ret()) == [None, 0.1, -0.1]
    assert values(as_series(spark, [1.0, 4.0, 9.0]), indicators.diff(2)) == [None, None, 8.0]
    assert values(as_series(spark, [10.0, 12.0, 9.0]), indicators.drawdown(3)) == [None, None, -0.25]


def test_recursive_indicators(spark):
    assert values(indicators.recursive(as_series(spark, [1.0, 2.0, 3.0, 4.0]), ema_n=3), "ema") == [None, None, 2.0, 3.0]
    up = values(indicators.recursive(as_series(spark, [float(i) for i in range(20)])), "rsi")
    down = values(indicators.recursive(as_series(spark, [float(-i) for i in range(20)])), "rsi")
    assert up[-1] == 100 and down[-1] == 0 and up[13] is None


def test_yoy_goes_by_days(spark):
    rows = [(1, D(d), v) for d, v in [("2025-01-02", 100.0), ("2025-07-01", 105.0), ("2026-01-02", 110.0), ("2026-01-05", 111.0)]]
    assert values(indicators.yoy(spark.createDataFrame(rows, "key long, date date, value double")), "yoy") == [None, None, 0.1, 0.11]


def test_adjustment(spark):
    day = lambda i: D("2024-01-01") + dt.timedelta(days=i)
    bars = lambda c: spark.createDataFrame([(1, day(i), x, 10) for i, x in enumerate(c)], "security_id long, date date, close double, volume long")
    acts = lambda rows: spark.createDataFrame([(1, day(i), k, v) for i, k, v in rows], "security_id long, ex_date date, action string, value double")
    assert values(prices.adjust(bars([100.0, 50.0]), acts([(1, "split", 2.0)])), "price_factor") == [0.5, 1.0]
    assert values(prices.adjust(bars([100.0, 99.0, 98.0]), acts([(2, "dividend", 1.0), (9, "split", 2.0)])), "price_factor") == [round(1 - 1 / 99, 6)] * 2 + [1.0]
    jumps = prices.cut_jumps(bars([0.5, 0.52, 0.49, 0.51, 0.5, 0.48, 0.5] + [30.0, 31.0, 29.5] * 4), acts([]))
    assert jumps.count() == 12


def test_vintages(spark):
    v = spark.createDataFrame([("g", D("2022-01-01"), D("2022-02-10"), 7.0), ("g", D("2022-01-01"), D("2022-03-12"), 7.5), ("g", D("2022-02-01"), D("2022-03-12"), 8.25), ("g", D("2022-02-01"), D("2022-04-01"), None)], "series_id string, date date, realtime_start date, value double")
    days = spark.createDataFrame([(D(d),) for d in ("2022-02-09", "2022-02-10", "2022-03-11", "2022-03-12", "2022-04-02")], "date date")
    known = {r.day.isoformat(): r.value for r in series.as_known(v, days).collect()}
    assert known == {"2022-02-10": 7.0, "2022-03-11": 7.0, "2022-03-12": 8.25, "2022-04-02": 7.5}


def test_filter_gap_is_the_last_point_of_the_whole_fit(spark):
    x = [1.0, 2.5, 2.0, 4.0, 3.5, 5.5, 5.0, 8.0, 6.5, 9.0, 9.5, 12.0]
    out = values(indicators.one_sided_gap(as_series(spark, x), 10.0, least=5), "gap")
    for n in range(5, len(x) + 1):
        d = np.diff(np.eye(n), 2, axis=0)
        trend = np.linalg.solve(np.eye(n) + 10.0 * d.T @ d, np.array(x[:n]))
        assert abs(out[n - 1] - (x[n - 1] - trend[-1])) < 1e-5
    assert out[:4] == [None] * 4


SOURCES = series.STANDARD.with_source("px", lambda t: t).with_source("fred", lambda t: t)


def test_specs():
    found = series.parsed("px:A / px:B-C | sma:5|z", SOURCES)
    assert (found.terms, found.operator, found.transforms) == ((("px", "A"), ("px", "B-C")), "/", (("sma", 5), ("z", 252)))
    assert series.parsed("fred:X-Y|macd", SOURCES).transforms == (("macd", 0),)
    for bad in ("zz:A", "px:", "px:A|nope", "px:A|ret:x", "px:A|sma", "px:A|macd:3", "px:A/px:B/px:C"):
        with pytest.raises(ValueError):
            series.parsed(bad, SOURCES)
    with pytest.raises(ValueError):
        series.parsed("px:A", series.STANDARD)  # registering made another registry
    with pytest.raises(TypeError):
        SOURCES.sources["px"] = None


def test_rule_trees(spark):
    rule = rules.parsed("px:A > px:A|sma:2 and fred:X>=0 or px:A / px:B < -1.5", SOURCES)
    assert [[(c.left.text, c.sign, c.right if isinstance(c.right, float) else c.right.text) for c in g] for g in rule.groups] == [[("px:A", ">", "px:A|sma:2"), ("fred:X", ">=", 0.0)], [("px:A / px:B", "<", -1.5)]]
    assert [s.text for s in rule.specs()] == ["px:A", "px:A|sma:2", "fred:X", "px:A / px:B"]
    for bad in ("px:A|sma:5", "px:A > 1 > 2", "px:A >", "zz:A > 1"):
        with pytest.raises(ValueError):
            rules.parsed(bad, SOURCES)


def test_rules_over_specs_run_from_text(spark):
    days = [D("2026-03-02") + dt.timedelta(days=i) for i in range(6)]
    px = [("A", d, v) for d, v in zip(days, [50.0, 60.0, 54.0, 72.0, 72.0, 90.0])] + [("B", d, 30.0) for d in days]
    tables = {"px": spark.createDataFrame(px, "ident string, known_on date, value double"), "fred": spark.createDataFrame([("X", days[2], 1.0)], "ident string, known_on date, value double")}
    grid = spark.createDataFrame([(d,) for d in days], "date date")
    book = {"up": ("A", "px:A > 55"), "late": ("A", "px:A > 55 and fred:X > 0"), "ratio": ("A", "px:A / px:B > 2 or px:A|ret:1 > 0.3")}
    out = rules.run(book, tables, grid, SOURCES, cost_bps=0)
    runs = {name: out.where(F.col("security_id") == name).orderBy("date").collect() for name in book}
    # the signal of a day is held over the next: up has F T F T T, so it earns -10%, 0% and +25%
    assert [round(r.ret, 9) for r in runs["up"]] == [0.0, -0.1, 0.0, 0.0, 0.25] and round(runs["up"][-1].equity, 9) == 1.125
    assert {r.start for r in runs["up"]} == {days[0]} and {r.start for r in runs["late"]} == {days[2]}
    assert [r.position for r in runs["ratio"]] == [0.0, 0.0, 1.0, 1.0] and {r.start for r in runs["ratio"]} == {days[1]}
    flips = rules.run({"up": book["up"]}, tables, grid, SOURCES, cost_bps=100, short=True, start="2026-03-03").orderBy("date").collect()
    assert [round(r.ret, 9) for r in flips] == [-0.11, round(-1 / 3 - 0.02, 9), -0.02, 0.25]


def test_the_dead_stay_in_outcomes(spark):
    days = [D("2024-01-01") + dt.timedelta(days=i) for i in range(12)]
    grid = spark.createDataFrame([(d,) for d in days], "date date")
    rows = [(1, days[0], 9.0), (1, days[1], 10.0), (1, days[2], 12.0), (1, days[3], 6.0)] + [(2, d, 5.0 + i) for i, d in enumerate(days)] + [(3, days[0], 4.0), (3, days[2], 4.0)]
    out = {(r.security_id, r.date): r for r in fundamentals.forward_returns(spark.createDataFrame(rows, "security_id long, date date, close double"), grid, [1, 5]).collect()}
    assert (out[1, days[0]].ret_5, out[1, days[0]].max_drawdown) == (6 / 10 - 1, 6 / 12 - 1)
    assert out[1, days[3]].ret_5 is None and out[3, days[0]].ret_5 is None  # no close on the day of the purchase
    assert out[2, days[5]].ret_5 == 16 / 11 - 1 and out[2, days[6]].ret_5 is None and out[2, days[6]].ret_1 == 13 / 12 - 1


def test_sliding_falls_equal_a_plain_loop(spark):
    draw = np.random.default_rng(4)
    days = [D("2024-01-01") + dt.timedelta(days=i) for i in range(60)]
    x = [float(v) if draw.random() < 0.8 else None for v in draw.integers(50, 90, 60)]
    rows = [(1, d, v) for d, v in zip(days, x) if v is not None]
    got = {r.date: r.max_drawdown for r in fundamentals.forward_returns(spark.createDataFrame(rows, "security_id long, date date, close double"), spark.createDataFrame([(d,) for d in days], "date date"), [7]).collect()}
    for i, d in enumerate(days[:-1]):
        if x[i] is not None:
            want = None
            if x[i + 1] is not None and i + 8 < 60:
                seen = [v for v in x[i + 1 : i + 9] if v is not None]
                want = min(v / max(seen[: j + 1]) - 1 for j, v in enumerate(seen))
            assert (got[d] is None) == (want is None) and (want is None or abs(got[d] - want) < 1e-12)


def test_a_screen_buys_only_what_trades_on_the_day(spark):
    days = [D("2024-01-01") + dt.timedelta(days=i) for i in range(6)]
    rows = [(0, d, 10.0) for d in days] + [(1, d, 30.0 + i) for i, d in enumerate(days[:3])] + [(2, days[0], 7.0)]
    closes = spark.createDataFrame(rows, "security_id long, date date, close double")
    picks = spark.createDataFrame([(days[0], 1, True), (days[0], 2, True), (days[0], 0, False)], "as_of date, security_id long, picked boolean")
    (r,) = metrics.screen_backtest(picks, closes, spark.createDataFrame([(d,) for d in days], "date date"), [4]).collect()
    assert (r.picks, r["mean"], r.bench) == (1, 32 / 31 - 1, 0.0)


def test_quantiles_of_any_number_of_trials(spark):
    trials = [1, 2, 3, 10, 1000, 1001, 10**6, 10**12]
    df = spark.createDataFrame([(n,) for n in [0, *trials]], "n long")
    got = {r.n: r.t for r in df.select("n", statistics.bonferroni_t(F.col("n")).alias("t")).collect()}
    assert got[0] is None and all(abs(got[n] / -NormalDist().inv_cdf(0.025 / n) - 1) < 1e-8 for n in trials)


def test_lags_follow_the_longest_series(spark):
    draw = np.random.default_rng(6)
    x = np.cumsum(draw.normal(size=30_000)) * 0.01
    n, e = len(x), x - x.mean()
    lags = int(4 * (n / 100) ** (2 / 9))
    want = (e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) ** 0.5 / n
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "key long, date long, value double")
    assert lags > 12 and abs(statistics.newey_west(rows).first().error / want - 1) < 1e-9


def test_rules(spark):
    assert backtests.rule_clauses("a>1 and b <= c or d < 2") == [[("a", ">", "1"), ("b", "<=", "c")], [("d", "<", "2")]]
    df = spark.createDataFrame([(2.0, 1.0), (None, 9.0), (None, 1.0), (0.0, 9.0)], "a double, b double")
    assert [r[0] for r in df.select(backtests.rule_column("a > 1 and b < 5 or b > 8")).collect()] == [True, True, None, True]
    with pytest.raises(ValueError):
        backtests.rule_clauses("a >")


def test_ruin_ends_a_run(spark):
    rows = [(1, D("2024-01-01") + dt.timedelta(days=i), x) for i, x in enumerate([10.0, 5.0, -1.0])]
    out = backtests.run(spark.createDataFrame(rows, "security_id long, date date, close double"), F.lit(True))
    stats = backtests.statistics(out).first()
    assert stats.cagr == -1.0 and stats.total < -1


def test_lots_through_splits_and_short_sales(spark):
    rows = [(1, 1, D("2023-01-02"), "sell", "S", 4.0, 40.0), (2, 1, D("2023-02-01"), "buy", "S", 10.0, 100.0), (3, 1, D("2023-06-01"), "sell", "S", 5.0, 50.0), (4, 1, D("2023-07-01"), "buy", "S", 3.0, 60.0), (5, 1, D("2023-08-01"), "sell", "S", 20.0, 200.0)]
    t = spark.createDataFrame(rows, "id long, account_id long, trade_date date, action string, symbol string, quantity double, amount double")
    splits = spark.createDataFrame([("S", D("2023-05-01"), 2.0)], "symbol string, ex_date date, ratio double")
    got = {(r.buy and r.buy.id, r.sell and r.sell.id): r.quantity for r in portfolio.lots(t, splits).collect()}
    assert got == {(None, 1): 8.0, (2, 3): 5.0, (2, 5): 15.0, (4, 5): 3.0, (None, 5): 2.0}


LEDGER = "id long, account_id long, trade_date date, action string, symbol string, quantity double, price double, amount double, fees double"


def ledger(spark, rows, splits=()):
    t = spark.createDataFrame([(i, 1, D(day), action, symbol, q, price, amount, fees) for i, (day, action, symbol, q, price, amount, fees) in enumerate(rows, 1)], LEDGER)
    return t, portfolio.lots(t, spark.createDataFrame([(s, D(d), r) for s, d, r in splits], "symbol string, ex_date date, ratio double"))


def test_ledger_costs_proceeds_and_transfers(spark):
    rows = [("2024-02-01", "buy", "a", 8.0, 50.0, None, 4.0), ("2024-03-01", "reinvest", "A", 2.0, None, -110.0, 0.0), ("2024-04-01", "transfer_in", "A", 5.0, None, None, 0.0), ("2024-05-02", "transfer_out", "A", 6.0, 60.0, None, 0.0), ("2025-03-02", "sell", "A", -5.0, 70.0, None, 10.0), ("2025-04-02", "sell", "A", 9.0, None, 900.0, 0.0), ("2025-05-01", "buy", "", 3.0, 1.0, None, 0.0)]
    t, parts = ledger(spark, rows)
    got = {(r.buy and r.buy.id, r.sell and r.sell.id): (r.shares, r.cost, r.proceeds) for r in parts.collect()}
    assert got == {(1, 4): (6.0, 303.0, None), (1, 5): (2.0, 101.0, 136.0), (2, 5): (2.0, 110.0, 136.0), (3, 5): (1.0, None, 68.0), (3, 6): (4.0, None, 400.0), (None, 6): (5.0, None, 500.0)}
    gains = {(r.buy_id, r.sell_id): (r.gain, r.term) for r in portfolio.lot_gains(parts).collect()}
    assert gains == {(1, 5): (35.0, "long"), (2, 5): (26.0, "long"), (3, 5): (None, "short"), (3, 6): (None, "long"), (None, 6): (None, None)}
    assert sorted(tuple(r) for r in portfolio.ledger_warnings(t, parts).collect()) == [(3, "no cost basis", 5.0), (6, "exceeds history", 5.0)]


def test_a_brokers_split_depends_on_the_shares_held(spark):
    market = [("A", "2024-06-01", 3.0), ("B", "2024-06-01", 3.0)]
    rows = [("2024-01-02", "buy", "A", 10.0, 6.0, None, 0.0), ("2024-02-01", "sell", "A", 14.0, 6.0, None, 0.0), ("2024-03-01", "split", "A", 5.0, None, None, 0.0), ("2024-04-01", "buy", "A", 4.0, 9.0, None, 0.0), ("2024-06-01", "split", "A", 8.0, None, None, 0.0), ("2024-07-01", "sell", "A", 6.0, 4.0, None, 0.0), ("2024-08-01", "split", "A", 3.0, None, None, 0.0), ("2024-01-02", "buy", "B", 10.0, 6.0, None, 0.0)]
    _, parts = ledger(spark, rows, market)
    got = {(r.buy and r.buy.id, r.sell and r.sell.id): (round(r.shares, 6), round(r.cost, 6) if r.buy else None) for r in parts.collect()}
    # A: sold out, a split of nothing, 4 become 12, 6 sold, 6 become 9; B: the market's split of 3
    assert got == {(1, 2): (10.0, 60.0), (None, 2): (4.0, None), (4, 6): (6.0, 18.0), (4, None): (9.0, 18.0), (8, None): (30.0, 60.0)}


def test_a_split_that_leaves_nothing_takes_the_lots_away(spark):
    rows = [("2024-01-02", "buy", "A", 10.0, 6.0, None, 0.0), ("2024-02-01", "split", "A", -10.0, None, None, 0.0), ("2024-03-01", "buy", "A", 2.0, 6.0, None, 0.0), ("2024-04-01", "sell", "A", 3.0, 6.0, None, 0.0)]
    _, parts = ledger(spark, rows)
    got = {(r.buy and r.buy.id, r.sell and r.sell.action): r.shares for r in parts.collect()}
    assert got == {(1, "split"): 10.0, (3, "sell"): 2.0, (None, "sell"): 1.0}


def test_backtest(spark):
    rows = [(1, D("2024-01-01") + dt.timedelta(days=i), x) for i, x in enumerate([100.0, 110.0, 99.0, 120.0, 120.0])]
    out = backtests.run(spark.createDataFrame(rows, "security_id long, date date, close double"), F.col("close") > 105)
    stats = backtests.statistics(out).first()
    assert round(stats.total, 6) == -0.1 and round(backtests.trades(out).orderBy("entry").first().ret, 6) == -0.1


def test_signal_days_count_every_day(spark):
    day = lambda i: D("2024-12-10") + dt.timedelta(days=i)
    closes = spark.createDataFrame([(1, day(i), float(i), 1) for i in range(25)] + [(2, day(i), 5.0, 1) for i in range(5)], "security_id long, date date, close double, volume long")
    out = {(r.security_id, r.year): (r.long_days, r.flat_days, r.unknown_days) for r in research.signal_days(closes).collect()}
    assert out == {(1, 2024): (3, 0, 19), (1, 2025): (3, 0, 0), (2, 2024): (0, 0, 5)}


def test_fifo(spark):
    rows = [(1, 1, D("2024-01-02"), "buy", "X", 10.0, 100.0), (2, 1, D("2024-06-03"), "buy", "X", 10.0, 150.0), (3, 1, D("2025-03-03"), "sell", "X", 15.0, 120.0), (4, 2, D("2024-01-02"), "buy", "Y", 5.0, 1.0), (5, 2, D("2024-01-03"), "sell", "Y", 8.0, 1.0)]
    t = spark.createDataFrame(rows, "id long, account_id long, trade_date date, action string, symbol string, quantity double, price double").withColumn("fees", F.lit(0.0))
    got = {(r.buy_id, r.sell_id): (r.quantity, r.gain, r.term) for r in portfolio.realized_gains(portfolio.fifo_lots(t)).collect()}
    assert got == {(1, 3): (10.0, 200.0, "long"), (2, 3): (5.0, -150.0, "short"), (4, 5): (5.0, 0.0, "short"), (None, 5): (3.0, None, None)}


def test_cleaning(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    number = {t: one(tables.accounting_number(F.lit(t))) for t in ("$1,234.50", "(12)", "+3%", "--", "n/a")}
    assert number == {"$1,234.50": 1234.5, "(12)": -12.0, "+3%": 3.0, "--": None, "n/a": None}
    assert tuple(one(tables.amount_range(F.lit("$1,001 - $15,000")))) == (1001, 15000) and tuple(one(tables.amount_range(F.lit("Over $50,000,000")))) == (50000001, None)
    assert one(tables.expand_codes(F.lit("1122, 1124-5, 23*, x"))) == ["1122", "1124", "1125", "23"]
    assert [one(tables.check_digit(F.lit(c))) for c in ("037833100", "037833101", "000000000")] == [True, False, False]
    assert one(series.weekdays_after(F.lit("2024-03-15").cast("date"), 8)) == D("2024-03-27")


def test_names(spark):
    df = spark.createDataFrame([(1, "Alpha Beta Corp"), (2, "Gamma")], "id long, name string")
    other = spark.createDataFrame([(7, "ALPHA BETAMAX GROUP ADR"), (8, "Gamma Delta Ltd"), (9, "Omega")], "id long, name string")
    assert [(r.left_id, r.right_id) for r in identity.match_names(df, other).collect()] == [(1, 7)]


def test_cluster_rest_period(spark):
    rows = [(i, 1, o, D(d), D(d), "P", False) for i, (o, d) in enumerate([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"), (4, "2024-01-20"), (5, "2024-02-20"), (6, "2024-02-21"), (7, "2024-02-22")])]
    t = spark.createDataFrame(rows, "id long, issuer_cik long, owner_cik long, filing_date date, trans_date date, trans_code string, plan_10b5_1 boolean")
    assert sorted(r.event_date for r in disclosures.cluster_events(t, 30, 3).collect()) == [D("2024-01-03"), D("2024-02-22")]


def test_keywords_and_page_text(spark):
    df = spark.createDataFrame([("Trade war tariff",), ("tariffs",), ("war and peace",), (None,)], "t string")
    hit = lambda q: [bool(r[0]) for r in df.select(text.keyword_filter(F.col("t"), q)).collect()]
    assert hit('"trade war" -peace') == [True, False, False, False] and hit("tariff OR peace") == [True, False, True, False]
    page = spark.createDataFrame([("<head><title>x</title></head><p>A &amp; b<script>1</script></p><tr><td>1</td><td>2</td></tr>",)], "html string")
    assert text.page_text(page).first().text == "A & b\n\n1\t2"


def test_search_operators(spark):
    docs = spark.createDataFrame([(1, "Trade wars and tariffs"), (2, "a tariff on trade"), (3, "peace"), (4, None), (5, "war on trade, trade war")], "id long, text string")
    found = lambda q: {r.id for r in text.search(text.inverted_index(docs, "id"), docs, "id", q).collect()}
    assert found("tariff") == {1, 2} and found('"trade war"') == {5} and found("trade -war") == {1, 2} and found("peace OR tariffs") == {1, 2, 3}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    folder = "/root/testdata/sf0.001/"
    events = spark.read.parquet(folder + "events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"))
    got = streams.drain(streams.daily_activity(stream, "60 days"), str(tmp_path / "c1"), "complete").select("day", "event_type", "n")
    want = events.groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert streams.drain(streams.newly_flagged(stream, 50.0), str(tmp_path / "c2")).count() > 0
    assert streams.drain(streams.once(stream, ["user_id"], "60 days"), str(tmp_path / "c3")).count() == events.select("user_id").distinct().count()
