"""Queries of disclosures, portfolios, backtests, statistics and the graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import backtests, disclosures, graph, indicators, portfolio, statistics
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)
DAY = lambda d: F.lit(d).cast("date")


@query("dis_01_cluster_buys", "insider_transactions", sql="""SELECT issuer_cik, count(DISTINCT owner_cik) AS insiders, count(*) AS purchases, sum(shares) AS shares, round(sum(shares * price), 2) AS value, min(trans_date) AS first, max(trans_date) AS last
 FROM insider_transactions WHERE trans_code = 'P' AND NOT plan_10b5_1 AND trans_date <= DATE '1999-06-30' AND trans_date > DATE '1999-06-30' - 120 GROUP BY 1 HAVING count(DISTINCT owner_cik) >= 2""")
def cluster_buys(t):
    return disclosures.cluster_buys(t, DAY("1999-06-30"), 120, 2).withColumn("value", R(F.col("value"), 2))


@query("dis_02_cluster_events", "insider_transactions", sql="""WITH RECURSIVE b AS (SELECT issuer_cik, owner_cik, filing_date, trans_date FROM insider_transactions WHERE trans_code = 'P' AND NOT plan_10b5_1), w AS (SELECT issuer_cik, filing_date, count(DISTINCT owner_cik) OVER (PARTITION BY issuer_cik ORDER BY trans_date RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND CURRENT ROW) AS n FROM b),
 c AS MATERIALIZED (SELECT DISTINCT issuer_cik, filing_date AS f FROM w WHERE n >= 3), ev(issuer_cik, d) AS (SELECT issuer_cik, min(f) FROM c GROUP BY 1 UNION ALL SELECT ev.issuer_cik, min(c.f) FROM ev JOIN c ON c.issuer_cik = ev.issuer_cik AND c.f >= ev.d + 120 GROUP BY 1) SELECT issuer_cik, d AS event_date FROM ev""")
def cluster_events(t):
    return disclosures.cluster_events(t, 120, 3)


CHANGES = """per AS (SELECT filer_cik, period, lag(period) OVER (PARTITION BY filer_cik ORDER BY period) AS previous FROM (SELECT DISTINCT filer_cik, period FROM positions)),
 ch AS (SELECT coalesce(n.filer_cik, b.filer_cik) AS filer_cik, coalesce(n.period, b.period) AS period, coalesce(n.cusip, b.cusip) AS cusip, coalesce(n.put_call, b.put_call) AS put_call, n.shares, b.shares AS shares_before
  FROM (SELECT p.* FROM positions p JOIN per USING (filer_cik, period) WHERE previous IS NOT NULL) n FULL OUTER JOIN (SELECT p.filer_cik, per.period, p.cusip, p.put_call, p.shares FROM positions p JOIN per ON per.filer_cik = p.filer_cik AND per.previous = p.period) b
  ON n.filer_cik = b.filer_cik AND n.period = b.period AND n.cusip = b.cusip AND n.put_call = b.put_call),
 cc AS (SELECT *, CASE WHEN shares_before IS NULL THEN 'new' WHEN shares IS NULL THEN 'sold' WHEN shares > shares_before THEN 'added' WHEN shares < shares_before THEN 'reduced' ELSE 'unchanged' END AS change FROM ch)"""


@query("dis_07_manager_changes", "positions", sql=f"WITH {CHANGES} SELECT filer_cik, period, cusip, put_call, shares, shares_before, change FROM cc")
def manager_changes(p):
    return disclosures.manager_changes(p).select("filer_cik", "period", "cusip", "put_call", "shares", "shares_before", "change")


@query("dis_08_manager_quarters", "positions", sql=f"""WITH {CHANGES} SELECT h.filer_cik, h.period, h.positions, h.value, g.previous_positions, round(g.gone / nullif(g.previous_positions, 0), 6) AS turnover FROM (SELECT filer_cik, period, count(*) AS positions, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM positions GROUP BY 1, 2) h
 LEFT JOIN (SELECT filer_cik, period, count(*) FILTER (change = 'sold')::DOUBLE AS gone, count(shares_before) AS previous_positions FROM cc GROUP BY 1, 2) g USING (filer_cik, period)""")
def manager_quarters(p):
    return disclosures.manager_quarters(p).withColumn("turnover", R(F.col("turnover")))


@query("dis_09_best_ideas", "positions", sql="""WITH p AS (SELECT * FROM positions WHERE put_call = ''), per AS (SELECT filer_cik, period, lag(period) OVER (PARTITION BY filer_cik ORDER BY period) AS previous FROM (SELECT DISTINCT filer_cik, period FROM p)),
 r AS (SELECT *, rank() OVER (PARTITION BY filer_cik, period ORDER BY value DESC, cusip) AS rank FROM p QUALIFY rank <= 10)
 SELECT r.filer_cik, r.period, r.cusip, r.rank FROM r JOIN per USING (filer_cik, period) LEFT JOIN p b ON b.filer_cik = r.filer_cik AND b.period = per.previous AND b.cusip = r.cusip WHERE b.shares IS NULL OR r.shares >= 1.5 * b.shares""")
def best_ideas(p):
    return disclosures.best_ideas(p)


@query("dis_06_event_study", "insider_transactions", "closes", sql="""WITH e AS (SELECT DISTINCT issuer_cik + 1 AS security_id, filing_date AS event_date FROM insider_transactions WHERE trans_code = 'P'),
 p AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date) AS i FROM closes), n AS (SELECT e.security_id, event_date, min(c.date) AS date FROM e JOIN closes c ON c.security_id = e.security_id AND c.date > event_date AND c.date <= event_date + 10 GROUP BY 1, 2),
 x AS (SELECT h, q.close / p.close - b1.close / b0.close AS x FROM n JOIN p USING (security_id, date) CROSS JOIN (VALUES (5), (21), (63)) t(h) JOIN p q ON q.security_id = n.security_id AND q.i = p.i + h JOIN closes b0 ON b0.security_id = 0 AND b0.date = n.date JOIN closes b1 ON b1.security_id = 0 AND b1.date = q.date)
 SELECT CAST(h AS INT) AS h, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(avg(CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(*)), 5) AS t FROM x GROUP BY h""")
def event_study(t, closes):
    events = t.where("trans_code = 'P'").select((F.col("issuer_cik") + 1).alias("security_id"), F.col("filing_date").alias("event_date")).distinct()
    out = disclosures.event_study(events, closes, [5, 21, 63])
    return out.select("h", "n", *(R(F.col(c)).alias(c) for c in ("mean", "median", "hit_rate")), R(F.col("t"), 5).alias("t"))


@query("sts_19_buy_classes", "insider_transactions", sql="""WITH b AS (SELECT id, issuer_cik % 5 AS issuer_cik, owner_cik % 5 AS owner_cik, trans_date FROM insider_transactions WHERE trans_code = 'P')
 SELECT id, CASE WHEN (SELECT count(DISTINCT year(c.trans_date)) FROM b c WHERE c.issuer_cik = b.issuer_cik AND c.owner_cik = b.owner_cik AND month(c.trans_date) = month(b.trans_date) AND year(b.trans_date) - year(c.trans_date) BETWEEN 1 AND 3) = 3 THEN 'routine'
  WHEN NOT EXISTS (SELECT 1 FROM b c WHERE c.issuer_cik = b.issuer_cik AND c.owner_cik = b.owner_cik AND datediff('day', c.trans_date, b.trans_date) BETWEEN 1 AND 1095) THEN 'new' ELSE 'opportunistic' END AS kind FROM b""")
def buy_classes(t):
    return disclosures.classify_buys(t.withColumns({"issuer_cik": F.col("issuer_cik") % 5, "owner_cik": F.col("owner_cik") % 5}))


LOTS = """t AS (SELECT *, sum(CAST(quantity AS DECIMAL(18, 2))) OVER (PARTITION BY account_id, symbol, action ORDER BY trade_date, id) AS e FROM transactions), i AS (SELECT *, e - CAST(quantity AS DECIMAL(18, 2)) AS s FROM t),
 tot AS (SELECT account_id, symbol, max(e) FILTER (action = 'buy') AS bought FROM i GROUP BY 1, 2),
 m AS (SELECT a.account_id, a.symbol, b.id AS buy_id, a.id AS sell_id, CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DOUBLE) AS quantity, a.trade_date AS sold, b.trade_date AS bought, a.price AS sp, b.price AS bp FROM i a JOIN i b ON a.action = 'sell' AND b.action = 'buy' AND a.account_id = b.account_id AND a.symbol = b.symbol AND a.s < b.e AND b.s < a.e
  UNION ALL SELECT account_id, symbol, NULL, id, CAST(e - greatest(s, coalesce(bought, 0)) AS DOUBLE), trade_date, NULL, price, NULL FROM i JOIN tot USING (account_id, symbol) WHERE action = 'sell' AND e > coalesce(bought, 0))"""


@query("ptf_02_fifo_lots", "transactions", sql=f"WITH {LOTS} SELECT account_id, symbol, buy_id, sell_id, quantity FROM m")
def fifo_lots(t):
    return portfolio.fifo_lots(t).groupBy("account_id", "symbol", "buy_id", "sell_id").agg(F.sum("quantity").alias("quantity"))


@query("ptf_03_realized_gains", "transactions", sql=f"WITH {LOTS} SELECT sell_id, buy_id, sold, round(quantity * sp, 8) AS proceeds, round(quantity * bp, 8) AS cost, CASE WHEN buy_id IS NOT NULL THEN CASE WHEN sold > CASE WHEN month(bought) = 2 AND day(bought) = 29 THEN CAST(bought + INTERVAL 12 MONTH AS DATE) + 1 ELSE CAST(bought + INTERVAL 12 MONTH AS DATE) END THEN 'long' ELSE 'short' END END AS term FROM m")
def realized_gains(t):
    return portfolio.realized_gains(portfolio.fifo_lots(t)).select("sell_id", "buy_id", "sold", R(F.col("proceeds"), 8).alias("proceeds"), R(F.col("cost"), 8).alias("cost"), "term")


@query("ptf_04_wash_sales", "transactions", sql=f"WITH {LOTS} SELECT sell_id, buy_id, coalesce(quantity * (sp - bp) < 0 AND EXISTS (SELECT 1 FROM transactions w WHERE w.action = 'buy' AND w.symbol = m.symbol AND abs(datediff('day', m.sold, w.trade_date)) <= 30 AND w.trade_date != m.bought), false) AS wash FROM m")
def wash_sales(t):
    gains = portfolio.realized_gains(portfolio.fifo_lots(t.repartition("symbol")))  # by symbol, as the purchases that wash: lots and join share the shuffle
    return portfolio.wash_sales(gains, t).select("sell_id", "buy_id", "wash")


@query("ptf_06_positions", "transactions", sql="SELECT account_id, symbol, bought, sold, greatest(bought - sold, 0) AS held FROM (SELECT account_id, symbol, coalesce(sum(quantity) FILTER (action = 'buy'), 0) AS bought, coalesce(sum(quantity) FILTER (action = 'sell'), 0) AS sold FROM transactions GROUP BY 1, 2)")
def positions(t):
    return portfolio.positions(t)


@query("ptf_07_latest_snapshot", "positions", sql="SELECT filer_cik, period, cusip, put_call FROM positions QUALIFY period = max(period) OVER (PARTITION BY filer_cik)")
def latest_snapshot(p):
    return portfolio.latest_snapshot(p, "filer_cik", "period").select("filer_cik", "period", "cusip", "put_call")


RUN = """s AS (SELECT security_id, date, CASE WHEN volume % 17 = 0 THEN NULL ELSE close END AS close FROM closes),
 g0 AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN round(close, 9) > round(avg(close) OVER w, 9) END AS signal FROM s WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 g1 AS (SELECT *, min(CASE WHEN signal IS NOT NULL AND close IS NOT NULL THEN date END) OVER (PARTITION BY security_id) AS start FROM g0),
 g AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS price FROM g1 WHERE date >= start),
 t AS (SELECT *, CASE WHEN signal THEN 1.0 ELSE 0.0 END AS target FROM g), h AS (SELECT *, lag(target, 1, 0.0) OVER o AS position, coalesce(CASE WHEN close IS NOT NULL AND lag(price) OVER o != 0 THEN price / lag(price) OVER o - 1 END, 0) AS bench FROM t WINDOW o AS (PARTITION BY security_id ORDER BY date)),
 k AS (SELECT *, position * bench - abs(position - lag(position, 1, 0.0) OVER (PARTITION BY security_id ORDER BY date)) * 10 / 10000 AS ret FROM h),
 run AS (SELECT security_id, date, start, signal, CAST(position AS DOUBLE) AS position, CAST(bench AS DOUBLE) AS bench, CAST(ret AS DOUBLE) AS ret, product(1 + CAST(ret AS DOUBLE)) OVER (PARTITION BY security_id ORDER BY date) AS equity FROM k WHERE date > start)"""


def _signal():
    frame = backtests.by_date().rowsBetween(-19, 0)
    return F.when(F.count("close").over(frame) == 20, F.round("close", 9) > F.round(F.avg("close").over(frame), 9))


def _prices(closes):
    return closes.select("security_id", "date", F.expr("CASE WHEN volume % 17 = 0 THEN NULL ELSE close END").alias("close"))


def _run(closes):
    return backtests.run(_prices(closes), _signal(), cost_bps=10)


@query("bkt_01_rule", "closes", sql="""WITH s AS (SELECT security_id, date, CASE WHEN volume % 17 = 0 THEN NULL ELSE close END AS px, CASE WHEN volume % 5 = 0 THEN NULL ELSE volume END AS vol FROM closes)
 SELECT security_id, date, (px > 1000 AND vol <= 30) OR (vol >= 60) OR (px < vol AND px > 1e1) AS signal FROM s""")
def rule(closes):
    s = closes.select("security_id", "date", F.expr("CASE WHEN volume % 17 = 0 THEN NULL ELSE close END").alias("px"), F.expr("CASE WHEN volume % 5 = 0 THEN NULL ELSE volume END").alias("vol"))
    return s.select("security_id", "date", backtests.rule_column("px > 1000 and vol <= 30 or vol >= 60 or px<vol and px > 1e1").alias("signal"))


@query("bkt_02_signal", "closes", sql=f"WITH {RUN} SELECT security_id, CAST(year(date) AS INT) AS year, count(*) FILTER (signal) AS long_days, count(*) FILTER (NOT signal) AS flat_days, count(*) FILTER (signal IS NULL) AS unknown_days FROM g0 GROUP BY 1, 2")
def signal_days(closes):
    days = lambda c, name: F.sum(c.cast("long")).alias(name)
    on = F.col("signal")
    return _prices(closes).withColumn("signal", _signal()).groupBy("security_id", F.year("date").alias("year")).agg(days(F.coalesce(on, F.lit(False)), "long_days"), days(F.coalesce(~on, F.lit(False)), "flat_days"), days(on.isNull(), "unknown_days"))


@query("bkt_03_run", "closes", sql=f"WITH {RUN} SELECT security_id, date, signal, position, round(ret, 6) AS ret, round(equity, 6) AS equity FROM run")
def run(closes):
    return _run(closes).select("security_id", "date", "signal", "position", R(F.col("ret")).alias("ret"), R(F.col("equity")).alias("equity"))


@query("bkt_04_statistics", "closes", sql=f"""WITH {RUN}, f AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY security_id ORDER BY date)) - 1 AS fall FROM run)
 SELECT security_id, round(e - 1, 6) AS total, CASE WHEN e > 0 AND y > 0 THEN round(pow(CASE WHEN e > 0 AND y > 0 THEN e ELSE 1 END, 1 / y) - 1, 6) ELSE -1 END AS cagr, round(s * sqrt(252), 6) AS vol, round(m / nullif(s, 0) * sqrt(252), 6) AS sharpe, round(least(d, 0), 6) AS max_drawdown, round(x, 6) AS exposure FROM (SELECT security_id, max_by(equity, date) AS e, datediff('day', min(start), max(date)) / 365.25::DOUBLE AS y, coalesce(stddev_samp(ret), 0) AS s, avg(ret) AS m, min(fall) AS d, avg(CASE WHEN position != 0 THEN 1.0::DOUBLE ELSE 0 END) AS x FROM f GROUP BY 1)""")
def bkt_statistics(closes):
    out = backtests.statistics(_run(closes))
    return out.select("security_id", *(R(F.col(c)).alias(c) for c in ("total", "cagr", "vol", "sharpe", "max_drawdown", "exposure")))


@query("bkt_05_trades", "closes", sql=f"""WITH {RUN}, b AS (SELECT *, sum(CASE WHEN position IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY date) AS r FROM (SELECT *, lag(position) OVER w AS p, coalesce(lag(date) OVER w, start) AS decided FROM run WINDOW w AS (PARTITION BY security_id ORDER BY date))),
 z AS (SELECT security_id, max(date) AS last FROM run GROUP BY 1) SELECT security_id, min(decided) AS entry, CASE WHEN max(date) < min(last) THEN max(date) END AS exit, count(*) AS days, round(product(1 + ret) - 1, 6) AS ret FROM b JOIN z USING (security_id) WHERE position != 0 GROUP BY security_id, r""")
def trades(closes):
    return backtests.trades(_run(closes)).withColumn("ret", R(F.col("ret")))


@query("bkt_06_yearly", "closes", sql=f"WITH {RUN} SELECT security_id, CAST(year(date) AS INT) AS year, round(product(1 + ret) - 1, 6) AS ret, round(product(1 + bench) - 1, 5) AS bench, round(avg(CASE WHEN position != 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS exposure FROM run GROUP BY 1, 2")
def yearly(closes):
    return backtests.yearly(_run(closes)).select("security_id", "year", R(F.col("ret")).alias("ret"), R(F.col("bench"), 5).alias("bench"), R(F.col("exposure")).alias("exposure"))


REGIME = """d AS (SELECT security_id, date, close, CASE WHEN count(close) OVER w = 20 THEN close > avg(close) OVER w END AS up, CAST(volume % 5 AS DOUBLE) AS yield, date_trunc('month', date) IS DISTINCT FROM date_trunc('month', lead(date) OVER (PARTITION BY security_id ORDER BY date)) AS me, min(date) OVER (PARTITION BY security_id) AS start FROM closes WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 a AS (SELECT *, CASE WHEN me THEN CASE WHEN up THEN 1.0::DOUBLE ELSE 0 END END AS asked FROM d), f AS (SELECT *, last_value(asked IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS w0 FROM a),
 p AS (SELECT *, coalesce(lag(w0) OVER o, 0) AS position, coalesce(close / nullif(lag(close) OVER o, 0) - 1, 0) AS hold, coalesce(lag(yield) OVER o / 100 / 252, 0) AS cash FROM f WINDOW o AS (PARTITION BY security_id ORDER BY date)),
 q AS (SELECT *, abs(position - lag(position, 1, 0) OVER (PARTITION BY security_id ORDER BY date)) AS moved FROM p),
 reg AS (SELECT security_id, date, start, position, hold, cash, position * hold + (1 - position) * cash - moved * 5 / 10000 AS ret, moved != 0 AS switched FROM q WHERE date > start)"""
MIX = """x AS (SELECT *, 0.6 * product(1 + hold) OVER m AS a, 0.4 * product(1 + cash) OVER m AS c, date_trunc('month', date) IS DISTINCT FROM date_trunc('month', lead(date) OVER (PARTITION BY security_id ORDER BY date)) AS me FROM reg WINDOW m AS (PARTITION BY security_id, date_trunc('month', date) ORDER BY date)),
 mix AS (SELECT *, (a + c) / coalesce(lag(a + c) OVER (PARTITION BY security_id, date_trunc('month', date) ORDER BY date), 1) - 1 - CASE WHEN me THEN abs(a / (a + c) - 0.6) * 5 / 10000 ELSE 0 END AS mix FROM x)"""


def _regime(closes):
    frame = backtests.by_date().rowsBetween(-19, 0)
    up = F.when(F.count("close").over(frame) == 20, F.col("close") > F.avg("close").over(frame))
    days = closes.select("security_id", "date", "close", (F.col("volume") % 5).cast("double").alias("yield"))
    return backtests.regime(days, F.when(up, 1.0).otherwise(0.0), backtests.month_end())


@query("bkt_07_regime", "closes", sql=f"WITH {REGIME} SELECT security_id, date, position, round(ret, 6) AS ret, switched FROM reg")
def regime(closes):
    return _regime(closes).select("security_id", "date", "position", R(F.col("ret")).alias("ret"), "switched")


@query("bkt_08_constant_mix", "closes", sql=f"WITH {REGIME}, {MIX} SELECT security_id, date, round(mix, 6) AS mix FROM mix")
def constant_mix(closes):
    return backtests.constant_mix(_regime(closes), 0.6).select("security_id", "date", R(F.col("mix")).alias("mix"))


@query("bkt_09_managed_weight", "closes", sql="""WITH r AS (SELECT security_id, date, close, close / nullif(lag(close) OVER (PARTITION BY security_id ORDER BY date), 0) - 1 AS r, date_trunc('month', date) IS DISTINCT FROM date_trunc('month', lead(date) OVER (PARTITION BY security_id ORDER BY date)) AS me, min(date) OVER (PARTITION BY security_id) AS start FROM closes),
 v AS (SELECT *, CASE WHEN count(r) OVER w = 21 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM r WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
 a AS (SELECT *, CASE WHEN me THEN CASE WHEN vol > 0 THEN least(1, 2 / vol) ELSE 0 END END AS asked FROM v), f AS (SELECT *, last_value(asked IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS w0 FROM a),
 p AS (SELECT *, coalesce(lag(w0) OVER (PARTITION BY security_id ORDER BY date), 0) AS position FROM f), q AS (SELECT *, position * coalesce(r, 0) - abs(position - lag(position, 1, 0) OVER (PARTITION BY security_id ORDER BY date)) * 5 / 10000 AS ret FROM p)
 SELECT security_id, date, round(position, 6) AS position, round(ret, 6) AS ret FROM q WHERE date > start""")
def managed_weight(closes):
    by = backtests.by_date()
    rows = closes.select("security_id", "date", "close", F.lit(None).cast("double").alias("yield"), (F.when(F.lag("close").over(by) != 0, F.col("close") / F.lag("close").over(by) - 1)).alias("r"))
    frame = by.rowsBetween(-20, 0)
    vol = F.when(F.count("r").over(frame) == 21, F.stddev_samp("r").over(frame) * F.sqrt(F.lit(252.0)))
    weight = F.when(vol > 0, F.least(F.lit(1.0), 2.0 / vol))
    out = backtests.regime(rows, weight, backtests.month_end())
    return out.select("security_id", "date", R(F.col("position")).alias("position"), R(F.col("ret")).alias("ret"))


@query("bkt_10_report", "closes", sql=f"""WITH {REGIME}, {MIX}, l AS (UNPIVOT (SELECT security_id, date, start, ret, hold, mix FROM mix) ON ret, hold, mix INTO NAME leg VALUE r),
 e AS (SELECT *, product(1 + r) OVER (PARTITION BY security_id, leg ORDER BY date) AS e FROM l), ff AS (SELECT *, e / greatest(1, max(e) OVER (PARTITION BY security_id, leg ORDER BY date)) - 1 AS fall FROM e),
 gg AS (SELECT security_id, leg, max_by(e, date) AS e, datediff('day', min(start), max(date)) / 365.25::DOUBLE AS y, coalesce(stddev_samp(r), 0) AS s, avg(r) AS m, least(min(fall), 0) AS d FROM ff GROUP BY 1, 2),
 mo AS (SELECT security_id, leg, date_trunc('month', date) AS month, product(1 + r) AS g FROM l GROUP BY 1, 2, 3), wo AS (SELECT security_id, leg, min(w) AS worst FROM (SELECT *, CASE WHEN count(g) OVER z = 12 THEN product(g) OVER z - 1 END AS w FROM mo WINDOW z AS (PARTITION BY security_id, leg ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2),
 hh AS (SELECT security_id, avg(position) AS exposure, sum(switched::INT) / nullif(datediff('day', min(start), max(date)) / 365.25::DOUBLE, 0) AS switches FROM reg GROUP BY 1)
 SELECT security_id, leg, round(m * 252 / nullif(s * sqrt(252), 0), 5) AS sharpe, round(s * sqrt(252), 5) AS vol, round(d, 5) AS max_drawdown, round(worst, 4) AS worst, round(exposure, 6) AS exposure, round(switches, 6) AS switches FROM gg JOIN wo USING (security_id, leg) JOIN hh USING (security_id)""")
def report(closes):
    out = backtests.period_report(backtests.constant_mix(_regime(closes), 0.6))
    return out.select("security_id", "leg", *(R(F.col(c), d).alias(c) for c, d in {"sharpe": 5, "vol": 5, "max_drawdown": 5, "worst": 4, "exposure": 6, "switches": 6}.items()))


@query("bkt_11_expanding", "closes", sql=f"""WITH {REGIME}, y AS (SELECT security_id, CAST(year(date) AS INT) AS year, product(1 + ret) AS ret, product(1 + hold) AS hold FROM reg GROUP BY 1, 2)
 SELECT security_id, year, round(product(ret) OVER w - 1, 4) AS ret_sofar, round(product(hold) OVER w - 1, 4) AS hold_sofar, CASE WHEN lead(year) OVER w = year + 1 THEN round(lead(ret) OVER w - 1, 4) END AS ret_next, CASE WHEN lead(year) OVER w = year + 1 THEN round(lead(hold) OVER w - 1, 4) END AS hold_next FROM y WINDOW w AS (PARTITION BY security_id ORDER BY year)""")
def expanding(closes):
    out = backtests.expanding_view(_regime(closes))
    return out.select("security_id", "year", *(R(F.col(c), 4).alias(c) for c in out.columns[2:]))


RETS = "r AS (SELECT key, date, CASE WHEN lag(value) OVER o != 0 THEN value / lag(value) OVER o - 1 END AS value FROM series WINDOW o AS (PARTITION BY key ORDER BY date))"


@query("sts_01_newey_west", "series", sql=f"""WITH {RETS}, v AS (SELECT key, date, value, value - avg(value) OVER (PARTITION BY key) AS e FROM r WHERE value IS NOT NULL), g AS (SELECT *, {', '.join(f'e * lag(e, {k}) OVER (PARTITION BY key ORDER BY date) AS g{k}' for k in range(1, 41))} FROM v),
 z AS (SELECT key, count(*) AS n, avg(value) AS mean, sum(e * e) AS g0, {', '.join(f'coalesce(sum(g{k}), 0) AS g{k}' for k in range(1, 41))}, floor(4 * pow(count(*) / 100.0, 2.0 / 9)) AS L FROM g GROUP BY 1),
 a AS (SELECT key, n, mean, sqrt(greatest(g0 + {' + '.join(f'CASE WHEN L >= {k} THEN 2 * (1 - {k} / (L + 1)) * g{k} ELSE 0 END' for k in range(1, 41))}, 0)) / n AS error FROM z) SELECT key, n, round(mean, 6) AS mean, round(error, 6) AS error, round(mean - 1.96 * error, 5) AS low, round(mean + 1.96 * error, 5) AS high FROM a WHERE n >= 3""")
def newey_west(s):
    out = statistics.newey_west(s.select("key", "date", indicators.ret().alias("value"))).where("n >= 3")
    return out.select("key", "n", *(R(F.col(c)).alias(c) for c in ("mean", "error")), *(R(F.col(c), 5).alias(c) for c in ("low", "high")))


@query("sts_03_bootstrap", "series")
def bootstrap(s):
    return statistics.bootstrap_means(s.select("key", "date", indicators.ret().alias("value")))


@query("sts_06_cross_correlation", "series", sql="""WITH b AS (SELECT date, value AS y FROM series WHERE key = 0), p AS (SELECT s.key, row_number() OVER (PARTITION BY s.key ORDER BY s.date) AS i, s.value AS x, b.y FROM series s JOIN b USING (date) WHERE s.key != 0)
 SELECT a.key, CAST(lag AS INT) AS lag, count(*) AS n, round(corr(a.x, c.y), 6) AS corr FROM p a CROSS JOIN range(-3, 4) t(lag) JOIN p c ON c.key = a.key AND c.i = a.i + lag WHERE a.x IS NOT NULL AND c.y IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 10""")
def cross_correlation(s):
    y = s.where("key = 0").select("date", F.col("value").alias("y"))
    pairs = s.where("key != 0").join(y, "date").select("key", F.row_number().over(W.partitionBy("key").orderBy("date")).alias("i"), F.col("value").alias("x"), "y")
    return statistics.cross_correlation(pairs, range(-3, 4)).withColumn("corr", R(F.col("corr")))


@query("sts_05_lift", "insider_transactions", sql="""WITH r AS (SELECT plan_10b5_1 AS planned, price > 100 AS dear, shares > 500 AS large, trans_code = 'P' AS o FROM insider_transactions), s AS (SELECT 'planned' AS signal, planned AS f, o FROM r UNION ALL SELECT 'dear', dear, o FROM r UNION ALL SELECT 'large', large, o FROM r)
 SELECT signal, count(*) FILTER (f) AS flagged, count(*) FILTER (f AND o) AS hits, round(count(*) FILTER (f AND o) / count(*) FILTER (f)::DOUBLE, 6) AS precision, round(count(*) FILTER (f AND o) / count(*) FILTER (o)::DOUBLE, 6) AS recall, round((count(*) FILTER (f AND o) / count(*) FILTER (f)::DOUBLE) / (count(*) FILTER (o) / count(*)::DOUBLE), 6) AS lift FROM s GROUP BY 1""")
def lift(t):
    rows = t.select(F.col("plan_10b5_1").alias("planned"), (F.col("price") > 100).alias("dear"), (F.col("shares") > 500).alias("large"), (F.col("trans_code") == "P").cast("int").alias("o"))
    out = statistics.lift(rows, ["planned", "dear", "large"], "o")
    return out.select("signal", "flagged", "hits", *(R(F.col(c)).alias(c) for c in ("precision", "recall", "lift")))


@query("sts_08_auc", "insider_transactions", sql="""WITH r AS (SELECT owner_cik, CASE WHEN trans_code = 'P' THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY owner_cik ORDER BY shares) + (count(*) OVER (PARTITION BY owner_cik, shares) - 1) / 2.0::DOUBLE AS k FROM insider_transactions)
 SELECT owner_cik, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE, 6) END AS auc FROM r GROUP BY 1""")
def auc(t):
    rows = t.select("owner_cik", "shares", F.when(F.col("trans_code") == "P", 1).otherwise(0).alias("y"))
    return statistics.auc(rows, "owner_cik", "shares", "y").withColumn("auc", R(F.col("auc")))


@query("sts_14_top_share", "insider_transactions", sql="""WITH s AS (SELECT id, owner_cik, round(1 / (1 + exp(-(-2 + 0.5 * CAST(plan_10b5_1 AS INT) + 0.001 * shares))), 9) AS score FROM insider_transactions), q AS (SELECT owner_cik, quantile_cont(score, 0.9) AS c FROM s GROUP BY 1) SELECT id, round(score, 6) AS score, score >= c AS flagged FROM s JOIN q USING (owner_cik)""")
def top_share(t):
    scored = t.withColumn("score", R(statistics.logistic({"plan_10b5_1": 0.5, "shares": 0.001}, -2.0), 9))
    return statistics.top_share(scored, "owner_cik", "score", 0.1).select("id", R(F.col("score")).alias("score"), "flagged")


@query("grf_01_flow_shares", "graph_flows", sql="SELECT supplier, buyer, round(value / sum(value) OVER (PARTITION BY buyer), 6) AS buyer_share, round(value / sum(value) OVER (PARTITION BY supplier), 6) AS supplier_share FROM graph_flows WHERE supplier <> buyer")
def flow_shares(f):
    return graph.flow_shares(f).select("supplier", "buyer", R(F.col("buyer_share")).alias("buyer_share"), R(F.col("supplier_share")).alias("supplier_share"))


@query("grf_03_group_flows", "graph_flows", sql="WITH m AS (SELECT DISTINCT supplier AS node, left(md5(supplier), 1) AS g FROM graph_flows UNION SELECT DISTINCT buyer, left(md5(buyer), 1) FROM graph_flows) SELECT a.g AS from_group, b.g AS to_group, CAST(sum(CAST(value AS DECIMAL(20, 2))) AS DOUBLE) AS value FROM graph_flows f JOIN m a ON a.node = supplier JOIN m b ON b.node = buyer WHERE supplier <> buyer AND a.g <> b.g GROUP BY 1, 2")
def group_flows(f):
    nodes = f.select(F.col("supplier").alias("node")).unionByName(f.select(F.col("buyer").alias("node"))).distinct()
    return graph.group_flows(f, nodes.withColumn("group", F.substring(F.md5("node"), 1, 1)))


@query("grf_05_walk", "graph_flows", sql="""WITH RECURSIVE e AS (SELECT supplier AS src, buyer AS dst, value / sum(value) OVER (PARTITION BY buyer) AS share FROM graph_flows WHERE supplier <> buyer), w AS (SELECT src AS start, src AS node, [src] AS path, 1.0::DOUBLE AS weight, 0 AS hops FROM (SELECT DISTINCT src FROM e)
  UNION ALL SELECT start, e.dst, list_append(path, e.dst), weight * share, hops + 1 FROM w JOIN e ON e.src = w.node AND share >= 0.04 AND NOT list_contains(path, e.dst) WHERE hops < 2)
 SELECT start, node, max(round(weight, 9)) AS weight, CAST(arg_max(hops, (round(weight, 9), -hops)) AS BIGINT) AS hops FROM w WHERE hops > 0 GROUP BY 1, 2""")
def walk(f):
    edges = graph.flow_shares(f).select(F.col("supplier").alias("src"), F.col("buyer").alias("dst"), F.col("buyer_share").alias("share"))
    return graph.walk(edges, edges.select(F.col("src").alias("node")).distinct(), 2, 0.04)
