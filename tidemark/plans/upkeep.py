"""Queries of point-in-time series and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import prices, series, tables
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)


@query("tsr_03_combine", "series", sql="SELECT s.key, s.date, round(s.value / nullif(o.value, 0), 6) AS ratio, round(s.value - o.value, 6) AS difference FROM series s JOIN series o ON o.key = 0 AND o.date = s.date WHERE s.key != 0")
def combine(s):
    return series.combine(s).select("key", "date", R(F.col("ratio")).alias("ratio"), R(F.col("difference")).alias("difference"))


@query("tsr_04_step", "series", "closes", sql="SELECT k.key, d.date, round(s.value, 6) AS value FROM (SELECT DISTINCT key FROM series) k CROSS JOIN (SELECT DISTINCT date FROM closes WHERE security_id = 0) d ASOF LEFT JOIN (SELECT * FROM series WHERE value IS NOT NULL) s ON s.key = k.key AND d.date >= s.date")
def step(s, closes):
    return series.step(s.withColumnRenamed("date", "known_on"), prices.calendar(closes)).withColumn("value", R(F.col("value")))


@query("tsr_05_latest_revision", "vintages", sql="SELECT series_id, date, arg_max_null(value, realtime_start) AS value FROM vintages GROUP BY 1, 2")
def latest_revision(v):
    return series.latest_revision(v)


@query("tsr_06_point_in_time", "vintages", sql="""WITH d AS (SELECT DISTINCT realtime_start AS day FROM vintages), s AS (SELECT *, lead(realtime_start) OVER (PARTITION BY series_id, date ORDER BY realtime_start) AS until FROM vintages),
 o AS (SELECT series_id, day, date, value FROM s JOIN d ON realtime_start <= day AND (until IS NULL OR day < until) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, day ORDER BY date DESC) = 1)
 SELECT series_id, day, CASE WHEN date <= day THEN value END AS value FROM o""")
def point_in_time(v):
    return series.as_known(v, v.select(F.col("realtime_start").alias("date")).distinct())


@query("tsr_08_availability", "statement_items", sql="SELECT cik, period_end, CAST(period_end + 90 AS DATE) AS known_90, CAST(last_day(period_end) + 45 AS DATE) AS known_45, CAST(date_trunc('month', period_end) + INTERVAL 1 MONTH AS DATE) AS known_month FROM statement_items")
def availability(s):
    return s.select("cik", "period_end", F.date_add("period_end", 90).alias("known_90"), F.date_add(F.last_day("period_end"), 45).alias("known_45"), F.add_months(F.trunc("period_end", "month"), 1).alias("known_month"))


@query("tsr_09_business_days", "closes", sql="SELECT DISTINCT date, (SELECT CAST(max(x) AS DATE) FROM (SELECT x FROM (SELECT date + CAST(i AS INT) AS x FROM range(1, 16) t(i)) WHERE isodow(x) <= 5 ORDER BY x LIMIT 8)) AS published FROM closes WHERE security_id = 0")
def business_days(closes):
    return prices.calendar(closes).select("date", series.weekdays_after(F.col("date"), 8).alias("published"))


@query("tsr_19_month_ends", "closes", sql="SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date FROM closes WHERE security_id = 0 GROUP BY 1")
def month_ends(closes):
    return series.month_ends(prices.calendar(closes))


@query("tsr_20_quarter_means", "series", sql="""WITH m AS (SELECT key, date_trunc('month', date) AS month, avg(value) AS value FROM series WHERE value IS NOT NULL GROUP BY 1, 2)
 SELECT key, CAST(date_trunc('quarter', month) AS DATE) AS quarter, round(avg(value), 6) AS value FROM m GROUP BY 1, 2 HAVING count(*) = 3""")
def quarter_means(s):
    return series.averages(s).withColumn("value", R(F.col("value")))


@query("tsr_21_monthly_returns", "series", sql="""WITH r AS (SELECT key, date, CASE WHEN lag(value) OVER o > 0 THEN value / lag(value) OVER o - 1 END AS r FROM series WINDOW o AS (PARTITION BY key ORDER BY date))
 SELECT key, CAST(date_trunc('month', date) AS DATE) AS month, round(product(1 + r) - 1, 6) AS value FROM r WHERE r IS NOT NULL GROUP BY 1, 2""")
def monthly_returns(s):
    from tidemark.operators import indicators

    return series.monthly_returns(s.select("key", "date", indicators.ret().alias("value"))).withColumn("value", R(F.col("value")))


@query("src_04_upsert", "positions", sql="""WITH t AS (SELECT * FROM positions WHERE period <= DATE '1998-12-31'), b AS (SELECT filer_cik, period, cusip, put_call, shares * 2 AS shares, value FROM positions WHERE period >= DATE '1998-12-31')
 SELECT filer_cik, period, cusip, put_call, coalesce(b.shares, t.shares) AS shares, coalesce(t.value, b.value) AS value FROM t FULL OUTER JOIN b USING (filer_cik, period, cusip, put_call)""")
def upsert(p):
    target = p.where("period <= '1998-12-31'")
    batch = p.where("period >= '1998-12-31'").withColumn("shares", F.col("shares") * 2)
    twice = batch.withColumn("seq", F.lit(2)).unionByName(batch.withColumn("shares", F.lit(-1.0)).withColumn("seq", F.lit(1)))
    return tables.upsert(target, twice, ["filer_cik", "period", "cusip", "put_call"], "seq", update=["shares"])


@query("src_06_replace_from_date", "closes", sql="WITH n AS (SELECT security_id, date, close * 2 AS close FROM closes WHERE security_id % 2 = 0 AND date >= DATE '2000-01-01'), f AS (SELECT security_id, min(date) AS f FROM n GROUP BY 1) SELECT security_id, date, round(close, 6) AS close FROM (SELECT c.security_id, c.date, c.close FROM closes c LEFT JOIN f USING (security_id) WHERE f IS NULL OR c.date < f UNION ALL SELECT * FROM n)")
def replace_from_date(closes):
    old = closes.select("security_id", "date", "close")
    new = old.where("security_id % 2 = 0 AND date >= '2000-01-01'").withColumn("close", F.col("close") * 2)
    return tables.replace_from_date(old, new, "security_id", "date").withColumn("close", R(F.col("close")))


@query("src_07_content_key", "transactions", sql="""WITH c AS (SELECT id, account_id || '|' || symbol || '|' || action || '|' || strftime(trade_date, '%Y-%m') AS content FROM transactions), n AS (SELECT id, content, row_number() OVER (PARTITION BY content ORDER BY id) AS occurrence FROM c)
 SELECT id, occurrence, substr(sha256(content || '|' || occurrence), 1, 32) AS key FROM n""")
def content_key(t):
    rows = t.select("id", "account_id", "symbol", "action", F.date_format("trade_date", "yyyy-MM").alias("month"))
    return tables.content_key(rows, ["account_id", "symbol", "action", "month"], ["id"]).select("id", "occurrence", "key")


@query("src_08_plausible", "insider_transactions", sql="SELECT id, trans_date FROM insider_transactions WHERE trans_date >= DATE '1990-01-01' AND (filing_date IS NULL OR trans_date <= filing_date + 31)")
def plausible(i):
    return tables.plausible(i).select("id", "trans_date")


@query("src_10_amendments", "positions", sql="""WITH r AS (SELECT filer_cik, date_trunc('year', period)::DATE AS period, cusip, put_call, period AS filed, cusip || put_call AS accession, quarter(period) = 2 AS replaces, shares FROM positions),
 l AS (SELECT *, max(CASE WHEN replaces THEN (filed, accession) END) OVER (PARTITION BY filer_cik, period) AS last FROM r)
 SELECT filer_cik, period, cusip, put_call, filed, shares FROM l WHERE last IS NULL OR (filed, accession) >= last QUALIFY row_number() OVER (PARTITION BY filer_cik, period, cusip, put_call ORDER BY filed DESC, accession DESC) = 1""")
def amendments(p):
    reports = p.select("filer_cik", F.trunc("period", "year").alias("period"), "cusip", "put_call", F.col("period").alias("filed"), F.concat("cusip", "put_call").alias("accession"), (F.quarter("period") == 2).alias("replaces"), "shares")
    return tables.replay_amendments(reports).select("filer_cik", "period", "cusip", "put_call", "filed", "shares")


@query("src_13_check_digit", "positions", sql="""WITH c AS (SELECT DISTINCT cusip FROM positions), v AS (SELECT cusip, i, (ord(substr(cusip, CAST(i AS INT), 1)) - 48) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) AS v FROM c, range(1, 9) t(i))
 SELECT cusip, cusip != '000000000' AND CAST((10 - sum(v // 10 + v % 10) % 10) % 10 AS VARCHAR) = substr(cusip, 9, 1) AS valid FROM v GROUP BY cusip""")
def check_digit(p):
    return p.select("cusip").distinct().select("cusip", tables.check_digit(F.col("cusip")).alias("valid"))


@query("src_22_periods", "positions", sql="WITH p AS (SELECT DISTINCT period FROM positions), d AS (SELECT period FROM p WHERE year(period) < 2000) SELECT period FROM p WHERE period NOT IN (SELECT period FROM d) UNION (SELECT period FROM p ORDER BY period DESC LIMIT 2)")
def periods(p):
    return tables.periods_to_compute(p, p.where(F.year("period") < 2000))


@query("src_24_latest_per_key", "insider_transactions", sql="SELECT issuer_cik, owner_cik, id, filing_date FROM insider_transactions QUALIFY row_number() OVER (PARTITION BY issuer_cik, owner_cik ORDER BY filing_date DESC, id DESC) = 1")
def latest_per_key(i):
    return tables.latest_per_key(i, ["issuer_cik", "owner_cik"], [F.desc("filing_date"), F.desc("id")]).select("issuer_cik", "owner_cik", "id", "filing_date")


@query("src_25_changed", "statement_items", sql="SELECT s.cik, s.hash FROM (SELECT cik, sha256(period_end || '|' || CAST(floor(value) AS BIGINT)) AS hash FROM statement_items) s WHERE (s.cik, s.hash) NOT IN (SELECT (cik, sha256(period_end || '|' || CAST(floor(value) AS BIGINT))) FROM statement_items WHERE cik % 3 = 1 AND year(period_end) < 1999)")
def changed_rows(s):
    rows = s.select("cik", F.col("period_end").cast("string").alias("p"), F.floor("value").cast("long").alias("v"))
    loaded = s.where("cik % 3 = 1 AND year(period_end) < 1999").select("cik", F.sha2(F.concat_ws("|", F.col("period_end").cast("string"), F.floor("value").cast("long").cast("string")), 256).alias("hash"))
    return tables.changed(rows, loaded, "cik", ["p", "v"])
