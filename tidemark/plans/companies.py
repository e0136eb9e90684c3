"""Queries of identity, fundamentals and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import breadth, fundamentals, identity, prices
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)
DAY = lambda d: F.lit(d).cast("date")


@query("idn_01_symbol_as_of", "securities", "closes", sql="""WITH h AS (SELECT 'T' || security_id % 7 AS symbol, security_id, DATE '1995-06-30' + CAST(security_id * 37 % 2000 AS INT) AS last_seen FROM securities WHERE security_id % 2 = 0),
 cur AS (SELECT 'T' || security_id % 7 AS symbol, min(security_id) AS security_id, DATE '1998-01-01' AS renamed_on FROM securities WHERE security_id % 2 = 1 AND security_id % 7 < 5 GROUP BY 1),
 asked AS (SELECT DISTINCT 'T' || i AS symbol, date FROM closes, range(7) t(i) WHERE security_id = 0 AND day(date) = 15)
 SELECT a.symbol, a.date, coalesce((SELECT min_by(security_id, (last_seen, security_id)) FROM h WHERE h.symbol = a.symbol AND h.last_seen >= a.date),
   CASE WHEN c.security_id IS NOT NULL THEN CASE WHEN a.date > c.renamed_on THEN c.security_id END ELSE (SELECT max_by(security_id, (last_seen, security_id)) FROM h WHERE h.symbol = a.symbol) END) AS security_id FROM asked a LEFT JOIN cur c USING (symbol)""")
def symbol_as_of(securities, closes):
    symbol = F.concat(F.lit("T"), (F.col("security_id") % 7).cast("string"))
    history = securities.where("security_id % 2 = 0").select(symbol.alias("symbol"), "security_id", F.date_add(DAY("1995-06-30"), (F.col("security_id") * 37 % 2000).cast("int")).alias("last_seen"))
    current = securities.where("security_id % 2 = 1 AND security_id % 7 < 5").groupBy(symbol.alias("symbol")).agg(F.min("security_id").alias("security_id"), F.min(DAY("1998-01-01")).alias("renamed_on"))
    days = closes.where("security_id = 0 AND day(date) = 15").select("date").distinct()
    asked = days.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("T"), i.cast("string")))).alias("symbol"), "date")
    return identity.symbol_as_of(asked, history, current)


@query("idn_06_best_listing", "securities", sql="SELECT cik, min_by(ticker, (CASE WHEN mic = 'XNYS' AND security_type = 'CS' THEN 0 WHEN mic = 'XNYS' THEN 1 WHEN active THEN 2 ELSE 3 END, security_id)) AS ticker FROM securities GROUP BY 1")
def best_listing(s):
    rank = F.when((F.col("mic") == "XNYS") & (F.col("security_type") == "CS"), 0).when(F.col("mic") == "XNYS", 1).when(F.col("active"), 2).otherwise(3)
    return identity.best_listing(s, "cik", rank, "security_id")


@query("idn_07_unique_bridge", "insider_transactions", "positions", sql="""WITH f AS (SELECT DISTINCT CAST(issuer_cik % 40 + owner_cik % 3 AS VARCHAR) AS ticker, issuer_cik AS issuer, filing_date AS filed FROM insider_transactions), h AS (SELECT DISTINCT CAST(filer_cik AS VARCHAR) AS ticker, period FROM positions)
 SELECT ticker, period, min(issuer) AS issuer FROM h JOIN f USING (ticker) WHERE abs(datediff('day', period, filed)) <= 20 GROUP BY 1, 2 HAVING count(DISTINCT issuer) = 1""")
def unique_bridge(i, p):
    filings = i.select((F.col("issuer_cik") % 40 + F.col("owner_cik") % 3).cast("string").alias("ticker"), F.col("issuer_cik").alias("issuer"), F.col("filing_date").alias("filed")).distinct()
    return identity.unique_bridge(p.select(F.col("filer_cik").cast("string").alias("ticker"), "period").distinct(), filings, 20)


@query("idn_08_prefix_bridge", "positions", sql="""WITH c AS (SELECT DISTINCT cusip FROM positions), m AS (SELECT cusip, CAST(substr(cusip, 7, 1) AS BIGINT) AS issuer FROM c WHERE right(cusip, 1) < '7' AND NOT (cusip LIKE '%12%'))
 SELECT u.cusip, k.issuer FROM c u JOIN (SELECT substr(cusip, 1, 7) AS p, min(issuer) AS issuer FROM m GROUP BY 1 HAVING count(DISTINCT issuer) = 1) k ON k.p = substr(u.cusip, 1, 7) WHERE u.cusip NOT IN (SELECT cusip FROM m)""")
def prefix_bridge(p):
    c = p.select("cusip").distinct()
    mapped = c.where("right(cusip, 1) < '7' AND NOT cusip LIKE '%12%'").withColumn("issuer", F.substring("cusip", 7, 1).cast("long"))
    return identity.prefix_bridge(mapped, c.join(mapped, "cusip", "left_anti"), 7)


@query("idn_13_primary_security", "securities", "closes", sql="""WITH a AS (SELECT security_id, round(avg(close * volume), 2) AS d FROM closes WHERE date <= DATE '1999-06-30' AND date > DATE '1999-05-31' GROUP BY 1)
 SELECT cik, security_id FROM securities JOIN a USING (security_id) WHERE security_type IN ('CS', 'ADRC') AND mic IN ('XNYS', 'XNAS', 'XASE') QUALIFY row_number() OVER (PARTITION BY cik ORDER BY d DESC, security_id) = 1""")
def primary_security(s, closes):
    return identity.primary_security(s, closes, DAY("1999-06-30"))


@query("idn_14_split_weights", "positions", sql="""WITH c AS (SELECT DISTINCT cusip AS code FROM positions), s AS (SELECT code, substr(code, 1, 8) AS target FROM c WHERE code > '000000050' UNION SELECT code, 'x' || right(code, 1) FROM c WHERE right(code, 1) < '5')
 SELECT c.code, coalesce(s.target, c.code) AS target, round(1.0::DOUBLE / count(*) OVER (PARTITION BY c.code), 6) AS weight FROM c LEFT JOIN s USING (code)""")
def split_weights(p):
    c = p.select(F.col("cusip").alias("code")).distinct()
    pairs = c.where("code > '000000050'").select("code", F.substring("code", 1, 8).alias("target")).unionByName(c.where("right(code, 1) < '5'").select("code", F.concat(F.lit("x"), F.right("code", F.lit(1))).alias("target")))
    return identity.split_weights(c, pairs).withColumn("weight", R(F.col("weight")))


@query("idn_17_sectors", "securities", sql=f"SELECT security_id, s.name AS sector FROM securities LEFT JOIN (VALUES {', '.join(f'''('{n}', {a}, {b})''' for n, a, b in breadth.SECTORS)}) s(name, a, b) ON sic BETWEEN a AND b")
def sectors(s):
    return s.select("security_id", breadth.sector(F.col("sic")).alias("sector"))


@query("idn_19_surrogate_id", "securities", sql="SELECT security_id, 20000000000 + CAST(regexp_replace(ticker, '[^0-9]', '', 'g') AS BIGINT) AS id FROM securities")
def surrogate_id(s):
    return s.select("security_id", identity.surrogate_id(F.col("ticker"), 20_000_000_000).alias("id"))


@query("idn_20_reconcile", "securities", sql="""WITH o AS (SELECT ticker, cik AS owner FROM securities WHERE security_id % 5 != 0), n AS (SELECT CASE WHEN security_id % 11 = 3 THEN ticker || 'X' ELSE ticker END AS ticker, CASE WHEN security_id % 7 = 1 THEN cik + 1000 ELSE cik END AS owner FROM securities WHERE security_id % 9 != 2),
 b AS (SELECT ticker, o.owner AS o, n.owner AS n FROM o FULL OUTER JOIN n USING (ticker)), g AS (SELECT o AS owner, min(ticker) AS old_ticker FROM b WHERE n IS NULL GROUP BY 1 HAVING count(*) = 1), c AS (SELECT n AS owner, min(ticker) AS new_ticker FROM b WHERE o IS NULL GROUP BY 1 HAVING count(*) = 1), r AS (SELECT old_ticker, new_ticker FROM g JOIN c USING (owner))
 SELECT b.ticker, CASE WHEN r.old_ticker IS NOT NULL THEN 'renamed' WHEN n IS NULL THEN 'delisted' WHEN o IS NULL THEN 'added' WHEN o = n THEN 'kept' ELSE 'reused' END AS change, r.new_ticker FROM b LEFT JOIN r ON r.old_ticker = b.ticker WHERE b.ticker NOT IN (SELECT new_ticker FROM r)""")
def reconcile(s):
    old = s.where("security_id % 5 != 0").select("ticker", F.col("cik").alias("owner"))
    new = s.where("security_id % 9 != 2").select(F.expr("CASE WHEN security_id % 11 = 3 THEN concat(ticker, 'X') ELSE ticker END").alias("ticker"), F.expr("CASE WHEN security_id % 7 = 1 THEN cik + 1000 ELSE cik END").alias("owner"))
    return identity.reconcile(old, new)


@query("idn_24_search", "securities", sql="SELECT ticker, security_id FROM securities WHERE contains(lower(ticker), '00') AND active ORDER BY ticker LIMIT 20")
def search(s):
    return identity.search(s, "00").select("ticker", "security_id")


@query("fnd_01_period_type", "statement_items", sql="SELECT cik, period_end, CASE WHEN d BETWEEN 80 AND 100 THEN 'quarter' WHEN d BETWEEN 170 AND 195 THEN 'half' WHEN d BETWEEN 260 AND 285 THEN 'nine_months' WHEN d BETWEEN 350 AND 380 THEN 'annual' ELSE 'other' END AS period_type FROM (SELECT *, datediff('day', period_start, period_end) + 1 AS d FROM statement_items)")
def period_type(s):
    return s.select("cik", "period_end", fundamentals.period_type(F.col("period_start"), F.col("period_end")).alias("period_type"))


@query("fnd_16_standalone_quarters", "statement_items", sql="""WITH q AS (SELECT *, year(period_end) AS fiscal_year, quarter(period_end) AS q FROM statement_items), y AS (SELECT *, sum(CAST(value AS DECIMAL(18, 2))) OVER w AS ytd, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY cik, line_item, unit, fiscal_year ORDER BY q)),
 v AS (SELECT * FROM y WHERE n = q) SELECT cik, CAST(fiscal_year AS INT) AS fiscal_year, CAST(q AS INT) AS quarter, round(CAST(ytd - coalesce(lag(ytd) OVER o, 0) AS DOUBLE), 2) AS value, greatest(filed, lag(filed) OVER o) AS first_filed, q > 1 AS derived FROM v WINDOW o AS (PARTITION BY cik, fiscal_year ORDER BY q)""")
def standalone_quarters(s):
    out = fundamentals.standalone_quarters(fundamentals.cumulative(s))
    return out.select("cik", "fiscal_year", "quarter", R(F.col("value"), 2).alias("value"), "first_filed", "derived")


@query("fnd_08_latest_per_period", "statement_items", sql="WITH f AS (SELECT * FROM statement_items UNION ALL SELECT cik, line_item, period_start, period_end, unit, value + 1, filed + 30 FROM statement_items WHERE cik % 2 = 0) SELECT cik, period_end, round(max_by(value, (filed, value)), 2) AS value, min(filed) AS first_filed FROM f GROUP BY cik, line_item, unit, period_start, period_end")
def latest_per_period(s):
    again = s.where("cik % 2 = 0").withColumn("value", F.col("value") + 1).withColumn("filed", F.date_add("filed", 30))
    return fundamentals.latest_per_period(s.unionByName(again)).select("cik", "period_end", R(F.col("value"), 2).alias("value"), "first_filed")


@query("met_01_trailing_year", "statement_items", sql="""WITH g AS (SELECT *, datediff('day', lag(period_end) OVER o, period_start) AS gap FROM statement_items WINDOW o AS (PARTITION BY cik ORDER BY period_end)), f AS (SELECT *, count(value) OVER w AS n, count(*) FILTER (gap BETWEEN 1 AND 7) OVER (PARTITION BY cik ORDER BY period_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c,
  datediff('day', min(period_start) OVER w, period_end) + 1 AS d, sum(CAST(value AS DECIMAL(18, 2))) OVER w AS s FROM g WINDOW w AS (PARTITION BY cik ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT cik, period_end, CASE WHEN n = 4 AND c = 3 AND d BETWEEN 350 AND 380 THEN round(CAST(s AS DOUBLE), 2) END AS ttm FROM f""")
def trailing_year(s):
    return fundamentals.trailing_year(s).select("cik", "period_end", R(F.col("ttm"), 2).alias("ttm"))


@query("met_10_growth", "statement_items", sql="SELECT a.cik, a.period_end, round((a.value - b.value) / abs(nullif(b.value, 0)), 6) AS growth FROM statement_items a JOIN statement_items b ON b.cik = a.cik AND year(b.period_end) = year(a.period_end) - 1 AND quarter(b.period_end) = quarter(a.period_end)")
def growth(s):
    before = s.select("cik", (F.year("period_end") + 1).alias("y"), F.quarter("period_end").alias("q"), F.col("value").alias("b"))
    now = s.withColumns({"y": F.year("period_end"), "q": F.quarter("period_end")})
    return now.join(before, ["cik", "y", "q"]).select("cik", "period_end", R(fundamentals.growth(F.col("value"), F.col("b"))).alias("growth"))


@query("scr_02_magic_rank", "securities", "closes", sql="""WITH m AS (SELECT security_id, round(stddev_samp(close) / avg(close), 9) AS earnings_yield, round(max(close) / min(close), 9) AS roic FROM closes JOIN securities USING (security_id) GROUP BY 1)
 SELECT security_id, CAST(row_number() OVER (ORDER BY earnings_yield DESC, security_id) + row_number() OVER (ORDER BY roic DESC, security_id) - 2 AS BIGINT) AS rank FROM m""")
def magic_rank(s, closes):
    m = closes.join(s.select("security_id"), "security_id").groupBy("security_id").agg(R(F.stddev_samp("close") / F.avg("close"), 9).alias("earnings_yield"), R(F.max("close") / F.min("close"), 9).alias("roic"))
    return fundamentals.magic_rank(m).select("security_id", "rank")


FORWARD = """cal AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM closes WHERE security_id = 0)), ps AS (SELECT security_id, date, close, i, n FROM closes JOIN cal USING (date) WHERE close > 0),
 aw AS (SELECT *, last_value(close) OVER (w RANGE BETWEEN CURRENT ROW AND 21 FOLLOWING) AS l21, last_value(close) OVER (w RANGE BETWEEN CURRENT ROW AND 63 FOLLOWING) AS l63, list(close) OVER (w RANGE BETWEEN CURRENT ROW AND 63 FOLLOWING) AS l FROM ps WINDOW w AS (PARTITION BY security_id ORDER BY i)),
 fw AS MATERIALIZED (SELECT s.security_id, s.date, CASE WHEN e.i + 21 <= e.n THEN e.l21 / e.close - 1 END AS ret_21, CASE WHEN e.i + 63 <= e.n THEN e.l63 / e.close - 1 END AS ret_63, CASE WHEN e.i + 63 <= e.n THEN list_min(list_transform(range(1, len(e.l) + 1), lambda k: e.l[k] / list_max(e.l[1:k]) - 1)) END AS max_drawdown FROM ps s LEFT JOIN aw e ON e.security_id = s.security_id AND e.i = s.i + 1)"""


@query("out_01_forward_returns", "closes", sql=f"WITH {FORWARD} SELECT security_id, date, round(ret_21, 6) AS ret_21, round(ret_63, 6) AS ret_63, round(max_drawdown, 6) AS max_drawdown FROM fw")
def forward_returns(closes):
    out = fundamentals.forward_returns(closes, prices.calendar(closes), [21, 63])
    return out.select("security_id", "date", *(R(F.col(c)).alias(c) for c in ("ret_21", "ret_63", "max_drawdown")))
