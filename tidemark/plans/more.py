"""Queries of macro panels, the timeline and further price, portfolio, screen and statistics operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import breadth, fundamentals, identity, macro, portfolio, prices, statistics
from tidemark.plans.companies import FORWARD
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)
DAY = lambda d: F.lit(d).cast("date")


def _quarters(s):
    return s.select(F.col("cik").alias("key"), F.col("period_end").alias("date"), F.floor("value").cast("double").alias("level"), (50 + F.floor("value").cast("long") % 100).alias("ratio"))


@query("mac_01_credit_impulse", "statement_items", sql="""WITH q AS (SELECT cik AS key, period_end AS date, floor(value) AS level, 50 + CAST(floor(value) AS BIGINT) % 100 AS ratio FROM statement_items), l AS (SELECT *, lag(level, 4) OVER w AS l4, lag(level, 8) OVER w AS l8, lag(date, 8) OVER w AS d8 FROM q WINDOW w AS (PARTITION BY key ORDER BY date))
 SELECT key, date, CASE WHEN datediff('day', d8, date) <= 750 THEN round(((level - l4) - (l4 - l8)) / (level / (ratio / 100.0::DOUBLE)) * 100, 6) END AS impulse FROM l""")
def credit_impulse(s):
    return macro.credit_impulse(_quarters(s)).withColumn("impulse", R(F.col("impulse")))


@query("mac_09_episodes", "statement_items", sql="WITH q AS (SELECT cik AS key, period_end AS date, CAST(floor(value) AS BIGINT) % 100 > 40 AS c FROM statement_items), l AS (SELECT *, lag(c, 1, false) OVER (PARTITION BY key ORDER BY date) AS b FROM q) SELECT key, date FROM l WHERE c AND NOT b")
def episodes(s):
    return macro.episodes(_quarters(s), F.col("ratio") > 90).select("key", "date")


@query("mac_08_condition_rates", "statement_items", sql="WITH q AS (SELECT cik % 7 AS key, CAST(floor(value) AS BIGINT) % 100 > 40 AS c, CAST(floor(value) AS BIGINT) % 3 = 0 AS o FROM statement_items) SELECT key, round(avg(CASE WHEN c THEN o::INT::DOUBLE END), 6) AS inside, round(avg(o::INT::DOUBLE), 6) AS base, count(*) FILTER (c) AS n, round(avg(CASE WHEN c THEN o::INT::DOUBLE END) / nullif(avg(o::INT::DOUBLE), 0), 6) AS ratio FROM q GROUP BY 1")
def condition_rates(s):
    rows = _quarters(s).select((F.col("key") % 7).alias("key"), "ratio", (F.col("level").cast("long") % 3 == 0).alias("o"))
    out = macro.condition_rates(rows, F.col("ratio") > 90, "o")
    return out.select("key", R(F.col("inside")).alias("inside"), R(F.col("base")).alias("base"), "n", R(F.col("ratio")).alias("ratio"))


@query("mac_05_event_within", "statement_items", sql="""WITH q AS (SELECT cik AS key, period_end AS date, CAST(floor(value) AS BIGINT) % 100 > 70 AS e FROM statement_items), s AS (SELECT *, CASE WHEN e AND NOT coalesce(lag(e) OVER (PARTITION BY key ORDER BY date), e) THEN 1 ELSE 0 END AS st FROM q)
 SELECT key, date, CASE WHEN max(st) OVER a = 1 THEN true WHEN count(st) OVER a = 4 THEN false END AS within FROM s WINDOW a AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def event_within(s):
    rows = _quarters(s).withColumn("e", F.col("ratio") > 120)
    return macro.event_within(rows, "e", 4).select("key", "date", "within")


@query("mac_10_panel", "statement_items", sql="SELECT cik AS key, CAST(year(period_end) AS INT) AS year, max(value) FILTER (quarter(period_end) = 1) AS q1, max(value) FILTER (quarter(period_end) = 2) AS q2, max(value) FILTER (quarter(period_end) = 3) AS q3, max(value) FILTER (quarter(period_end) = 4) AS q4 FROM statement_items GROUP BY 1, 2")
def panel(s):
    rows = s.select(F.col("cik").alias("key"), F.concat(F.lit("q"), F.quarter("period_end")).alias("variable"), F.year("period_end").alias("year"), "value")
    return macro.pivot_panel(rows, ["q1", "q2", "q3", "q4"])


@query("tml_01_timeline", "insider_transactions", "actions", sql="""WITH e AS (SELECT filing_date AS date, 'insider' AS kind, trans_code AS title, issuer_cik AS entity, round(shares * price, 2) AS amount, CAST(id AS VARCHAR) AS ref FROM insider_transactions WHERE shares * price >= 10000
  UNION ALL SELECT ex_date, action, source, security_id, value, security_id || ':' || action FROM actions) SELECT * FROM e WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' QUALIFY row_number() OVER (PARTITION BY kind ORDER BY date DESC, ref) <= 100""")
def timeline(t, a):
    trades = t.where("shares * price >= 10000").select(F.col("filing_date").alias("date"), F.lit("insider").alias("kind"), F.col("trans_code").alias("title"), F.col("issuer_cik").alias("entity"), R(F.col("shares") * F.col("price"), 2).alias("amount"), F.col("id").cast("string").alias("ref"))
    acts = a.select(F.col("ex_date").alias("date"), F.col("action").alias("kind"), F.col("source").alias("title"), F.col("security_id").alias("entity"), F.col("value").alias("amount"), F.concat_ws(":", F.col("security_id").cast("string"), "action").alias("ref"))
    return macro.timeline([trades, acts], DAY("1998-01-01"), DAY("1999-12-31"), 100)


@query("ptf_09_context", "closes", sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS n FROM closes), g AS (SELECT security_id, max(close) FILTER (n = 1) AS close, max(close) FILTER (n <= 252) AS high, min(close) FILTER (n <= 252) AS low, avg(close) FILTER (n <= 200) AS m, max(close) FILTER (n = 22) AS c21, max(close) FILTER (n = 64) AS c63 FROM r GROUP BY 1)
 SELECT security_id, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, round(close / high - 1, 6) AS drawdown, round(close / m - 1, 6) AS from_mean, round(close / c21 - 1, 6) AS ret_1m, round(close / c63 - 1, 6) AS ret_3m FROM g""")
def context(closes):
    out = portfolio.context(closes, {"ret_1m": 21, "ret_3m": 63})
    return out.select("security_id", *(R(F.col(c)).alias(c) for c in out.columns[1:]))


@query("ptf_10_tracking", "closes", "securities", sql="""WITH l AS (SELECT security_id FROM closes GROUP BY 1 HAVING avg(close * volume) >= 1000 AND count(*) >= 0.02 * (SELECT count(DISTINCT date) FROM closes)), f AS (SELECT security_id FROM securities SEMI JOIN l USING (security_id) WHERE security_type = 'ETF'), r AS (SELECT security_id, date, close / lag(close) OVER (PARTITION BY security_id ORDER BY date) - 1 AS r FROM closes), p AS (SELECT a.security_id AS held, b.security_id AS fund, a.r AS x, b.r AS y FROM r a JOIN r b USING (date) WHERE b.security_id IN (SELECT security_id FROM f) AND a.security_id != b.security_id AND a.r IS NOT NULL AND b.r IS NOT NULL)
 SELECT held, fund, count(*) AS n, round(corr(x, y), 6) AS corr, round(covar_samp(x, y) / var_samp(y), 6) AS beta, round(stddev_samp(x - y) * sqrt(252), 5) AS error FROM p GROUP BY 1, 2 HAVING count(*) >= 60 AND stddev_samp(x - y) * sqrt(252) < 100000""")
def tracking(closes, securities):
    by = W.partitionBy("security_id").orderBy("date")
    rets = closes.select("security_id", "date", (F.col("close") / F.lag("close").over(by) - 1).alias("ret"))
    funds = portfolio.liquid(securities.where("security_type = 'ETF'").select("security_id"), closes, 1000, 0.02)
    out = portfolio.tracking(rets, funds, 60, 100_000.0)
    return out.select("held", "fund", "n", R(F.col("corr")).alias("corr"), R(F.col("beta")).alias("beta"), R(F.col("error"), 5).alias("error"))


@query("prc_10_median_prices", "positions", sql="SELECT cusip, period, round(median(value / shares), 6) AS price, count(DISTINCT filer_cik) AS filers, CAST(sum(CAST(shares AS DECIMAL(18, 2))) AS DOUBLE) AS shares, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM positions WHERE put_call = '' AND shares > 0 GROUP BY 1, 2")
def median_prices(p):
    return prices.median_prices(p).withColumn("price", R(F.col("price")))


@query("prc_12_quarter_returns", "positions", sql="""WITH m AS (SELECT cusip, period, median(value / shares) AS price, CAST(sum(CAST(shares AS DECIMAL(18, 2))) AS DOUBLE) AS shares FROM positions WHERE put_call = '' AND shares > 0 GROUP BY 1, 2), l AS (SELECT *, lead(price) OVER w AS p, lead(shares) OVER w / shares AS r, lead(period) OVER w AS nx FROM m WINDOW w AS (PARTITION BY cusip ORDER BY period)),
 s AS (SELECT *, CASE WHEN round(r) >= 2 AND abs(r / round(r) - 1) <= 0.1 AND abs(ln(p / price * r)) <= 0.15 THEN round(r) ELSE 1 END AS split FROM l WHERE nx = last_day(period + INTERVAL 3 MONTH)) SELECT cusip, period, split::DOUBLE AS split, CASE WHEN p * split / price - 1 <= 3 THEN round(p * split / price - 1, 6) END AS ret FROM s""")
def quarter_returns(p):
    return prices.quarter_returns(prices.median_prices(p)).withColumn("ret", R(F.col("ret")))


@query("prc_13_rates", "vintages", sql="SELECT series_id AS currency, round(CASE WHEN series_id IN ('click', 'view') THEN 1 / max_by(value, (date, realtime_start)) ELSE max_by(value, (date, realtime_start)) END, 6) AS rate FROM vintages WHERE date <= DATE '2024-01-20' AND value IS NOT NULL GROUP BY 1")
def rates(v):
    rows = v.select(F.col("series_id").alias("currency"), F.struct("date", "realtime_start").alias("at"), "date", "value")
    last = rows.groupBy("currency", "date").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("value"))
    return prices.latest_rates(last, DAY("2024-01-20"), ["click", "view"]).withColumn("rate", R(F.col("rate")))


@query("scr_01_filter", "securities", "closes", sql=f"""WITH m AS (SELECT security_id, round(avg(close), 6) AS price, round(stddev_samp(close) / avg(close), 6) AS spread FROM closes GROUP BY 1) SELECT security_id, price, spread FROM m JOIN securities USING (security_id) WHERE price > 200 AND spread < 5 AND NOT coalesce(sic BETWEEN 6000 AND 6799, false) ORDER BY spread NULLS LAST, security_id LIMIT 40""")
def filter_screen(s, closes):
    m = closes.groupBy("security_id").agg(R(F.avg("close")).alias("price"), R(F.stddev_samp("close") / F.avg("close")).alias("spread"))
    sector = breadth.sector(F.col("sic"))
    rows = m.join(s, "security_id").where((F.col("price") > 200) & (F.col("spread") < 5) & F.coalesce(sector != "finance", F.lit(True)))
    return rows.orderBy(F.asc_nulls_last("spread"), "security_id").limit(40).select("security_id", "price", "spread")


@query("out_02_excess", "closes", "securities", sql=f"""WITH {FORWARD}, m AS (SELECT security_id, date, ret_21, median(ret_21) OVER (PARTITION BY date) AS u, median(ret_21) OVER (PARTITION BY date, cik % 3) AS s, count(ret_21) OVER (PARTITION BY date, cik % 3) AS n FROM fw JOIN securities USING (security_id) WHERE ret_21 IS NOT NULL)
 SELECT security_id, date, round(ret_21 - u, 6) AS over_universe, CASE WHEN n >= 2 THEN round(ret_21 - s, 6) END AS over_sector FROM m""")
def excess(closes, s):
    outcomes = fundamentals.forward_returns(closes, prices.calendar(closes), [21]).join(s.select("security_id", (F.col("cik") % 3).alias("sector")), "security_id")
    out = fundamentals.over_peers(outcomes, "ret_21", "sector")
    return out.select("security_id", "date", R(F.col("over_universe")).alias("over_universe"), R(F.col("over_sector")).alias("over_sector"))


@query("sts_21_calendar_time", "closes", sql="""WITH r AS (SELECT security_id % 3 AS g, date_trunc('month', date)::DATE AS period, close / lag(close) OVER (PARTITION BY security_id ORDER BY date) - 1 AS x FROM closes), m AS (SELECT g, period, avg(x) AS m FROM r WHERE x IS NOT NULL GROUP BY 1, 2)
 SELECT g AS "group", count(*) AS periods, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(avg((m > 0)::INT::DOUBLE), 6) AS hit_rate FROM m GROUP BY 1""")
def calendar_time(closes):
    by = W.partitionBy("security_id").orderBy("date")
    rows = closes.select((F.col("security_id") % 3).alias("group"), F.trunc("date", "month").alias("period"), (F.col("close") / F.lag("close").over(by) - 1).alias("excess")).where("excess IS NOT NULL")
    out = statistics.calendar_time(rows)
    return out.select("group", "periods", *(R(F.col(c)).alias(c) for c in ("mean", "median", "hit_rate")))


@query("sts_02_slope", "closes", sql="WITH b AS (SELECT date, close AS x FROM closes WHERE security_id = 0) SELECT security_id AS key, count(*) AS n, round(regr_slope(close, x), 6) AS slope, round(regr_intercept(close, x), 4) AS intercept FROM closes JOIN b USING (date) WHERE security_id != 0 GROUP BY 1 HAVING count(*) >= 10")
def slope(closes):
    b = closes.where("security_id = 0").select("date", F.col("close").alias("x"))
    out = statistics.hac_slope(closes.where("security_id != 0").join(b, "date").select(F.col("security_id").alias("key"), "date", "x", F.col("close").alias("y")))
    return out.select("key", "n", R(F.col("slope")).alias("slope"), R(F.col("intercept"), 4).alias("intercept"))


@query("sts_25_expanding_gap", "closes", sql="""WITH b AS (SELECT date, close AS x FROM closes WHERE security_id = 0), j AS (SELECT security_id AS key, date, x, close AS y FROM closes JOIN b USING (date) WHERE security_id != 0)
 SELECT key, date, CASE WHEN count(x) OVER w >= 20 THEN round(y - (regr_intercept(y, x) OVER w + regr_slope(y, x) OVER w * x), 4) END AS gap, round(lead(y, 4) OVER (PARTITION BY key ORDER BY date) - y, 8) AS ahead FROM j WINDOW w AS (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def expanding_gap(closes):
    b = closes.where("security_id = 0").select("date", F.col("close").alias("x"))
    rows = closes.where("security_id != 0").join(b, "date").select(F.col("security_id").alias("key"), "date", "x", F.col("close").alias("y"))
    return statistics.expanding_gap(rows).select("key", "date", R(F.col("gap"), 4).alias("gap"), R(F.col("ahead"), 8).alias("ahead"))


@query("idn_15_group_fallback", "positions", sql="""WITH c AS (SELECT DISTINCT right(cusip, 3) AS code FROM positions), v AS (SELECT code, CAST(code AS DOUBLE) AS value FROM c WHERE CAST(code AS INT) % 7 = 0 AND CAST(code AS INT) < 150)
 SELECT c.code, round(coalesce(v.value, g3.m, g2.m), 6) AS value, CASE WHEN v.value IS NOT NULL THEN 0 WHEN g3.m IS NOT NULL THEN 3 WHEN g2.m IS NOT NULL THEN 2 END AS level FROM c LEFT JOIN v USING (code) LEFT JOIN (SELECT substr(code, 1, 3) AS g, avg(value) AS m FROM v GROUP BY 1) g3 ON g3.g = substr(c.code, 1, 3) LEFT JOIN (SELECT substr(code, 1, 2) AS g, avg(value) AS m FROM v GROUP BY 1) g2 ON g2.g = substr(c.code, 1, 2)""")
def group_fallback(p):
    c = p.select(F.right("cusip", F.lit(3)).alias("code")).distinct()
    v = c.where("cast(code as int) % 7 = 0 AND cast(code as int) < 150").withColumn("value", F.col("code").cast("double"))
    return identity.group_fallback(c, v).withColumn("value", R(F.col("value")))


@query("idn_12_interval_members", "insider_transactions", sql="""WITH r AS (SELECT CAST(id AS VARCHAR) AS doc_id, issuer_cik % 20 AS district, filing_date AS filed FROM insider_transactions), t AS (SELECT DISTINCT owner_cik AS member, owner_cik % 20 AS district, date_trunc('year', trans_date)::DATE AS start, (date_trunc('year', trans_date) + INTERVAL 2 MONTH)::DATE AS e FROM insider_transactions WHERE owner_cik < 20 OR year(trans_date) % 2 = 0)
 SELECT doc_id, min(member) AS member FROM r JOIN t USING (district) WHERE filed >= start AND filed <= e + 120 GROUP BY 1 HAVING count(DISTINCT member) = 1""")
def interval_members(t):
    reports = t.select(F.col("id").cast("string").alias("doc_id"), (F.col("issuer_cik") % 20).alias("district"), F.col("filing_date").alias("filed"))
    year = F.trunc("trans_date", "year")
    terms = t.where("owner_cik < 20 OR year(trans_date) % 2 = 0").select(F.col("owner_cik").alias("member"), (F.col("owner_cik") % 20).alias("district"), year.alias("start"), F.add_months(year, 2).alias("end")).distinct()
    return identity.interval_members(reports, terms)


LAST = "CASE owner_cik % 5 WHEN 0 THEN 'Van Dam' WHEN 1 THEN 'Núñez' ELSE 'Name' || chr(CAST(97 + owner_cik % 7 AS INT)) END"
MEMBERS = f"""rp AS (SELECT CAST(id AS VARCHAR) AS doc_id, CASE WHEN id % 3 = 0 THEN 'senate' ELSE 'house' END AS chamber, CASE WHEN id % 4 != 1 THEN 'CA' || CASE WHEN issuer_cik % 20 = 0 THEN 'AL' ELSE CAST(issuer_cik % 20 AS VARCHAR) END END AS state, 'Hon. ' || CASE WHEN id % 7 < 5 THEN chr(CAST(97 + owner_cik % 3 AS INT)) || 'ob ' ELSE '' END || {LAST} || ' Jr' AS name, filing_date AS day FROM insider_transactions),
 tm AS (SELECT DISTINCT owner_cik AS member, CASE WHEN owner_cik % 4 = 3 THEN 'senate' ELSE 'house' END AS chamber, owner_cik % 20 AS district, {LAST} AS last, chr(CAST(97 + owner_cik % 3 AS INT)) || 'ob' AS first, date_trunc('year', trans_date)::DATE AS start, (date_trunc('year', trans_date) + INTERVAL 2 MONTH)::DATE AS e FROM insider_transactions WHERE owner_cik < 20 OR year(trans_date) % 2 = 0),
 wd AS (SELECT rp.doc_id, rp.state, rp.chamber, tm.member, tm.district, CASE WHEN state LIKE 'CA%' AND rp.chamber = 'house' THEN CASE WHEN state = 'CAAL' THEN 0 ELSE CAST(substr(state, 3) AS INT) END END AS seat, contains(strip_accents(lower(name)) || ' ', ' ' || strip_accents(lower(last)) || ' ') AS named, contains(lower(name), lower(first) || ' ') AS given FROM rp JOIN tm ON tm.chamber = rp.chamber AND day BETWEEN start AND e + 120),
 se AS (SELECT doc_id, CASE WHEN count(DISTINCT member) = 1 THEN min(member) WHEN count(DISTINCT member) FILTER (named) = 1 THEN min(member) FILTER (named) END AS m FROM wd WHERE seat = district GROUP BY 1), na AS (SELECT doc_id, CASE WHEN count(DISTINCT member) = 1 THEN min(member) WHEN count(DISTINCT member) FILTER (given) = 1 THEN min(member) FILTER (given) END AS m FROM wd WHERE named GROUP BY 1)"""


@query("idn_12_links", "insider_transactions", sql=f"WITH {MEMBERS} SELECT rp.doc_id, coalesce(se.m, na.m) AS member, CASE WHEN se.m IS NOT NULL THEN 'district' ELSE 'name' END AS method FROM rp LEFT JOIN se USING (doc_id) LEFT JOIN na USING (doc_id) WHERE coalesce(se.m, na.m) IS NOT NULL")
def member_links(t):
    owner, seat = F.col("owner_cik"), F.col("issuer_cik") % 20
    letter = lambda n: F.char((97 + owner % n).cast("int"))
    last = F.when(owner % 5 == 0, "Van Dam").when(owner % 5 == 1, "Núñez").otherwise(F.concat(F.lit("Name"), letter(7)))
    first = F.concat(letter(3), F.lit("ob"))
    state = F.when(F.col("id") % 4 != 1, F.concat(F.lit("CA"), F.when(seat == 0, "AL").otherwise(seat.cast("string"))))
    name = F.concat(F.lit("Hon. "), F.when(F.col("id") % 7 < 5, F.concat(first, F.lit(" "))).otherwise(""), last, F.lit(" Jr"))
    reports = t.select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 3 == 0, "senate").otherwise("house").alias("chamber"), state.alias("state"), name.alias("name"), F.col("filing_date").alias("filed"), F.lit(None).cast("int").alias("year"))
    year = F.trunc("trans_date", "year")
    terms = t.where("owner_cik < 20 OR year(trans_date) % 2 = 0").select(owner.alias("member"), F.when(owner % 4 == 3, "senate").otherwise("house").alias("chamber"), F.lit("CA").alias("state"), (owner % 20).alias("district"), last.alias("last"), first.alias("first"), F.lit(None).cast("string").alias("nickname"), year.alias("start"), F.add_months(year, 2).alias("end")).distinct()
    return identity.member_links(reports, terms)


@query("met_02_latest_balance", "statement_items", sql="SELECT cik, max(period_end) AS period_end, max_by(value, period_end) AS value FROM statement_items WHERE filed <= DATE '1999-12-31' AND period_end <= DATE '1999-12-31' GROUP BY 1 HAVING datediff('day', max(period_end), DATE '1999-12-31') <= 400")
def latest_balance(s):
    known = s.where("filed <= '1999-12-31' AND period_end <= '1999-12-31'").groupBy("cik").agg(F.max("period_end").alias("period_end"), F.max_by("value", "period_end").alias("value"))
    return known.where(F.datediff(DAY("1999-12-31"), "period_end") <= 400)
