"""Queries of series specs, loaders and further series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators, macro, prices, rules, series
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)
LOADED = "SELECT key, date, known_on, round(value, 6) AS value FROM ({}) x"


def _loaded(df):
    return df.select("key", "date", "known_on", R(F.col("value")).alias("value"))


def _prices(closes):
    return closes.select(F.col("security_id").cast("string").alias("ident"), F.col("date").alias("known_on"), F.col("close").alias("value"))


def _vintages(v):
    return series.latest_revision(v).select(F.col("series_id").alias("ident"), F.col("date").alias("known_on"), "value")


#: The sources that the queries of specs and rules know.
SOURCES = series.STANDARD.with_source("px", _prices).with_source("fred", _vintages)
SPECS = ["px:1", "px:2/px:0", "px:3 - px:0|sma:5", "px:0|ret:3|z:10", "fred:click|high:4"]


@query("tsr_01_spec", "closes", sql="""WITH s(spec, source, ident, op, other, chain) AS (VALUES ('px:1', 'px', '1', NULL, NULL, ''), ('px:2/px:0', 'px', '2', '/', 'px:0', ''), ('px:3 - px:0|sma:5', 'px', '3', '-', 'px:0', 'sma:5'), ('px:0|ret:3|z:10', 'px', '0', NULL, NULL, 'ret:3|z:10'), ('fred:click|high:4', 'fred', 'click', NULL, NULL, 'high:4'))
 SELECT spec, source, ident, op, other, chain, (SELECT count(*) FROM closes WHERE source = 'px' AND CAST(security_id AS VARCHAR) = ident) AS days FROM s""")
def spec(closes):
    rows = []
    for s in SPECS:
        found = series.parsed(s, SOURCES)
        first, *rest = found.terms
        rows.append((s, *first, found.operator, ":".join(rest[0]) if rest else None, "|".join(f"{n}:{w}" for n, w in found.transforms)))
    table = closes.sparkSession.createDataFrame(rows, "spec string, source string, ident string, op string, other string, chain string")
    days = closes.groupBy(F.lit("px").alias("source"), F.col("security_id").cast("string").alias("ident")).agg(F.count(F.lit(1)).alias("days"))
    return table.join(days, ["source", "ident"], "left").select("spec", "source", "ident", "op", "other", "chain", F.coalesce("days", F.lit(0)).alias("days"))


@query("tsr_02_build", "closes", "vintages", sql="""WITH days AS MATERIALIZED (SELECT DISTINCT date FROM closes WHERE security_id = 0),
 px AS MATERIALIZED (SELECT d.date, k.ident, p.close AS value FROM days d CROSS JOIN (VALUES (0), (1), (2), (3)) k(ident) ASOF LEFT JOIN closes p ON p.security_id = k.ident AND p.date <= d.date),
 fr AS (SELECT d.date, v.value FROM days d ASOF LEFT JOIN (SELECT date, max_by(value, realtime_start) AS value FROM vintages WHERE series_id = 'click' GROUP BY 1 HAVING arg_max_null(value, realtime_start) IS NOT NULL) v ON v.date <= d.date),
 w AS (SELECT a.date, max(value) FILTER (ident = 0) AS p0, max(value) FILTER (ident = 1) AS p1, max(value) FILTER (ident = 2) AS p2, max(value) FILTER (ident = 3) AS p3 FROM px a GROUP BY 1),
 r AS (SELECT *, p3 - p0 AS d, p0 / nullif(lag(p0, 3) OVER (ORDER BY date), 0) - 1 AS r FROM w),
 z AS (SELECT *, CASE WHEN count(d) OVER v5 = 5 THEN avg(d) OVER v5 END AS s, CASE WHEN count(r) OVER v10 = 10 AND stddev_samp(r) OVER v10 != 0 THEN (r - avg(r) OVER v10) / stddev_samp(r) OVER v10 END AS q FROM r WINDOW v5 AS (ORDER BY date ROWS 4 PRECEDING), v10 AS (ORDER BY date ROWS 9 PRECEDING)),
 f AS (SELECT date, CASE WHEN count(value) OVER v = 4 THEN max(value) OVER v END AS h FROM fr WINDOW v AS (ORDER BY date ROWS 3 PRECEDING)),
 l AS (SELECT 'px:1' AS key, date, p1 AS value FROM z UNION ALL SELECT 'px:2/px:0', date, p2 / nullif(p0, 0) FROM z UNION ALL SELECT 'px:3 - px:0|sma:5', date, s FROM z UNION ALL SELECT 'px:0|ret:3|z:10', date, q FROM z UNION ALL SELECT 'fred:click|high:4', date, h FROM f)
 SELECT key, date, round(value, 6) AS value FROM l WHERE date >= DATE '1996-01-01'""")
def build(closes, v):
    out = series.build(SPECS, {"px": closes, "fred": v}, prices.calendar(closes), SOURCES, start="1996-01-01")
    return out.withColumn("value", R(F.col("value")))


@query("tsr_07_known_growth", "vintages", sql="""WITH days AS (SELECT DISTINCT realtime_start AS day FROM vintages), s AS (SELECT *, lead(realtime_start) OVER (PARTITION BY series_id, date ORDER BY realtime_start) AS until FROM vintages),
 o AS (SELECT series_id, day, date, value FROM s JOIN days ON realtime_start <= day AND (until IS NULL OR day < until)), n AS (SELECT * FROM o WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, day ORDER BY date DESC) = 1)
 SELECT n.series_id, n.day, CASE WHEN n.value > 0 AND b.value > 0 THEN round(ln(n.value / b.value), 6) END AS growth FROM n LEFT JOIN o b ON b.series_id = n.series_id AND b.day = n.day AND b.date = n.date - 7""")
def known_growth(v):
    return series.known_growth(v, v.select(F.col("realtime_start").alias("date")).distinct(), 7).withColumn("growth", R(F.col("growth")))


@query("tsr_10_conditional", "closes", sql="SELECT DISTINCT date, CASE WHEN date >= DATE '1997-10-01' THEN CAST(last_day(date) + 31 AS DATE) ELSE make_date(year(date) + 1, 6, 30) END AS known_on FROM closes WHERE security_id = 0")
def conditional(closes):
    return prices.calendar(closes).select("date", series.conditional_availability(F.col("date"), "1997-10-01").alias("known_on"))


@query("tsr_11_cot", "cot_positions", sql=LOADED.format("""SELECT market || ':' || trader || ':' || field AS key, date, CAST(date + 3 AS DATE) AS known_on, value FROM (UNPIVOT (SELECT market, trader, report_date AS date, CAST(long_side - short_side AS DOUBLE) AS net, CAST(long_side AS DOUBLE) AS long, CAST(short_side AS DOUBLE) AS short, CAST(open_interest AS DOUBLE) AS oi, 100.0::DOUBLE * (long_side - short_side) / nullif(open_interest, 0) AS net_pct_oi,
  CASE WHEN count(*) OVER w >= 52 THEN CASE WHEN max(long_side - short_side) OVER w = min(long_side - short_side) OVER w THEN 50.0::DOUBLE ELSE 100.0::DOUBLE * (long_side - short_side - min(long_side - short_side) OVER w) / (max(long_side - short_side) OVER w - min(long_side - short_side) OVER w) END END AS "index" FROM cot_positions WINDOW w AS (PARTITION BY market, trader ORDER BY report_date ROWS 155 PRECEDING)) ON net, long, short, oi, net_pct_oi, "index" INTO NAME field VALUE value)"""))
def cot(c):
    return _loaded(macro.cot_series(c))


@query("tsr_12_short_interest", "short_interest", sql=LOADED.format("""SELECT security_id || ':' || field AS key, date, (SELECT CAST(max(x) AS DATE) FROM (SELECT x FROM (SELECT date + CAST(i AS INT) AS x FROM range(1, 16) t(i)) WHERE isodow(x) <= 5 ORDER BY x LIMIT 8)) AS known_on, value FROM (UNPIVOT (SELECT security_id, settlement_date AS date, CAST(position AS DOUBLE) AS position, position / nullif(daily_volume, 0)::DOUBLE AS days_to_cover FROM short_interest) ON position, days_to_cover INTO NAME field VALUE value)"""))
def short_interest(s):
    return _loaded(macro.short_interest_series(s))


@query("tsr_13_policy", "obligations", "lobbying_reports", "bills", sql=LOADED.format("""SELECT 'gov:' || substr(naics, 1, 3) AS key, month AS date, CAST(last_day(month) + 90 AS DATE) AS known_on, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM obligations GROUP BY 1, 2, 3
 UNION ALL SELECT 'lobby:' || client || ':count', d, CAST(last_day(d) + 45 AS DATE), count(*) FROM (SELECT client, make_date(year, quarter * 3, 1) AS d FROM (SELECT * FROM lobbying_reports QUALIFY row_number() OVER (PARTITION BY registrant, client, year, quarter ORDER BY posted DESC, id DESC) = 1)) GROUP BY 1, 2, 3
 UNION ALL SELECT 'bills:' || area || ':' || k, CAST(date_trunc('month', d) AS DATE), CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE), count(*) FROM (SELECT area, 'introduced' AS k, introduced AS d FROM bills UNION ALL SELECT area, 'enacted', enacted FROM bills WHERE enacted IS NOT NULL) GROUP BY 1, 2, 3"""))
def policy(o, l, b):
    return _loaded(macro.policy_series(o, l, b))


@query("tsr_14_news", "news", sql=LOADED.format("SELECT topic || ':share' AS key, date, CAST(date + 1 AS DATE) AS known_on, articles * 1e6 / nullif(total, 0) AS value FROM news UNION ALL SELECT topic || ':count', date, CAST(date + 1 AS DATE), articles FROM news"))
def news(n):
    return _loaded(macro.news_series(n))


@query("tsr_15_credit", "statement_items", sql=LOADED.format("""WITH q AS (SELECT cik AS key, period_end AS date, floor(value) AS level, 50 + CAST(floor(value) AS BIGINT) % 100 AS ratio FROM statement_items), l AS (SELECT *, lag(level, 4) OVER w AS l4, lag(level, 8) OVER w AS l8, lag(date, 8) OVER w AS d8 FROM q WINDOW w AS (PARTITION BY key ORDER BY date))
 SELECT key || ':impulse' AS key, date, CAST(date + 170 AS DATE) AS known_on, CASE WHEN datediff('day', d8, date) <= 750 THEN ((level - l4) - (l4 - l8)) / (level / (ratio / 100.0::DOUBLE)) * 100 END AS value FROM l"""))
def credit(s):
    rows = s.select(F.col("cik").alias("key"), F.col("period_end").alias("date"), F.floor("value").cast("double").alias("level"), (50 + F.floor("value").cast("long") % 100).alias("ratio"))
    impulse = macro.credit_impulse(rows)
    return _loaded(series.lagged(impulse, F.concat(F.col("key").cast("string"), F.lit(":impulse")), F.col("date"), F.col("impulse"), F.date_add("date", 170)))


@query("tsr_16_exact", "series", "closes", sql="SELECT key, date, round(value, 6) AS value FROM series WHERE date IN (SELECT date FROM closes WHERE security_id = 0)")
def exact(s, closes):
    return series.exact(s, prices.calendar(closes)).withColumn("value", R(F.col("value")))


@query("tsr_17_next_day", "series", "closes", sql="WITH d AS (SELECT date, lag(date) OVER (ORDER BY date) AS b FROM (SELECT DISTINCT date FROM closes WHERE security_id = 0)) SELECT key, d.date, round(value, 6) AS value FROM d JOIN series s ON s.date = d.b")
def next_day(s, closes):
    return series.exact(s, prices.calendar(closes), shift=1).withColumn("value", R(F.col("value")))


@query("tsr_18_aliased", "vintages", sql=LOADED.format("WITH a(alias, id, lag) AS (VALUES ('oil', 'click', 5), ('gas', 'view', 7)), v AS (SELECT series_id, date, arg_max_null(value, realtime_start) AS value FROM vintages GROUP BY 1, 2) SELECT alias AS key, date, CAST(date + lag AS DATE) AS known_on, value FROM v JOIN a ON id = series_id"))
def aliased(v):
    return _loaded(macro.aliased_series(series.latest_revision(v), {"oil": ("click", 5), "gas": ("view", 7)}))


@query("tsr_22_deflate", "series", "statement_items", sql="""WITH i AS (SELECT period_end AS date, max(value) AS v FROM statement_items GROUP BY 1) SELECT key, s.date, round(value / nullif(v, 0) * 1000000, 5) AS value FROM series s ASOF LEFT JOIN i ON i.date <= s.date""")
def deflate(s, items):
    index = items.groupBy(F.col("period_end").alias("date")).agg(F.max("value").alias("value"))
    return series.deflate(s, index).withColumn("value", R(F.col("value") * 1000000, 5))


@query("tsr_23_observations", "series", sql="SELECT key, date, round(value, 6) AS value FROM series WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def observations(s):
    return series.observations(s, "1997-01-01", "1998-06-30").withColumn("value", R(F.col("value")))


@query("ind_13_basket", "series", sql="""WITH m(basket, key) AS (SELECT key % 2, key FROM (SELECT DISTINCT key FROM series WHERE key BETWEEN 1 AND 6)), n AS (SELECT basket, count(*) AS n FROM m GROUP BY 1), g AS (SELECT basket, date, avg(ln(value)) AS level, count(*) AS k FROM series JOIN m USING (key) WHERE value > 0 GROUP BY 1, 2)
 SELECT basket, date, CASE WHEN k = n THEN round(level, 6) END AS level FROM g JOIN n USING (basket)""")
def basket(s):
    members = s.where("key BETWEEN 1 AND 6").select((F.col("key") % 2).alias("basket"), "key").distinct()
    return indicators.basket_log_level(s, members).withColumn("level", R(F.col("level")))


@query("sta_02_expanding_rank", "vintages", sql="""WITH s AS (SELECT series_id AS key, date, arg_max_null(value, realtime_start) AS value FROM vintages GROUP BY 1, 2), l AS (SELECT *, list(value) FILTER (value IS NOT NULL) OVER (PARTITION BY key ORDER BY date) AS l FROM s)
 SELECT key, date, CASE WHEN value IS NOT NULL AND len(l) >= 20 THEN round(len(list_filter(l, lambda x: x <= value)) / len(l)::DOUBLE, 6) END AS rank FROM l""")
def expanding_rank(v):
    rows = series.latest_revision(v).select(F.col("series_id").alias("key"), "date", "value")
    return indicators.expanding_rank(rows).select("key", "date", R(F.col("rank")).alias("rank"))


@query("sta_05_filter_gap", "statement_items", sql="""WITH RECURSIVE x AS (SELECT cik AS key, period_end AS date, ln(value) AS v, row_number() OVER (PARTITION BY cik ORDER BY period_end) - 1 AS i FROM statement_items WHERE value IS NOT NULL),
 g(i, p, q, a, b, c) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT i + 1, p2, q2, p2 / (p2 + 1), q2 / (p2 + 1), a - q2 * q2 / (p2 + 1) FROM (SELECT i, a, 4 * a - 4 * b + c + 1 / 1600.0::DOUBLE AS p2, 2 * a - b AS q2 FROM g WHERE i < (SELECT max(i) FROM x))),
 f AS (SELECT key, i, v AS level, v AS before FROM x WHERE i = 0 UNION ALL SELECT x.key, x.i, CASE WHEN x.i = 1 THEN x.v ELSE 2 * level - before + g.a * (x.v - 2 * level + before) END, CASE WHEN x.i = 1 THEN f.level ELSE level + g.b * (x.v - 2 * level + before) END FROM f JOIN x ON x.key = f.key AND x.i = f.i + 1 JOIN g ON g.i = x.i)
 SELECT key, date, CASE WHEN i >= 14 THEN round(v - level, 8) END AS gap FROM f JOIN x USING (key, i)""")
def filter_gap(s):
    rows = s.select(F.col("cik").alias("key"), F.col("period_end").alias("date"), F.log("value").alias("value"))
    return indicators.one_sided_gap(rows, 1600.0).withColumn("gap", R(F.col("gap"), 8))


RULES = {"trend": ("1", "px:1 > px:1|sma:20 and px:2 / px:0 > 0.9"), "mixed": ("2", "px:2|ret:5 < 0 or fred:click|z:10 >= 1 and px:0 - px:3 < 100.5")}


@query("bkt_01_spec_rules", "closes", "vintages", sql="""WITH days AS MATERIALIZED (SELECT DISTINCT date FROM closes WHERE security_id = 0),
 px AS MATERIALIZED (SELECT d.date, k.ident, p.close AS value FROM days d CROSS JOIN (VALUES (0), (1), (2), (3)) k(ident) ASOF LEFT JOIN closes p ON p.security_id = k.ident AND p.date <= d.date),
 fr AS (SELECT d.date, v.value AS f FROM days d ASOF LEFT JOIN (SELECT date, max_by(value, realtime_start) AS value FROM vintages WHERE series_id = 'click' GROUP BY 1 HAVING arg_max_null(value, realtime_start) IS NOT NULL) v ON v.date <= d.date),
 w AS (SELECT a.date, max(value) FILTER (ident = 0) AS p0, max(value) FILTER (ident = 1) AS p1, max(value) FILTER (ident = 2) AS p2, max(value) FILTER (ident = 3) AS p3, max(f) AS f FROM px a JOIN fr USING (date) GROUP BY 1),
 i AS MATERIALIZED (SELECT *, CASE WHEN count(p1) OVER v20 = 20 THEN avg(p1) OVER v20 END AS sma, p2 / nullif(lag(p2, 5) OVER o, 0) - 1 AS r5, CASE WHEN count(f) OVER v10 = 10 AND stddev_samp(f) OVER v10 != 0 THEN (f - avg(f) OVER v10) / stddev_samp(f) OVER v10 END AS z FROM w WINDOW o AS (ORDER BY date), v20 AS (ORDER BY date ROWS 19 PRECEDING), v10 AS (ORDER BY date ROWS 9 PRECEDING)),
 s AS (SELECT 'trend' AS rule, date, p1 AS px, p1 > sma AND p2 / nullif(p0, 0) > 0.9 AS signal, p1 + sma + p2 / nullif(p0, 0) IS NOT NULL AS known FROM i UNION ALL SELECT 'mixed', date, p2, r5 < 0 OR (z >= 1 AND p0 - p3 < 100.5), r5 + z + p0 + p3 IS NOT NULL FROM i),
 b AS (SELECT *, min(date) FILTER (known AND px IS NOT NULL AND signal IS NOT NULL) OVER (PARTITION BY rule) AS start FROM s),
 t AS (SELECT *, coalesce(px / nullif(lag(px) OVER w, 0) - 1, 0) AS bench, coalesce(lag(CASE WHEN signal THEN 1.0::DOUBLE ELSE 0 END) OVER w, 0) AS position FROM b WHERE date >= start WINDOW w AS (PARTITION BY rule ORDER BY date)),
 r AS (SELECT *, position * bench - abs(position - coalesce(lag(position) OVER (PARTITION BY rule ORDER BY date), 0)) * 5 / 10000 AS ret FROM t)
 SELECT rule, date, signal, position, round(ret, 6) AS ret FROM r WHERE date > start""")
def spec_rules(closes, v):
    out = rules.run(RULES, {"px": closes, "fred": v}, prices.calendar(closes), SOURCES)
    return out.select(F.col("security_id").alias("rule"), "date", "signal", "position", R(F.col("ret")).alias("ret"))
