"""Queries of prices, indicators and breadth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import breadth, indicators, prices
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)

FACTORS = """
lastbar AS (SELECT security_id, max(date) AS last FROM closes GROUP BY 1),
fac AS (SELECT a.security_id, a.ex_date, a.action, CASE WHEN a.action = 'split' THEN 1 / a.value ELSE coalesce(1 - a.value / (SELECT max_by(c.close, c.date) FROM closes c WHERE c.security_id = a.security_id AND c.date < a.ex_date), 1) END AS pf,
  CASE WHEN a.action = 'split' THEN a.value ELSE 1 END AS vf FROM actions a JOIN lastbar l ON l.security_id = a.security_id AND a.ex_date <= l.last),
adj AS (SELECT c.security_id, c.date, c.close, c.volume, coalesce(product(f.pf), 1) AS pf, coalesce(product(f.vf), 1) AS vf FROM closes c LEFT JOIN fac f ON f.security_id = c.security_id AND f.ex_date > c.date GROUP BY 1, 2, 3, 4)
"""


@query("prc_01_adjusted", "closes", "actions", sql=f"WITH {FACTORS} SELECT security_id, date, round(pf, 6) AS price_factor, round(vf, 6) AS volume_factor, round(close * pf, 6) AS adj_close, round(volume * vf, 6) AS adj_volume FROM adj")
def adjusted(closes, actions):
    out = prices.adjust(closes, actions)
    return out.select("security_id", "date", *(R(F.col(c)).alias(c) for c in ("price_factor", "volume_factor", "adj_close", "adj_volume")))


@query("prc_03_source_merge", "bars", sql="""SELECT security_id, date, source, close, volume FROM (SELECT *, min(date) OVER (PARTITION BY security_id, source) AS since FROM bars)
 QUALIFY row_number() OVER (PARTITION BY security_id, date ORDER BY since, source) = 1""")
def source_merge(bars):
    return prices.merge_sources(bars).select("security_id", "date", "source", "close", "volume")


@query("prc_04_jump_cut", "closes", "actions", sql="""WITH scaled AS (SELECT security_id, date, CASE WHEN year(date) < 1998 AND security_id % 3 = 0 THEN close / 100 ELSE close END AS close FROM closes),
w AS (SELECT *, lag(close) OVER o AS b, quantile_cont(close, 0.5) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead, count(close) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n,
 quantile_cont(close, 0.5) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS behind FROM scaled WINDOW o AS (PARTITION BY security_id ORDER BY date)),
x AS (SELECT DISTINCT security_id, CAST(ex_date + CAST(i AS INT) AS DATE) AS date FROM actions, range(-7, 8) t(i) WHERE action = 'split'), j AS (SELECT security_id, max(date) AS f FROM w ANTI JOIN x USING (security_id, date) WHERE close >= 1 AND close >= 4 * b AND n = 5 AND ahead >= 4 * behind GROUP BY 1)
SELECT s.security_id, s.date, round(s.close, 6) AS close FROM scaled s LEFT JOIN j USING (security_id) WHERE f IS NULL OR s.date >= f""")
def jump_cut(closes, actions):
    scaled = closes.withColumn("close", F.when((F.year("date") < 1998) & (F.col("security_id") % 3 == 0), F.col("close") / 100).otherwise(F.col("close")))
    return prices.cut_jumps(scaled.select("security_id", "date", "close"), actions).select("security_id", "date", R(F.col("close")).alias("close"))


@query("prc_05_calendar_series", "closes", sql="SELECT s.security_id, d.date, round(c.close, 6) AS value FROM (SELECT DISTINCT security_id FROM closes) s CROSS JOIN (SELECT DISTINCT date FROM closes WHERE security_id = 0) d LEFT JOIN closes c ON c.security_id = s.security_id AND c.date = d.date")
def calendar_series(closes):
    return prices.on_calendar(closes, prices.calendar(closes), "close").withColumn("value", R(F.col("value")))


@query("prc_06_calendar", "closes", sql="SELECT DISTINCT date FROM closes WHERE security_id = 0")
def calendar(closes):
    return prices.calendar(closes)


@query("prc_07_latest_close", "closes", sql="SELECT security_id, max(date) AS date, round(max_by(close, date), 6) AS close FROM closes WHERE date <= DATE '1999-06-30' AND date >= DATE '1999-06-20' GROUP BY 1")
def latest_close(closes):
    return prices.latest_close(closes, F.lit("1999-06-30").cast("date")).withColumn("close", R(F.col("close")))


@query("prc_09_split_factor", "securities", "actions", sql="""WITH p AS (SELECT security_id, DATE '1999-01-01' AS lo, DATE '1997-01-01' AS hi FROM securities UNION ALL SELECT security_id, DATE '1996-01-01', DATE '1999-12-31' FROM securities)
 SELECT p.security_id, lo, hi, CASE WHEN lo <= hi THEN coalesce(product(a.value), 1) ELSE 1 / coalesce(product(a.value), 1) END AS factor FROM p LEFT JOIN actions a ON a.action = 'split' AND a.security_id = p.security_id AND a.ex_date > least(lo, hi) AND a.ex_date <= greatest(lo, hi) GROUP BY 1, 2, 3""")
def split_factor(securities, actions):
    day = lambda d: F.lit(d).cast("date")
    pairs = securities.select("security_id", day("1999-01-01").alias("lo"), day("1997-01-01").alias("hi")).unionByName(securities.select("security_id", day("1996-01-01").alias("lo"), day("1999-12-31").alias("hi")))
    return prices.split_factor(pairs, actions).withColumn("factor", R(F.col("factor"), 9))


BREADTH_SQL = f"""WITH sp AS (SELECT c.security_id, c.date, c.close, c.volume, coalesce(product(a.value), 1) AS r FROM closes c LEFT JOIN (SELECT a.security_id, a.ex_date, a.value FROM actions a JOIN (SELECT security_id, max(date) AS last FROM closes GROUP BY 1) l ON l.security_id = a.security_id AND a.ex_date <= l.last WHERE a.action = 'split') a
  ON a.security_id = c.security_id AND a.ex_date > c.date WHERE c.close > 0 GROUP BY 1, 2, 3, 4),
q AS (SELECT security_id, date, volume, round(close / r, 6) AS p FROM sp),
w AS (SELECT *, lag(p) OVER (PARTITION BY security_id ORDER BY date) AS b, {', '.join(f"CASE WHEN count(p) OVER w{n} = {n} THEN {f} END AS {a}" for n, f, a in [(50, 'round(avg(p) OVER w50, 6)', 'ma50'), (200, 'round(avg(p) OVER w200, 6)', 'ma200'), (252, 'max(p) OVER w252', 'hi'), (252, 'min(p) OVER w252', 'lo')])} FROM q
  WINDOW {', '.join(f"w{n} AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (50, 200, 252))}),
stocks AS (SELECT security_id, sic FROM securities WHERE security_type = 'CS' AND mic IN ('XNYS', 'XNAS', 'XASE')),
u AS (SELECT security_id, 'all' AS universe FROM stocks UNION ALL SELECT security_id, 'sector:' || s.name FROM stocks JOIN (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in breadth.SECTORS)}) s(name, a, b) ON sic BETWEEN a AND b),
g AS (SELECT universe, date, count(b) AS stocks, count(*) FILTER (p > b) AS advancers, count(*) FILTER (p < b) AS decliners, count(*) FILTER (p = b) AS unchanged, CAST(coalesce(sum(volume) FILTER (p > b), 0) AS BIGINT) AS up_volume, CAST(coalesce(sum(volume) FILTER (p < b), 0) AS BIGINT) AS down_volume,
  count(ma50) AS eligible_50, count(*) FILTER (p > ma50) AS above_50, count(ma200) AS eligible_200, count(*) FILTER (p > ma200) AS above_200, count(hi) AS eligible_252, count(*) FILTER (p >= hi) AS new_highs, count(*) FILTER (p <= lo) AS new_lows FROM w JOIN u USING (security_id) GROUP BY 1, 2)
SELECT universe, date, stocks::BIGINT AS stocks, advancers::BIGINT AS advancers, decliners::BIGINT AS decliners, unchanged::BIGINT AS unchanged, up_volume, down_volume, eligible_50::BIGINT AS eligible_50, above_50::BIGINT AS above_50, eligible_200::BIGINT AS eligible_200, above_200::BIGINT AS above_200, eligible_252::BIGINT AS eligible_252, new_highs::BIGINT AS new_highs, new_lows::BIGINT AS new_lows,
 CAST(sum(advancers - decliners) OVER (PARTITION BY universe ORDER BY date) AS BIGINT) AS ad_line, round(100.0::DOUBLE * above_50 / nullif(eligible_50, 0), 6) AS pct_above_50, round(100.0::DOUBLE * above_200 / nullif(eligible_200, 0), 6) AS pct_above_200, round(advancers::DOUBLE / nullif(decliners, 0), 6) AS ad_ratio,
 round(up_volume::DOUBLE / nullif(up_volume + down_volume, 0), 6) AS up_volume_share, CASE WHEN stocks > 0 THEN CAST(advancers - decliners AS BIGINT) END AS net_advances, CASE WHEN eligible_252 > 0 THEN CAST(new_highs - new_lows AS BIGINT) END AS net_new_highs FROM g"""


@query("brd_01_breadth", "closes", "actions", "securities", sql=BREADTH_SQL)
def market_breadth(closes, actions, securities):
    return breadth.breadth(closes, actions, securities)


def _full(n: int, f: str, c: str = "value") -> str:
    frame = f"OVER (PARTITION BY key ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {f}({c}) {frame} END"


O = "OVER (PARTITION BY key ORDER BY date)"  # noqa: E741


def one(name: str, column, sql: str) -> None:
    """An indicator that is a column over the series."""
    query(name, "series", sql=f"SELECT key, date, round({sql}, 6) AS value FROM series")(lambda s: s.select("key", "date", R(column()).alias("value")))


one("ind_01_sma", lambda: indicators.sma(50), _full(50, "avg"))
one("ind_05_ret", lambda: indicators.ret(5), f"CASE WHEN lag(value, 5) {O} != 0 THEN value / lag(value, 5) {O} - 1 END")
one("ind_05_diff", lambda: indicators.diff(2), f"value - lag(value, 2) {O}")
one("ind_06_stdev", lambda: indicators.stdev(20), _full(20, "stddev_samp"))
one("ind_07_zscore", lambda: indicators.zscore(20), f"(value - {_full(20, 'avg')}) / nullif({_full(20, 'stddev_samp')}, 0)")
one("ind_08_high", lambda: indicators.high(20), _full(20, "max"))
one("ind_08_low", lambda: indicators.low(20), _full(20, "min"))
one("ind_09_drawdown", lambda: indicators.drawdown(20), f"value / {_full(20, 'max')} - 1")
one("sta_03_range_index", lambda: indicators.range_index(), """CASE WHEN count(value) OVER w >= 52 THEN CASE WHEN max(value) OVER w = min(value) OVER w THEN CASE WHEN value IS NOT NULL THEN 50 END ELSE 100 * (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END END""".replace("OVER w", "OVER (PARTITION BY key ORDER BY date ROWS BETWEEN 155 PRECEDING AND CURRENT ROW)"))
one("sta_04_deviation", lambda: indicators.deviation(60), "CASE WHEN count(value) OVER w >= 20 THEN value - avg(value) OVER w END".replace("OVER w", "OVER (PARTITION BY key ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"))
one("sta_01_trailing_rank", lambda: indicators.trailing_rank(120, 60), "CASE WHEN value IS NOT NULL AND count(value) OVER w >= 60 THEN len(list_filter(list(value) OVER w, lambda x: x <= value))::DOUBLE / count(value) OVER w END".replace("OVER w", "OVER (PARTITION BY key ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"))


@query("ind_06_vol", "series", sql=f"WITH r AS (SELECT key, date, CASE WHEN lag(value) {O} != 0 THEN value / lag(value) {O} - 1 END AS r FROM series) SELECT key, date, round({_full(21, 'stddev_samp', 'r')} * sqrt(252), 6) AS value FROM r")
def vol(series):
    return indicators.vol(series).select("key", "date", R(F.col("vol")).alias("value"))


@query("ind_12_realised_vol", "series", sql=f"WITH r AS (SELECT key, date, CASE WHEN value > 0 AND lag(value) {O} > 0 THEN ln(value / lag(value) {O}) END AS r FROM series) SELECT key, date, round({_full(21, 'stddev_samp', 'r')} * sqrt(252), 6) AS value FROM r")
def realised_vol(series):
    return indicators.realised_vol(series).select("key", "date", R(F.col("realised_vol")).alias("value"))


@query("ind_10_yoy", "series", sql="SELECT s.key, s.date, round(CASE WHEN b.value != 0 THEN s.value / b.value - 1 END, 6) AS value FROM series s ASOF LEFT JOIN series b ON b.key = s.key AND s.date - 365 >= b.date")
def yoy(series):
    return indicators.yoy(series).select("key", "date", R(F.col("yoy")).alias("value"))


@query("ind_11_log_growth", "series", sql=f"WITH g AS (SELECT key, date, CASE WHEN value > 0 AND lag(value, 12) {O} > 0 THEN ln(value / lag(value, 12) {O}) END AS g FROM series) SELECT key, date, round(g, 6) AS growth, round(g - lag(g, 3) {O}, 6) AS acceleration FROM g")
def log_growth(series):
    return indicators.log_growth(series).select("key", "date", R(F.col("growth")).alias("growth"), R(F.col("acceleration")).alias("acceleration"))


@query("ind_02_ema_macd_rsi", "series", sql="""WITH RECURSIVE x AS (SELECT key, date, value, row_number() OVER o AS i, value - lag(value) OVER o AS d,
   CASE WHEN count(value) OVER (o ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) = 12 THEN avg(value) OVER (o ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS m12,
   CASE WHEN count(value) OVER (o ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) = 26 THEN avg(value) OVER (o ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) END AS m26 FROM series WINDOW o AS (PARTITION BY key ORDER BY date)),
 e AS (SELECT key, i, m12 AS s12, m26 AS s26, CASE WHEN value IS NULL THEN -1 ELSE 0 END AS n, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l FROM x WHERE i = 1
  UNION ALL SELECT x.key, x.i, CASE WHEN e.s12 IS NULL THEN x.m12 WHEN x.value IS NULL THEN e.s12 ELSE e.s12 + (x.value - e.s12) * 2 / 13 END, CASE WHEN e.s26 IS NULL THEN x.m26 WHEN x.value IS NULL THEN e.s26 ELSE e.s26 + (x.value - e.s26) * 2 / 27 END,
   CASE WHEN x.value IS NULL THEN -1 ELSE e.n + 1 END,
   CASE WHEN x.value IS NULL OR e.n < 0 THEN 0 WHEN e.n < 14 THEN e.g + greatest(x.d, 0) / 14 ELSE (e.g * 13 + greatest(x.d, 0)) / 14 END, CASE WHEN x.value IS NULL OR e.n < 0 THEN 0 WHEN e.n < 14 THEN e.l + greatest(-x.d, 0) / 14 ELSE (e.l * 13 + greatest(-x.d, 0)) / 14 END
  FROM e JOIN x ON x.key = e.key AND x.i = e.i + 1)
 SELECT key, date, round(CASE WHEN value IS NOT NULL THEN s12 END, 5) AS ema, round(CASE WHEN value IS NOT NULL THEN s12 - s26 END, 5) AS macd, round(CASE WHEN value IS NOT NULL AND n >= 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END, 5) AS rsi FROM e JOIN x USING (key, i)""")
def recursive(series):
    out = indicators.recursive(series)
    clean = lambda c: F.when(~F.isnan(c), R(F.col(c), 5)).alias(c)
    return out.select("key", "date", clean("ema"), clean("macd"), clean("rsi"))


@query("sta_06_decile", "closes", sql="SELECT security_id, date, CAST(floor((row_number() OVER (PARTITION BY date ORDER BY close, security_id) - 1) * 10 / count(*) OVER (PARTITION BY date)) AS BIGINT) AS decile FROM closes")
def decile(closes):
    return closes.select("security_id", "date", indicators.decile(["date"], [F.col("close"), F.col("security_id")]).alias("decile"))
