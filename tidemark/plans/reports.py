"""Queries of studies on the trading calendar, calendar-time tests, searches with history and declared data sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import disclosures, identity, metrics, statistics, tables
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)
DAY = lambda d: F.lit(d).cast("date")

EVENTS = "e AS (SELECT DISTINCT issuer_cik * 3 + 1 AS security_id, filing_date AS event_date FROM insider_transactions WHERE trans_code = 'P')"
MONTHS = """r AS (SELECT security_id % 3 AS g, date_trunc('month', date)::DATE AS period, close / lag(close) OVER (PARTITION BY security_id ORDER BY date) - 1 AS x FROM closes),
 m AS MATERIALIZED (SELECT g, period, avg(x) AS m, count(*) AS names FROM r WHERE x IS NOT NULL GROUP BY 1, 2)"""


def _events(t):
    return t.where("trans_code = 'P'").select((F.col("issuer_cik") * 3 + 1).alias("security_id"), F.col("filing_date").alias("event_date")).distinct()


def _returns(closes):
    by = W.partitionBy("security_id").orderBy("date")
    return closes.select((F.col("security_id") % 3).alias("group"), F.trunc("date", "month").alias("period"), (F.col("close") / F.lag("close").over(by) - 1).alias("excess"))


def _error(series: str, lags: int) -> str:
    """SQL of the error of a mean of s(k, period, v) with Bartlett weights, as table z."""
    shifted = ", ".join(f"e * lag(e, {j}) OVER (PARTITION BY k ORDER BY period) AS g{j}" for j in range(1, lags + 1))
    total = " + ".join(f"2 * (1 - {j} / {lags + 1}.0) * coalesce(sum(g{j}), 0)" for j in range(1, lags + 1))
    return f"s AS ({series}), c AS (SELECT *, v - avg(v) OVER (PARTITION BY k) AS e FROM s), q AS (SELECT *, {shifted} FROM c), z AS (SELECT k, count(*) AS n, avg(v) AS mean, sqrt(greatest(sum(e * e) + {total}, 0)) / count(*) AS error FROM q GROUP BY 1)"


@query("dis_06_calendar_study", "insider_transactions", "closes", sql=f"""WITH {EVENTS}, cal AS (SELECT date, close AS b, row_number() OVER (ORDER BY date) AS i FROM closes WHERE security_id = 0),
 n AS (SELECT security_id, event_date, (SELECT min(date) FROM cal WHERE date > event_date AND date <= event_date + 10) AS d0 FROM e),
 x AS (SELECT h, c1.close / c0.close - 1 AS r, c1.close / c0.close - z.b / a.b AS x FROM n JOIN cal a ON a.date = d0 JOIN closes c0 ON c0.security_id = n.security_id AND c0.date = d0 CROSS JOIN (VALUES (5), (21), (63), (126)) t(h) JOIN cal z ON z.i = a.i + h JOIN closes c1 ON c1.security_id = n.security_id AND c1.date = z.date)
 SELECT CAST(h AS INT) AS h, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(avg((x > 0)::INT::DOUBLE), 6) AS hit_rate, round(avg(r), 6) AS mean_return, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(*)), 5) AS t FROM x GROUP BY h""")
def calendar_study(t, closes):
    out = disclosures.calendar_study(_events(t), closes, [5, 21, 63, 126])
    return out.select("h", "n", *(R(F.col(c)).alias(c) for c in ("mean", "median", "hit_rate", "mean_return")), R(F.col("t"), 5).alias("t"))


@query("dis_06_unpriced", "insider_transactions", "closes", sql=f"WITH {EVENTS} SELECT security_id, count(*) AS events FROM e WHERE security_id NOT IN (SELECT security_id FROM closes) GROUP BY 1")
def unpriced(t, closes):
    return disclosures.unpriced(_events(t), closes)


@query("sts_21_hac", "closes", sql=f"""WITH {MONTHS}, {_error("SELECT g AS k, period, m AS v FROM m", 2)}, w AS (SELECT g AS k, avg(names) AS names_per_period FROM m GROUP BY 1)
 SELECT k AS "group", n, round(mean, 6) AS mean, round(error, 6) AS error, round(mean / error, 4) AS t, round(names_per_period, 6) AS names_per_period FROM z JOIN w USING (k) WHERE n >= 8""")
def calendar_time_error(closes):
    out = statistics.calendar_time_error(_returns(closes), lags=2)
    return out.select("group", "n", *(R(F.col(c)).alias(c) for c in ("mean", "error", "names_per_period")), R(F.col("t"), 4).alias("t"))


@query("sts_21_difference", "closes", sql=f"""WITH {MONTHS}, {_error('SELECT (a.g, b.g) AS k, period, a.m - b.m AS v FROM m a JOIN m b USING (period) WHERE a.g < b.g', 2)}
 SELECT k[1] AS "first", k[2] AS "second", n, round(mean, 6) AS mean, round(error, 6) AS error, round(mean / error, 4) AS t FROM z WHERE n >= 3""")
def calendar_time_difference(closes):
    pairs = closes.sparkSession.createDataFrame([(0, 1), (0, 2), (1, 2)], "first long, second long")
    out = statistics.calendar_time_difference(_returns(closes), pairs, lags=2)
    return out.select("first", "second", "n", R(F.col("mean")).alias("mean"), R(F.col("error")).alias("error"), R(F.col("t"), 4).alias("t"))


@query("sts_10_past_holdout", "feed_log", sql="SELECT provider AS hypothesis, item AS variant, id, day AS data_end, datediff('day', DATE '2024-01-15', day) + 1 AS days_past FROM feed_log WHERE id % 5 != 0 AND day >= DATE '2024-01-15'")
def past_holdout(log):
    runs = log.select(F.col("provider").alias("hypothesis"), F.col("item").alias("variant"), F.when(F.col("id") % 5 == 0, "holdout").otherwise("validation").alias("kind"), F.col("day").alias("data_end"), "id")
    return statistics.past_holdout(runs, DAY("2024-01-15")).drop("kind")


@query("idn_24_listing", "securities", "closes", sql="""WITH s AS (SELECT security_id, ticker, security_type, active, concat('House of ', ticker) AS name FROM securities), h AS (SELECT security_id, concat('T', year(date)) AS symbol, min(date) AS first_seen, max(date) AS last_seen FROM closes GROUP BY 1, 2),
 f AS (SELECT * FROM s WHERE security_type = 'CS' AND active AND (contains(lower(ticker), '0') OR contains(lower(name), '0')) ORDER BY ticker LIMIT 50)
 SELECT f.security_id, ticker, name, string_agg(concat(symbol, ' ', first_seen, ' ', last_seen), ';' ORDER BY first_seen) AS symbols FROM f LEFT JOIN h USING (security_id) GROUP BY 1, 2, 3""")
def listing(s, closes):
    history = closes.groupBy("security_id", F.concat(F.lit("T"), F.year("date").cast("string")).alias("symbol")).agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    found = identity.list_securities(s.withColumn("name", F.concat(F.lit("House of "), "ticker")), "0", kind="cs", active=True)
    told = F.transform("symbols", lambda x: F.concat_ws(" ", x.symbol, x.first_seen, x.last_seen))
    return identity.with_history(found, history).select("security_id", "ticker", "name", F.when(F.size("symbols") > 0, F.concat_ws(";", told)).alias("symbols"))


@query("met_02_latest_known", "statement_items", sql="SELECT cik, line_item, max(period_end) AS period_end, max_by(value, (period_end, filed)) AS value FROM statement_items WHERE filed <= DATE '1998-06-30' AND period_end <= DATE '1998-06-30' AND value IS NOT NULL GROUP BY 1, 2 HAVING datediff('day', max(period_end), DATE '1998-06-30') <= 400")
def latest_known(s):
    return metrics.latest_balance(s, DAY("1998-06-30"), ["cik", "line_item"])


@query("ext_05_kinds", "feed_log", sql="""WITH d(provider, kind) AS (VALUES ('click', 'snapshot'), ('view', 'reference'), ('error', 'log')), r AS (SELECT f.*, kind, row_number() OVER (PARTITION BY provider, item ORDER BY day DESC, id DESC) AS n, max(day) OVER (PARTITION BY provider) AS newest FROM feed_log f JOIN d USING (provider))
 SELECT provider, item, day, id FROM r WHERE (kind = 'snapshot' AND n = 1) OR (kind = 'reference' AND day = newest) OR kind = 'log'""")
def kinds(log):
    sets = log.sparkSession.createDataFrame([("click", "feed", "snapshot"), ("view", "feed", "reference"), ("error", "feed", "log")], "provider string, dataset string, kind string")
    rows = log.select("provider", F.lit("feed").alias("dataset"), "item", "day", "id")
    return tables.declared_rows(rows, sets, ["item"], "day", ["id"]).drop("dataset")


@query("sts_22_interval", "closes")
def after_controls_interval(closes):
    rows = _returns(closes).withColumn("momentum", F.month("period"))
    out = statistics.after_controls_interval(rows, ["momentum"], replicates=200)
    return out.select("group", "n", "periods", *(R(F.col(c)).alias(c) for c in ("mean", "low", "high")))
