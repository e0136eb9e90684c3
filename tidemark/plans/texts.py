"""Queries of text and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fulltext, text
from tidemark.plans.registry import ORACLES, QUERIES, query
from tidemark.sources.views import shared_folder, table
from tidemark.streaming import streams


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_text(table(spark, sf_dir, "pages")).select("page_id", "text")


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(text.keyword_filter(F.col("text"), 'the -"of the" OR und')).select("doc_id", "lang")


FOUND = 'the and OR "of the" -der'


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.search(text.inverted_index(docs, "doc_id"), docs, "doc_id", FOUND, 50)


def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.search(text.inverted_index(docs, "doc_id"), docs, "doc_id", FOUND).select("doc_id")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose between the first line of a document that begins with The and the next that begins with A."""
    docs = table(spark, sf_dir, "documents")
    found = text.section(F.col("text"), [r"The\b", r"In\b"], r"A[a-z]*\b", least=50)
    return docs.select("doc_id", found.alias("section")).where("section IS NOT NULL")


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(streams.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_type", F.to_date("ts").alias("date"), "ts", "event_id", "value")
    return streams.upsert(rows, _path(spark, "bars"), ["event_type", "date"], ["ts", "event_id"]).select("event_type", "date", "value")


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return streams.drain(streams.once(rows, ["user_id", "event_type", "day"], "60 days").select("user_id", "event_type", "day"), _path(spark, "once"))


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.buyers(_events(spark, sf_dir), "60 days"), _path(spark, "buyers"), "complete")


def known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"), F.col("ts").alias("realtime_start"), "value")
    return streams.drain(streams.known_values(rows), _path(spark, "known"), "complete").select("series_id", "date", "value")


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.daily_activity(_events(spark, sf_dir), "60 days"), _path(spark, "daily"), "complete").select("day", "event_type", "n")


def newly_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.newly_flagged(_events(spark, sf_dir), 99.0), _path(spark, "flags"))


@query("str_07_backfill", "closes", sql="WITH m AS (SELECT security_id, date, round(close, 6) AS close FROM closes WHERE security_id % 2 = 0) SELECT * FROM m WHERE security_id != 2 OR date < DATE '1997-01-01' UNION ALL SELECT security_id, date, round(close, 6) FROM closes WHERE security_id = 3 UNION ALL SELECT security_id - 1, date, round(close, 6) FROM closes WHERE security_id = 3 AND FALSE UNION ALL SELECT security_id, date, round(close * 2, 6) FROM closes WHERE security_id = 2 AND date >= DATE '1997-01-01'")
def backfill(closes):
    rows = closes.select("security_id", "date", F.round("close", 6).alias("close"))
    stored = closes.select(F.concat(F.lit("S"), F.col("security_id").cast("string")).alias("symbol"), "date", F.round(F.col("close") * F.when(F.col("security_id") == 2, 2).otherwise(1), 6).alias("close")).where("symbol <> 'S2' OR date >= '1997-01-01'")
    gained = closes.sparkSession.createDataFrame([("S3", 3), ("S2", 2)], "symbol string, security_id long")
    return streams.backfill(stored, rows.where("security_id % 2 = 0"), gained)


@query("txt_05_reports", "filings", sql="SELECT accession, form, filed FROM filings WHERE filed >= DATE '1997-01-01' AND (form = '10-K' OR form = '8-K' AND list_has_any(string_split(items, ','), ['1.03', '5.02']))")
def reports(f):
    return text.wanted_reports(f, F.lit("1997-01-01").cast("date"), {"10-K": [], "8-K": ["1.03", "5.02"]}).select("accession", "form", "filed")


@query("txt_06_bills", "bills", sql="SELECT id FROM (SELECT *, area || ' act of ' || year(introduced) AS title FROM bills) WHERE regexp_matches(lower(title), '(^|[^a-z0-9])urgent act([^a-z0-9]|$)') OR (area IN ('2-HIGH', '5-LOW') AND subject IN (1, 2))")
def matching_bills(b):
    titled = b.withColumn("title", F.concat_ws(" ", "area", F.lit("act of"), F.year("introduced").cast("string")))
    return text.matching_bills(titled, '"urgent act"', ["2-HIGH", "5-LOW"], [1, 2]).select("id")


STORED = 'rewh thatin OR "de la" -ononst'


def stored_search(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Search of an index that is written first; matches with their cover density."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fulltext.write_index(docs, "doc_id", _path(spark, "fulltext"))
    return fulltext.search(index, docs, STORED, limit).select("doc_id", "score")


def stored_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_search(spark, sf_dir, 50)


_ENDS = "(er|es|ed|ing|ly|erly|edly|ingly|lyed|lying)?$"
COVERS = rf"""WITH l AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM l),
 a AS (SELECT doc_id, place, CASE WHEN regexp_matches(word, '^rewh{_ENDS}') THEN 'r' WHEN regexp_matches(word, '^thatin{_ENDS}') THEN 't' WHEN regexp_matches(word, '^ononst{_ENDS}') THEN 'o' WHEN word IN ('de', 'la') THEN word END AS s FROM u),
 e AS (SELECT doc_id, place, min(place) FILTER (s = 'r') OVER f AS r, min(place) FILTER (s = 't') OVER f AS t FROM a WHERE s IN ('r', 't') WINDOW f AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 c AS (SELECT doc_id, place, CASE WHEN r IS NOT NULL AND t IS NOT NULL THEN greatest(r, t) END AS z, lead(CASE WHEN r IS NOT NULL AND t IS NOT NULL THEN greatest(r, t) END) OVER (PARTITION BY doc_id ORDER BY place) AS next FROM e),
 s AS (SELECT doc_id, 1.0::DOUBLE / (1 + greatest(0, z - place - 1)) AS score FROM c WHERE z IS NOT NULL AND (next IS NULL OR next > z)
 UNION ALL SELECT d.doc_id, 1.0 FROM a d JOIN a l ON l.doc_id = d.doc_id AND l.place = d.place + 1 WHERE d.s = 'de' AND l.s = 'la' AND d.doc_id NOT IN (SELECT doc_id FROM a WHERE s = 'o'))
 SELECT doc_id, round(sum(score), 6) AS score FROM s GROUP BY 1"""

QUERIES |= {
    "txt_03_stored": stored_search, "txt_03_stored_top": stored_top,
    "txt_01_page_text": page_text, "txt_02_sections": sections, "txt_03_search": search, "txt_03_matches": search_matches, "txt_04_keyword_filter": keyword_filter, "str_01_bars": bars, "str_02_once": once,
    "str_03_buyers": buyers, "str_04_newly_flagged": newly_flagged, "str_05_known_values": known_values, "str_06_daily_activity": daily_activity,
}
ORACLES |= {
    "txt_03_stored": COVERS, "txt_03_stored_top": f"{COVERS} ORDER BY 2 DESC, 1 LIMIT 50",
    "txt_04_keyword_filter": r"SELECT doc_id, lang FROM documents WHERE (regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') AND NOT regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])of[^\p{L}\p{N}_]+the($|[^\p{L}\p{N}_])')) OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])und($|[^\p{L}\p{N}_])')",
    "txt_03_matches": r"WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents) SELECT doc_id FROM w WHERE (t LIKE '% the %' AND t LIKE '% and %') OR (t LIKE '% of the %' AND t NOT LIKE '% der %')",
    "str_01_bars": "SELECT event_type, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "str_02_once": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
    "str_03_buyers": "WITH d AS (SELECT event_type, user_id, CAST(ts AS DATE) AS d FROM events) SELECT event_type, CAST(d + CAST(i AS INT) AS TIMESTAMP) AS until, count(DISTINCT user_id) AS users FROM d, range(1, 31) t(i) GROUP BY 1, 2",
    "str_04_newly_flagged": "SELECT user_id, ts, value FROM events QUALIFY value >= 99 AND NOT coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 99, false)",
    "str_05_known_values": "SELECT event_type AS series_id, CAST(ts AS DATE) AS date, arg_max(value, ts) AS value FROM events GROUP BY 1, 2",
    "str_06_daily_activity": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
