"""Queries of table upkeep: scans, reports on feeds, retention and precedence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tables
from tidemark.plans.registry import ORACLES, QUERIES, query
from tidemark.sources.views import table

R = lambda c, d=2: F.round(c, d)
DAY = lambda d: F.lit(d).cast("date")


def _scan(spark, sf_dir):
    return tables.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"], where=F.col("l_shipdate") >= "1997-01-01").select("l_orderkey", "l_linenumber", "l_quantity")


QUERIES["src_01_keyed_scan"] = _scan
ORACLES["src_01_keyed_scan"] = "SELECT l_orderkey, l_linenumber, max((l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))[3] AS l_quantity FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' GROUP BY 1, 2"


def _tsv(spark, sf_dir):
    """The customer table written as tab-separated text in the shared folder and read back against the nation table."""
    import uuid

    from tidemark.sources.views import shared_folder

    path = f"{shared_folder(spark)}/tidemark-customers-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    read = tables.read_tsv(spark, path, "c_custkey long, c_nationkey int, c_name string, c_acctbal double")
    return read.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", "c_name", "n_name", "c_acctbal")


QUERIES["src_02_tsv_join"] = _tsv
ORACLES["src_02_tsv_join"] = "SELECT c_custkey, c_name, n_name, CASE WHEN c_custkey % 9 != 0 THEN c_acctbal END AS c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey"


@query("src_03_wide", "series", sql="""SELECT date, max(CASE WHEN key = 0 THEN printf('%.0f', floor(value)) END) AS "0", max(CASE WHEN key = 1 THEN printf('%.0f', floor(value)) END) AS "1", max(CASE WHEN key = 2 THEN printf('%.0f', floor(value)) END) AS "2" FROM series GROUP BY 1""")
def wide(s):
    return tables.wide(s.withColumn("value", F.floor("value").cast("double")), [0, 1, 2], "%.0f")


def _replace(spark, sf_dir):
    """The positions of a part of the periods rewritten in a partitioned table; the other partitions stay."""
    import uuid

    from tidemark.sources.views import shared_folder, view

    path = f"{shared_folder(spark)}/tidemark-periods-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, "positions").groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    tables.replace_partitions(rows, path, ["period"])
    tables.replace_partitions(rows.where(F.year("period") == 1997).withColumn("n", -F.col("n")), path, ["period"])
    return spark.read.schema("n long, period date").parquet(path)


QUERIES["src_05_replace_partitions"] = _replace


@query("src_09_position_sums", "positions", sql="""WITH p AS (SELECT filer_cik % 5 AS accession, CASE WHEN filer_cik % 11 = 0 THEN substr(cusip, 1, 8) ELSE cusip END AS cusip, put_call, shares, value, period, lpad(CAST(filer_cik AS VARCHAR), 3, '0') || '|' || period AS line, 'N' || filer_cik AS name FROM positions)
 SELECT accession, cusip, put_call, round(sum(shares), 2) AS shares, round(sum(value * CASE WHEN period < DATE '1997-06-30' THEN 1000 ELSE 1 END), 2) AS value, min_by(name, line) AS name FROM p WHERE length(cusip) = 9 GROUP BY 1, 2, 3""")
def position_sums(p):
    line = F.concat_ws("|", F.lpad(F.col("filer_cik").cast("string"), 3, "0"), F.col("period").cast("string"))
    rows = p.select((F.col("filer_cik") % 5).alias("accession"), F.when(F.col("filer_cik") % 11 == 0, F.substring("cusip", 1, 8)).otherwise(F.col("cusip")).alias("cusip"), "put_call", "shares", "value", F.col("period").alias("filed"), line.alias("line"), F.concat(F.lit("N"), F.col("filer_cik").cast("string")).alias("name"))
    return tables.position_sums(rows, "1997-06-30").withColumns({"shares": R(F.col("shares")), "value": R(F.col("value"))})


@query("src_11_filer_size", "positions", sql="""WITH r AS (SELECT *, put_call = '' AS replaces FROM positions), t AS (SELECT filer_cik, period FROM r WHERE replaces GROUP BY 1, 2 HAVING sum(value) >= 1000000 UNION SELECT filer_cik, period FROM r WHERE filer_cik IN (3, 4))
 SELECT filer_cik, period, cusip, put_call FROM r SEMI JOIN t USING (filer_cik, period)""")
def filer_size(p):
    watched = p.where("filer_cik IN (3, 4)").select("filer_cik").distinct()
    return tables.filers_of_size(p.withColumn("replaces", F.col("put_call") == ""), watched, 1_000_000).select("filer_cik", "period", "cusip", "put_call")


@query("src_12_latest_lots", "fund_lots", sql="SELECT fund, period, filed, identifier, sum(shares) AS shares, round(sum(value), 2) AS value FROM (SELECT * FROM fund_lots QUALIFY filed = max(filed) OVER (PARTITION BY fund, period)) GROUP BY 1, 2, 3, 4")
def latest_lots(f):
    return tables.latest_lots(f).withColumn("value", R(F.col("value")))


@query("src_14_groups_long", "cot_positions", sql="""WITH w AS (SELECT market, report_date, CASE WHEN trader = 'A' THEN '' ELSE CAST(long_side AS VARCHAR) END AS a1, CAST(long_side + 1 AS VARCHAR) AS a2, CAST(short_side AS VARCHAR) AS b, trader FROM cot_positions)
 SELECT market, report_date, trader, 'long' AS "group", coalesce(nullif(a1, ''), a2) AS n FROM w UNION ALL SELECT market, report_date, trader, 'short', b FROM w""")
def groups_long(c):
    wide_ = c.select("market", "report_date", "trader", F.when(F.col("trader") == "A", "").otherwise(F.col("long_side").cast("string")).alias("a1"), (F.col("long_side") + 1).cast("string").alias("a2"), F.col("short_side").cast("string").alias("b"))
    return tables.groups_long(wide_, ["market", "report_date", "trader"], {"long": {"n": ["a1", "a2"]}, "short": {"n": ["b"]}})


@query("src_15_code_ranges", "securities", sql="SELECT security_id, CAST(sic + i AS INT) AS code FROM securities, range(0, 4) t(i) WHERE i <= security_id % 4")
def code_ranges(s):
    text = F.concat_ws("-", F.col("sic").cast("string"), (F.col("sic") + F.col("security_id") % 4).cast("string"))
    return s.select("security_id", F.explode(tables.expand_codes(text)).alias("code")).withColumn("code", F.col("code").cast("int"))


@query("src_16_use_cells", "cot_positions", sql="""WITH m AS (SELECT CASE WHEN market = 0 THEN 'T001' WHEN market = 1 THEN 'V001' ELSE 'C' || market END AS code, sum(CASE WHEN trader = 'A' THEN long_side END) AS "F01", sum(CASE WHEN trader = 'N' THEN long_side END) AS "C2", sum(CASE WHEN trader = 'X' THEN long_side END) AS "T9" FROM cot_positions GROUP BY 1),
 u AS (UNPIVOT m ON "F01", "C2", "T9" INTO NAME buyer VALUE value) SELECT code AS commodity, buyer, CAST(value AS BIGINT) AS value, CASE left(code, 1) WHEN 'F' THEN 'final' WHEN 'V' THEN 'value_added' WHEN 'T' THEN 'total' ELSE 'commodity' END AS row_kind, CASE left(buyer, 1) WHEN 'F' THEN 'final' WHEN 'V' THEN 'value_added' WHEN 'T' THEN 'total' ELSE 'commodity' END AS buyer_kind FROM u WHERE value != 0""")
def use_cells(c):
    code = F.when(F.col("market") == 0, "T001").when(F.col("market") == 1, "V001").otherwise(F.concat(F.lit("C"), F.col("market").cast("string")))
    cell = lambda t, name: F.sum(F.when(F.col("trader") == t, F.col("long_side"))).alias(name)
    return tables.use_cells(c.groupBy(code.alias("code")).agg(cell("A", "F01"), cell("N", "C2"), cell("X", "T9")), "code", ["F01", "C2", "T9"])


@query("src_17_numbers", "transactions", sql="SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN -round(quantity, 2) ELSE round(quantity, 2) END AS number FROM transactions")
def numbers(t):
    plain = F.format_string("%.2f", "quantity")
    text = F.when(F.col("id") % 7 == 0, "n/a").when(F.col("id") % 3 == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(F.col("id") % 3 == 1, F.concat(F.lit("$ "), plain)).otherwise(F.concat(F.lit("+"), plain, F.lit("%")))
    return t.select("id", tables.accounting_number(text).alias("number"))


@query("src_18_amounts", "congress_trades", sql="SELECT id, CASE WHEN id % 5 = 0 THEN 50000001 ELSE amount_min END AS low, CASE WHEN id % 5 != 0 THEN amount_min + 14000 END AS high FROM congress_trades")
def amounts(t):
    text = F.when(F.col("id") % 5 == 0, "Over $50,000,000").otherwise(F.concat(F.lit("$"), F.format_number("amount_min", 0), F.lit(" - $"), F.format_number(F.col("amount_min") + 14000, 0)))
    return t.select("id", tables.amount_range(text).alias("a")).select("id", "a.low", "a.high")


@query("src_19_retention", "feed_log", sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY provider, item, error ORDER BY day DESC, id DESC) AS n FROM feed_log), m AS (SELECT *, datediff('day', day, DATE '2024-02-05') > 10 AND (error OR n > 3) AS goes FROM r)
 SELECT id, provider, item, day, error, body NOT IN (SELECT body FROM m WHERE NOT goes) AS body_goes FROM m WHERE goes""")
def retention(log):
    return tables.retention(log, DAY("2024-02-05"), days=10)


@query("src_20_freshness", "feed_log", sql="""WITH i AS (SELECT provider, item, max(day) FILTER (NOT error) AS ok, max(day) FILTER (error) AS bad FROM feed_log GROUP BY 1, 2), p AS (SELECT provider, count(*) AS items, count(*) FILTER (bad IS NOT NULL AND (ok IS NULL OR bad > ok)) AS failing, max(ok) AS last_success FROM i GROUP BY 1),
 e(provider, days) AS (VALUES ('click', 3), ('view', 30), ('fax', 5)), j AS (SELECT coalesce(p.provider, e.provider) AS provider, coalesce(items, 0) AS items, coalesce(failing, 0) AS failing, last_success, days FROM p FULL OUTER JOIN e ON e.provider = p.provider)
 SELECT provider, items, failing, last_success, CAST(datediff('day', last_success, DATE '2024-02-05') AS INT) AS age, CASE WHEN failing > greatest(1, 0.1 * items) THEN 'failing' WHEN days IS NULL THEN 'unmonitored' WHEN last_success IS NULL OR datediff('day', last_success, DATE '2024-02-05') >= days THEN 'stale' ELSE 'ok' END AS status FROM j""")
def freshness(log):
    expected = log.sparkSession.createDataFrame([("click", 3), ("view", 30), ("fax", 5)], "provider string, days int")
    return tables.freshness(log, expected, DAY("2024-02-05"))


@query("src_21_stale", "filings", sql="""WITH e AS (SELECT DISTINCT cik FROM filings), n AS (SELECT cik, max(period_end) AS newest FROM filings WHERE form != '8-K' AND filed < DATE '1998-06-30' AND cik % 7 != 0 GROUP BY 1), q AS (SELECT DISTINCT cik FROM filings WHERE form = '10-Q' AND datediff('day', filed, DATE '1998-12-31') BETWEEN 0 AND 730)
 SELECT e.cik, newest FROM e LEFT JOIN n USING (cik) WHERE newest IS NULL OR datediff('day', newest, DATE '1998-12-31') > CASE WHEN e.cik IN (SELECT cik FROM q) THEN 200 ELSE 430 END""")
def stale(f):
    periods = f.where("form <> '8-K' AND filed < '1998-06-30' AND cik % 7 <> 0")
    return tables.stale_entities(f.select("cik").distinct(), periods, f, DAY("1998-12-31"))


@query("src_23_precedence", "bills", sql="SELECT id, introduced, CASE WHEN year(introduced) <= 1997 AND subject < 3 THEN 'final' ELSE 'candidate' END AS kind FROM bills WHERE (year(introduced) <= 1997 AND subject < 3) OR (subject >= 3 AND year(introduced) > 1997)")
def precedence(b):
    year = F.year("introduced")
    return tables.final_over_candidates(b.where((year <= 1997) & (F.col("subject") < 3)), b.where("subject >= 3"), year).select("id", "introduced", "kind")


@query("src_26_members", "filings", sql="SELECT cik, max_by(accession, (filed, accession)) AS latest, count(*) AS filings FROM filings WHERE filed >= DATE '1997-03-01' AND regexp_replace(form, '/A$', '') IN ('10-K', '10-Q') GROUP BY 1")
def members(f):
    return tables.members(f, DAY("1997-03-01"), ["10-K", "10-Q"])


@query("src_27_ranked_union", "closes", sql="""WITH a AS (SELECT security_id, date, CASE WHEN volume % 3 = 0 THEN -99.99 ELSE floor(close) END AS value FROM closes WHERE security_id % 2 = 0), b AS (SELECT security_id, date, floor(close) + 1 AS value FROM closes), u AS (SELECT *, 0 AS file FROM a WHERE value != -99.99 UNION ALL SELECT *, 1 FROM b)
 SELECT security_id, date, value::DOUBLE AS value, CAST(file AS INT) AS file FROM u QUALIFY row_number() OVER (PARTITION BY security_id, date ORDER BY file) = 1""")
def ranked_union(c):
    a = c.where("security_id % 2 = 0").select("security_id", "date", F.when(F.col("volume") % 3 == 0, -99.99).otherwise(F.floor("close").cast("double")).alias("value"))
    return tables.ranked_union([a, c.select("security_id", "date", (F.floor("close").cast("double") + 1).alias("value"))], ["security_id", "date"])


@query("src_28_thin", "filings", "transactions", sql="""WITH f AS (SELECT id // 100 AS accession, count(*) AS n FROM transactions GROUP BY 1) SELECT accession, coalesce(n, 0) AS facts FROM filings LEFT JOIN f USING (accession) WHERE datediff('day', filed, DATE '1998-06-30') BETWEEN 0 AND 730 AND coalesce(n, 0) < 4 AND accession % 10 != 0""")
def thin(f, t):
    return tables.thin_partitions(f, t.select(F.floor(F.col("id") / 100).alias("accession")), f.where("accession % 10 = 0").select("accession"), DAY("1998-06-30"), least=4)


@query("src_29_orphans", "news", sql="SELECT topic, date, articles FROM news WHERE (topic, length(topic) + date_part('day', date) % 2) IN (SELECT topic, length(topic) FROM news WHERE topic != 'error')")
def orphans(n):
    rows = n.withColumn("content", F.length("topic") + F.dayofmonth("date") % 2)
    config = n.where("topic <> 'error'").select("topic", F.length("topic").alias("content")).distinct()
    return tables.without_orphans(rows, config, "topic", "content").select("topic", "date", "articles")
