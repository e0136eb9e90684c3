"""The given tables, and views that reshape them into market-data and research inputs.

Each view is one SQL text that Spark and the oracle run alike; sums go through
decimals so that they do not depend on the order of addition.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split()


def _sum(column: str, kind: str = "DOUBLE") -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS {kind})"


VIEWS = {
    "bars": f"""SELECT l_suppkey + 1 AS security_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'N' THEN 'deep' ELSE 'wide' END AS source,
        {_sum('l_extendedprice')} / {_sum('l_quantity')} AS close, {_sum('l_quantity', 'BIGINT')} AS volume FROM lineitem GROUP BY 1, 2, 3
        UNION ALL SELECT CAST(0 AS BIGINT), CAST(l_shipdate AS DATE), 'wide', {_sum('l_extendedprice')} / {_sum('l_quantity')}, {_sum('l_quantity', 'BIGINT')} FROM lineitem GROUP BY 2""",
    "actions": """SELECT l_suppkey + 1 AS security_id, CAST(l_shipdate AS DATE) AS ex_date, CASE WHEN l_linenumber = 7 THEN 'split' ELSE 'dividend' END AS action, 'wide' AS source,
        MAX(CASE WHEN l_linenumber = 7 THEN CASE WHEN l_linestatus = 'O' THEN CAST(2 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END ELSE l_discount * 100 END) AS value
        FROM lineitem WHERE (l_linenumber = 7 AND ROUND(l_tax * 100) = 8) OR (l_linenumber = 6 AND ROUND(l_tax * 100) = 0) GROUP BY 1, 2, 3""",
    "securities": """SELECT s_suppkey + 1 AS security_id, s_name AS ticker, s_suppkey % 60 AS cik, CASE s_suppkey % 4 WHEN 0 THEN 'ETF' WHEN 1 THEN 'ADRC' ELSE 'CS' END AS security_type,
        CASE s_nationkey % 3 WHEN 0 THEN 'XNYS' WHEN 1 THEN 'XNAS' ELSE 'OTC' END AS mic, CAST(100 + (s_suppkey * 97) % 9800 AS INT) AS sic, s_acctbal > 0 AS active FROM supplier""",
    "vintages": """SELECT event_type AS series_id, CAST(ts AS DATE) AS date, CAST(ts AS DATE) + CAST(user_id % 10 AS INT) AS realtime_start,
        CASE WHEN MAX(event_id) % 17 = 0 THEN NULL ELSE MAX(value) END AS value FROM events GROUP BY 1, 2, 3""",
    "insider_transactions": """SELECT o_orderkey AS id, o_custkey % 100 AS issuer_cik, o_orderkey % 37 AS owner_cik, CAST(o_orderdate AS DATE) AS trans_date,
        CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS filing_date, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'P' ELSE 'S' END AS trans_code,
        CAST(100 + o_orderkey % 900 AS DOUBLE) AS shares, o_totalprice / 1000 AS price, o_orderstatus = 'P' AS plan_10b5_1 FROM orders""",
    "positions": f"""SELECT o_custkey % 40 AS filer_cik, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period,
        lpad(CAST(l_partkey % 200 AS STRING), 9, '0') AS cusip, CASE WHEN l_returnflag = 'A' THEN 'PUT' ELSE '' END AS put_call,
        {_sum('l_quantity')} AS shares, {_sum('l_extendedprice')} AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4""",
    "transactions": """SELECT (l_orderkey * 10 + l_linenumber) * 10 + line_copy AS id, o_custkey % 20 AS account_id, CAST(l_shipdate AS DATE) AS trade_date, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS action,
        CAST(l_suppkey AS STRING) AS symbol, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS amount, CAST(0 AS DOUBLE) AS fees
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS line_copy FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey""",
    "statement_items": f"""SELECT o_custkey % 50 AS cik, 'revenue' AS line_item, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start,
        CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, 'USD' AS unit, {_sum('o_totalprice')} AS value,
        CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + CAST(40 AS INT) AS filed FROM orders GROUP BY 1, 3, 4""",
    "graph_flows": f"""SELECT sn.n_name AS supplier, cn.n_name AS buyer, {_sum('l_extendedprice')} AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey GROUP BY 1, 2""",
    "cot_positions": f"""SELECT l_suppkey % 12 AS market, l_returnflag AS trader, CAST(date_trunc('week', l_shipdate) AS DATE) + CAST(1 AS INT) AS report_date,
        CAST(SUM(CASE WHEN l_linenumber <= 3 THEN l_quantity ELSE 0 END) AS BIGINT) AS long_side, CAST(SUM(CASE WHEN l_linenumber > 3 THEN l_quantity ELSE 0 END) AS BIGINT) AS short_side, {_sum('l_quantity', 'BIGINT')} AS open_interest
        FROM lineitem GROUP BY 1, 2, 3""",
    "short_interest": f"""SELECT l_suppkey + 1 AS security_id, CAST(date_trunc('month', l_shipdate) AS DATE) + CAST(14 AS INT) AS settlement_date, {_sum('l_quantity', 'BIGINT')} AS position, COUNT(*) AS daily_volume
        FROM lineitem GROUP BY 1, 2""",
    "lobbying_reports": """SELECT o_orderkey AS id, o_custkey % 30 AS registrant, o_custkey % 11 AS client, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter,
        CAST(o_orderdate AS DATE) AS posted, o_totalprice AS amount FROM orders""",
    "lobbying_issues": "SELECT DISTINCT l_orderkey AS id, l_suppkey % 8 AS code FROM lineitem",
    "bills": """SELECT o_orderkey AS id, o_orderpriority AS area, o_custkey % 6 AS subject, CAST(o_orderdate AS DATE) AS introduced,
        CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(90 AS INT) END AS enacted FROM orders""",
    "obligations": f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, lpad(CAST(l_partkey % 300 AS STRING), 4, '3') AS naics, {_sum('l_extendedprice')} AS amount FROM lineitem GROUP BY 1, 2""",
    "news": "SELECT event_type AS topic, CAST(ts AS DATE) AS date, COUNT(*) AS articles, CAST(SUM(user_id) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    "fund_lots": """SELECT o_custkey % 10 AS fund, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST(date_trunc('quarter', o_orderdate) AS DATE) + CAST(o_orderkey % 3 AS INT) AS filed, l_partkey % 50 AS identifier, l_quantity AS shares, l_extendedprice AS value
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "congress_trades": """SELECT o_orderkey AS id, o_custkey % 25 AS member, o_custkey % 2 AS party, o_orderkey % 60 AS ticker, CAST(o_orderdate AS DATE) AS filed,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'purchase' ELSE 'sale' END AS trans_type, CAST(CASE WHEN o_totalprice > 200000 THEN 15001 ELSE 1001 END AS BIGINT) AS amount_min FROM orders""",
    "filings": """SELECT o_orderkey AS accession, o_custkey % 50 AS cik, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '10-K/A' WHEN '4-NOT SPECIFIED' THEN '8-K' ELSE '20-F' END AS form,
        CASE WHEN o_orderkey % 4 = 0 THEN '1.03,9.01' WHEN o_orderkey % 4 = 1 THEN '2.02' ELSE '' END AS items, CAST(o_orderdate AS DATE) AS filed, CAST(date_trunc('quarter', o_orderdate) AS DATE) - CAST(1 AS INT) AS period_end FROM orders""",
    "items": f"""SELECT o_custkey % 50 AS cik, CASE l_linenumber WHEN 1 THEN 'revenue' WHEN 2 THEN 'operating_income' WHEN 3 THEN 'net_income' WHEN 4 THEN 'operating_cash_flow' WHEN 5 THEN 'capex' WHEN 6 THEN 'interest_expense' ELSE 'tax' END AS line_item,
        CAST(date_trunc('year', o_orderdate) AS DATE) AS period_start, CAST(date_trunc('year', o_orderdate) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, CASE WHEN o_custkey % 7 = 0 THEN 'EUR' ELSE 'USD' END AS unit,
        CAST(SUM(CAST(floor(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice * 2 END / l_linenumber) AS BIGINT)) AS DOUBLE) AS value,
        CAST(date_trunc('year', o_orderdate) + INTERVAL 12 MONTH AS DATE) + CAST(60 AS INT) AS first_filed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4, 5, 7""",
    "balances": f"""SELECT o_custkey % 50 AS cik, CASE l_linenumber WHEN 1 THEN 'assets' WHEN 2 THEN 'liabilities' WHEN 3 THEN 'current_assets' WHEN 4 THEN 'current_liabilities' WHEN 5 THEN 'retained_earnings' WHEN 6 THEN 'cash' ELSE 'debt' END AS line_item,
        CAST(date_trunc('year', o_orderdate) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, CASE WHEN o_custkey % 7 = 0 THEN 'EUR' ELSE 'USD' END AS unit, CAST(SUM(CAST(floor(l_extendedprice * 9 / l_linenumber) AS BIGINT)) AS DOUBLE) AS value,
        CAST(date_trunc('year', o_orderdate) + INTERVAL 12 MONTH AS DATE) + CAST(60 AS INT) AS first_filed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4, 6""",
    "facts": """SELECT o_orderkey AS accession, o_custkey % 50 AS cik, CASE WHEN l_linenumber = 7 THEN 'dei' ELSE 'us-gaap' END AS taxonomy, 'c' || CAST(l_linenumber AS STRING) AS concept,
        CASE WHEN l_linenumber = 5 THEN 'shares' WHEN l_linenumber = 6 THEN 'USD/shares' WHEN o_custkey % 3 = 0 AND l_linenumber = 3 THEN 'EUR' ELSE 'USD' END AS unit, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN '10-K' ELSE '10-Q' END AS form,
        CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber IN (1, 2, 7) THEN CAST(date_trunc('quarter', o_orderdate) - INTERVAL 12 MONTH AS DATE) WHEN l_linenumber = 5 THEN CAST(date_trunc('quarter', o_orderdate) - INTERVAL 6 MONTH AS DATE) ELSE CAST(date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH AS DATE) END AS period_start,
        CAST(date_trunc('quarter', o_orderdate) AS DATE) - CAST(1 AS INT) AS period_end, CAST(o_orderdate AS DATE) + CAST(40 AS INT) AS filed, CAST(year(o_orderdate) - CASE WHEN o_custkey % 50 % 5 = 0 THEN 1 ELSE 0 END AS INT) AS fiscal_year, MAX(l_extendedprice) AS value
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10""",
    "papers": "SELECT doc_id AS number, CAST(DATE '1997-01-01' + CAST(doc_id % 900 AS INT) AS DATE) AS signed, source AS type, lang AS title FROM documents",
    "feed_log": """SELECT event_id AS id, event_type AS provider, CAST(user_id % 40 AS STRING) AS item, CAST(ts AS DATE) AS day, value < 3 AS error, md5(CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS body FROM events""",
}
#: A ledger with every kind of record: transfers, reinvestments and, for every third symbol, splits as a broker books them.
VIEWS["ledger"] = f"""SELECT id, account_id, trade_date, symbol, CASE WHEN id % 29 = 0 AND CAST(symbol AS BIGINT) % 3 = 0 THEN 'split' WHEN id % 7 = 0 THEN CASE WHEN action = 'buy' THEN 'transfer_in' ELSE 'transfer_out' END WHEN id % 7 = 1 AND action = 'buy' THEN 'reinvest' ELSE action END AS action,
        CASE WHEN id % 58 = 0 AND CAST(symbol AS BIGINT) % 3 = 0 THEN -quantity ELSE quantity END AS quantity, CASE WHEN id % 35 = 0 THEN NULL ELSE price END AS price, CASE WHEN id % 5 = 0 THEN NULL ELSE amount END AS amount, CAST(1.25 AS DOUBLE) AS fees FROM ({VIEWS['transactions']}) t"""
#: One close per security and day from all sources together (0: the market), and a series with holes.
VIEWS["closes"] = f"""SELECT l_suppkey + 1 AS security_id, CAST(l_shipdate AS DATE) AS date, {_sum('l_extendedprice')} / {_sum('l_quantity')} AS close, {_sum('l_quantity', 'BIGINT')} AS volume FROM lineitem GROUP BY 1, 2
        UNION ALL SELECT CAST(0 AS BIGINT), CAST(l_shipdate AS DATE), {_sum('l_extendedprice')} / {_sum('l_quantity')}, {_sum('l_quantity', 'BIGINT')} FROM lineitem GROUP BY 2"""
VIEWS["series"] = f"SELECT security_id AS key, date, CASE WHEN volume % 17 = 0 THEN NULL ELSE close END AS value FROM ({VIEWS['closes']}) c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the given tables as a DataFrame."""
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS[name])]
    text = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", VIEWS[name])
    tables = {t: table(spark, sf_dir, t) for t in used}
    if "PARTITION BY l_orderkey" in VIEWS[name]:  # dealt by order first: the numbering of its lines and the join with orders then share one shuffle
        tables["lineitem"] = tables["lineitem"].repartition("l_orderkey")
    return spark.sql(text, **tables)


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in used)
    sql = sql.strip()
    if not head:
        return sql
    if match := re.match(r"WITH (RECURSIVE )?", sql):
        return f"WITH {match[1] or ''}{head}, {sql[match.end():]}"
    return f"WITH {head} {sql}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    A local session without one, as in tests, gets a temporary folder; a cluster must name its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-tidemark-")
        context.setCheckpointDir(folder)
    return folder
