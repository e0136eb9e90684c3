"""Queries of disclosures and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import disclosures, identity
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)
DAY = lambda d: F.lit(d).cast("date")


@query("dis_03_congress_purchases", "congress_trades", sql="SELECT ticker, filed, count(*) AS trades FROM congress_trades WHERE trans_type = 'purchase' AND amount_min >= 15000 GROUP BY 1, 2")
def congress_purchases(t):
    return disclosures.congress_purchases(t, 15000)


@query("dis_05_filing_events", "filings", "securities", sql="SELECT DISTINCT f.cik, filed, l.security_id FROM filings f JOIN (SELECT cik, min(security_id) AS security_id FROM securities GROUP BY 1) l USING (cik) WHERE form LIKE '8-K%' AND (items LIKE '1.0%' OR items LIKE '%,1.0%')")
def filing_events(f, s):
    return disclosures.filing_events(f, s.groupBy("cik").agg(F.min("security_id").alias("security_id")), "1.0", "8-K")


@query("dis_10_holders", "positions", sql="""WITH c AS (SELECT DISTINCT cusip, CAST(right(cusip, 2) AS BIGINT) AS security_id FROM positions), r AS (SELECT * FROM positions JOIN c USING (cusip) WHERE put_call = ''), n AS (SELECT security_id, max(period) AS period FROM r GROUP BY 1), h AS (SELECT security_id, period, filer_cik, sum(shares) AS shares, sum(CAST(value AS DECIMAL(18, 2))) AS value FROM r JOIN n USING (security_id, period) GROUP BY 1, 2, 3)
 SELECT security_id, period, filer_cik, round(shares, 2) AS shares, round(CAST(value AS DOUBLE), 2) AS value, CAST(row_number() OVER (PARTITION BY security_id ORDER BY value DESC, filer_cik) AS INT) AS rank FROM h QUALIFY rank <= 5""")
def holders(p):
    cusips = p.select("cusip", F.right("cusip", F.lit(2)).cast("long").alias("security_id")).distinct()
    return disclosures.holders(p.withColumn("value", F.col("value").cast("decimal(18,2)")), cusips, 5).withColumns({"shares": R(F.col("shares"), 2), "value": R(F.col("value").cast("double"), 2)})


@query("dis_11_popularity", "congress_trades", sql="SELECT ticker, count(DISTINCT member) AS members, count(*) FILTER (trans_type = 'purchase') AS purchases, count(*) FILTER (trans_type = 'sale') AS sales, CAST(sum(amount_min) AS BIGINT) AS least_amount FROM congress_trades WHERE filed > DATE '1997-01-01' AND filed <= DATE '1998-01-01' GROUP BY 1")
def popularity(t):
    return disclosures.popularity(t, DAY("1997-01-01"), DAY("1998-01-01"))


@query("dis_11_committee", "congress_trades", "bills", sql="SELECT id, member, ticker FROM congress_trades WHERE party = 1 AND member IN (SELECT id % 25 FROM bills WHERE subject = 2)")
def committee(t, b):
    seats = b.select(F.col("subject").alias("committee"), (F.col("id") % 25).alias("member")).distinct()
    return disclosures.party_trades(t, seats, 1, 2).select("id", "member", "ticker")


@query("dis_12_current_reports", "lobbying_reports", sql="SELECT id, registrant, client, year, quarter, posted FROM lobbying_reports QUALIFY row_number() OVER (PARTITION BY registrant, client, year, quarter ORDER BY posted DESC, id DESC) = 1")
def current_reports(r):
    return disclosures.current_reports(r).select("id", "registrant", "client", "year", "quarter", "posted")


@query("dis_13_spend", "lobbying_reports", "lobbying_issues", sql="""WITH c AS (SELECT * FROM lobbying_reports QUALIFY row_number() OVER (PARTITION BY registrant, client, year, quarter ORDER BY posted DESC, id DESC) = 1), i AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM lobbying_issues)
 SELECT code, year, quarter, round(sum(amount / n), 0) AS amount, count(*) AS reports FROM c JOIN i USING (id) GROUP BY 1, 2, 3""")
def spend(r, i):
    return disclosures.spend_by_issue(r, i).withColumn("amount", R(F.col("amount"), 0))


@query("dis_14_obligations", "obligations", sql="SELECT substr(naics, 1, 3) AS prefix, month, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS amount FROM obligations GROUP BY 1, 2")
def obligations(o):
    return disclosures.obligations_by_prefix(o, 3)


@query("dis_15_bills", "bills", sql="SELECT area, step, CAST(date_trunc('month', d) AS DATE) AS month, count(*) AS n FROM (SELECT area, 'introduced' AS step, introduced AS d FROM bills UNION ALL SELECT area, 'enacted', enacted FROM bills WHERE enacted IS NOT NULL) GROUP BY 1, 2, 3")
def bills(b):
    return disclosures.bills_per_month(b)


@query("dis_16_calendar", "vintages", sql="""WITH r AS (SELECT DISTINCT series_id AS release, realtime_start AS date FROM vintages WHERE dayofmonth(realtime_start) % 3 = 0 OR series_id = 'click'), s AS (SELECT DISTINCT series_id AS release, series_id || dayofmonth(date) % 4 AS series_id FROM vintages), w AS (SELECT *, count(*) OVER (PARTITION BY release) AS n FROM r WHERE date > DATE '2024-01-05' AND date <= DATE '2024-01-30')
 SELECT release, date, (SELECT string_agg(series_id, ',' ORDER BY series_id) FROM s WHERE s.release = w.release) AS series FROM w WHERE n < 20""")
def calendar(v):
    releases = v.where((F.dayofmonth("realtime_start") % 3 == 0) | (F.col("series_id") == "click")).select(F.col("series_id").alias("release"), F.col("realtime_start").alias("date")).distinct()
    series = v.select(F.col("series_id").alias("release"), F.concat("series_id", (F.dayofmonth("date") % 4).cast("string")).alias("series_id")).distinct()
    return disclosures.release_calendar(releases, series, DAY("2024-01-05"), 25)


@query("dis_17_fund_members", "fund_lots", "securities", sql="""WITH k AS (SELECT * FROM fund_lots WHERE filed <= DATE '1998-08-15'), n AS (SELECT fund, max((period, filed)) AS p FROM k GROUP BY 1), h AS (SELECT k.fund, period, identifier, sum(value) AS value FROM k JOIN n ON n.fund = k.fund AND (k.period, k.filed) = n.p GROUP BY 1, 2, 3)
 SELECT fund, period, identifier, round(value, 2) AS value, round(value / sum(value) OVER (PARTITION BY fund), 6) AS weight, ticker FROM h LEFT JOIN securities ON security_id = identifier""")
def fund_members(f, s):
    out = disclosures.fund_members(f, s, DAY("1998-08-15"))
    return out.select("fund", "period", "identifier", R(F.col("value"), 2).alias("value"), R(F.col("weight")).alias("weight"), "ticker")


@query("dis_18_cot_summary", "cot_positions", sql="""WITH n AS (SELECT *, long_side - short_side AS net FROM cot_positions), r AS (SELECT *, net - lag(net) OVER o AS change, min(net) OVER w AS lo, max(net) OVER w AS hi FROM n WINDOW o AS (PARTITION BY market, trader ORDER BY report_date), w AS (PARTITION BY market, trader ORDER BY report_date ROWS 155 PRECEDING))
 SELECT market, trader, report_date, net, change, round(100.0::DOUBLE * net / nullif(open_interest, 0), 6) AS share, round(CASE WHEN hi > lo THEN 100.0::DOUBLE * (net - lo) / (hi - lo) ELSE 50 END, 6) AS "index" FROM r QUALIFY row_number() OVER (PARTITION BY market, trader ORDER BY report_date DESC) = 1""")
def cot_summary(c):
    return disclosures.cot_summary(c).withColumns({"share": R(F.col("share")), "index": R(F.col("index"))})


@query("dis_19_short_jumps", "short_interest", sql="WITH l AS (SELECT *, position / nullif(lag(position) OVER (PARTITION BY security_id ORDER BY settlement_date), 0)::DOUBLE - 1 AS change FROM short_interest) SELECT security_id, settlement_date, round(change, 6) AS change FROM l WHERE abs(change) >= 0.25")
def short_jumps(s):
    return disclosures.short_jumps(s).withColumn("change", R(F.col("change")))


@query("dis_20_holder_change", "positions", sql="""WITH r AS (SELECT cusip, period, count(DISTINCT filer_cik) AS holders, sum(shares) AS shares FROM positions WHERE put_call = '' GROUP BY 1, 2), l AS (SELECT *, lag(period) OVER w = last_day(period - INTERVAL 3 MONTH) AS f, lag(holders) OVER w AS h, lag(shares) OVER w AS s FROM r WINDOW w AS (PARTITION BY cusip ORDER BY period))
 SELECT cusip, period, holders, round(shares, 2) AS shares, CASE WHEN f THEN holders - h END AS holders_change, CASE WHEN f THEN round(shares - s, 2) END AS shares_change FROM l""")
def holder_change(p):
    return disclosures.holder_change(p).withColumns({"shares": R(F.col("shares"), 2), "shares_change": R(F.col("shares_change"), 2)})


@query("dis_21_insider_trades", "insider_transactions", sql="SELECT issuer_cik, id, trans_date, CAST(row_number() OVER (PARTITION BY issuer_cik ORDER BY trans_date DESC, id DESC) AS INT) AS rank FROM insider_transactions WHERE trans_code = 'P' QUALIFY rank <= 10")
def insider_trades(t):
    return disclosures.insider_trades(t, "P", 10).select("issuer_cik", "id", "trans_date", "rank")


SYMBOLS = """cur AS (SELECT ticker AS symbol, security_id, DATE '1997-01-01' AS renamed_on FROM securities WHERE security_id % 3 != 0), his AS (SELECT ticker AS symbol, (security_id + 1) AS security_id, DATE '1996-12-31' AS last_seen FROM securities WHERE security_id % 2 = 0)"""


def _symbols(s):
    current = s.where("security_id % 3 <> 0").select(F.col("ticker").alias("symbol"), "security_id", DAY("1997-01-01").alias("renamed_on"))
    history = s.where("security_id % 2 = 0").select(F.col("ticker").alias("symbol"), (F.col("security_id") + 1).alias("security_id"), DAY("1996-12-31").alias("last_seen"))
    return current, history


@query("idn_02_attach", "closes", "securities", sql=f"""WITH {SYMBOLS}, r AS (SELECT ticker AS symbol, date, floor(close) AS close FROM closes JOIN securities USING (security_id))
 SELECT symbol, date, r.close, coalesce(CASE WHEN his.last_seen >= date THEN his.security_id END, CASE WHEN cur.security_id IS NOT NULL THEN CASE WHEN date > cur.renamed_on THEN cur.security_id END ELSE his.security_id END) AS security_id FROM r LEFT JOIN cur USING (symbol) LEFT JOIN his USING (symbol)
 WHERE coalesce(CASE WHEN his.last_seen >= date THEN his.security_id END, CASE WHEN cur.security_id IS NOT NULL THEN CASE WHEN date > cur.renamed_on THEN cur.security_id END ELSE his.security_id END) IS NOT NULL""")
def attach(closes, s):
    current, history = _symbols(s)
    rows = closes.join(s.select("security_id", F.col("ticker").alias("symbol")), "security_id").select("symbol", "date", F.floor("close").cast("double").alias("close"))
    return identity.attach_ids(rows, history, current)


@query("idn_03_current_else_latest", "securities", sql=f"WITH {SYMBOLS} SELECT ticker AS symbol, coalesce(cur.security_id, his.security_id) AS security_id FROM securities LEFT JOIN cur ON cur.symbol = ticker LEFT JOIN his ON his.symbol = ticker")
def current_else_latest(s):
    current, history = _symbols(s)
    return identity.current_else_latest(s.select(F.col("ticker").alias("symbol")), current, history)


@query("idn_04_first_link", "securities", "positions", sql="""WITH s AS (SELECT security_id, CASE WHEN security_id % 3 = 0 THEN 'F' || security_id END AS figi, CASE WHEN security_id % 2 = 0 THEN 'C' || security_id END AS class, ticker FROM securities), c AS (SELECT DISTINCT cusip, CAST(right(cusip, 3) AS BIGINT) AS n FROM positions), k AS (SELECT cusip, 'F' || n AS figi, 'C' || n AS class, 'Supplier#' || lpad(CAST(n AS VARCHAR), 9, '0') AS ticker FROM c)
 SELECT cusip, coalesce(a.security_id, b.security_id, t.security_id) AS security_id, CAST(CASE WHEN a.security_id IS NOT NULL THEN 0 WHEN b.security_id IS NOT NULL THEN 1 WHEN t.security_id IS NOT NULL THEN 2 END AS INT) AS step FROM k LEFT JOIN s a ON a.figi = k.figi LEFT JOIN s b ON b.class = k.class LEFT JOIN s t ON t.ticker = k.ticker""")
def first_link(s, p):
    secs = s.select("security_id", F.when(F.col("security_id") % 3 == 0, F.concat(F.lit("F"), F.col("security_id").cast("string"))).alias("figi2"), F.when(F.col("security_id") % 2 == 0, F.concat(F.lit("C"), F.col("security_id").cast("string"))).alias("class2"), F.col("ticker").alias("ticker2"))
    n = F.right("cusip", F.lit(3)).cast("long").cast("string")
    rows = p.select("cusip").distinct().select("cusip", F.concat(F.lit("F"), n).alias("figi"), F.concat(F.lit("C"), n).alias("class"), F.concat(F.lit("Supplier#"), F.lpad(n, 9, "0")).alias("ticker"))
    return identity.first_link(rows, secs, [("figi", "figi2"), ("class", "class2"), ("ticker", "ticker2")]).select("cusip", "security_id", "step")


@query("idn_05_unmapped", "positions", "fund_lots", sql="WITH h AS (SELECT cusip FROM positions UNION SELECT lpad(CAST(identifier * 7 AS VARCHAR), 9, '0') FROM fund_lots) SELECT cusip FROM h WHERE CAST(cusip AS BIGINT) % 5 != 0 AND CAST(cusip AS BIGINT) % 3 != 0")
def unmapped(p, f):
    funds = f.select(F.lpad((F.col("identifier") * 7).cast("string"), 9, "0").alias("cusip"))
    every = p.select("cusip").unionByName(funds).distinct()
    n = F.col("cusip").cast("long")
    return identity.unmapped([p, funds], every.where(n % 5 == 0), every.where(n % 3 == 0))


@query("idn_09_names", "securities", sql="SELECT security_id, security_id % 3 != 0 AS alike FROM securities")
def names(s):
    k = F.col("security_id").cast("string")
    other = F.when(F.col("security_id") % 3 == 0, F.concat(F.lit("Delta Gas "), k)).when(F.col("security_id") % 3 == 1, F.concat(F.lit("THE ALPHA OIL "), k, F.lit(" LTD"))).otherwise(F.concat(F.lit("Alpha Oil and Gas "), k))
    return s.select("security_id", identity.names_match(identity.name_tokens(F.concat(F.lit("Alpha Oil "), k, F.lit(" Inc."))), identity.name_tokens(other)).alias("alike"))


@query("idn_10_cross_listings", "securities", sql="SELECT security_id AS left_id, security_id + 1000000 AS right_id FROM securities WHERE security_id % 4 != 0")
def cross_listings(s):
    word = F.translate(F.col("security_id").cast("string"), "0123456789", "abcdefghij")
    left = s.select(F.col("security_id").alias("id"), F.concat(word, F.lit(" Motor Corp")).alias("name"))
    right = s.where("security_id % 4 <> 0").select((F.col("security_id") + 1_000_000).alias("id"), F.concat(word, F.lit(" MOTORS PLC-SPON ADR B")).alias("name"))
    return identity.match_names(left, right)


@query("idn_11_ratios", "closes", sql="""WITH r AS (SELECT * FROM closes WHERE date <= DATE '1998-06-30' AND date > DATE '1998-06-30' - 180 AND close > 0), p AS (SELECT a.security_id AS receipt, b.security_id AS ordinary, a.date, min_by(a.close / b.close, a.date - b.date) AS q FROM r a JOIN r b ON b.security_id = a.security_id + 1 AND a.date - b.date BETWEEN 0 AND 1 WHERE a.security_id % 2 = 1 GROUP BY 1, 2, 3),
 m AS (SELECT receipt, ordinary, count(*) AS n, median(q) AS ratio FROM p GROUP BY 1, 2 HAVING count(*) >= 3), k(v) AS (SELECT unnest([0.1, 0.125, 0.2, 0.25, 1/3, 0.5, 1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 25, 40, 50, 100]::DOUBLE[])), z AS (SELECT receipt, ordinary, n, ratio, (SELECT arg_min(v, abs(ratio - v) / v) FROM k) AS nice FROM m)
 SELECT receipt, ordinary, n, round(ratio, 6) AS ratio, CASE WHEN abs(ratio / nice - 1) <= 0.08 THEN round(nice, 6) END AS nice FROM z""")
def ratios(closes):
    pairs = closes.where("security_id % 2 = 1").select(F.col("security_id").alias("receipt"), (F.col("security_id") + 1).alias("ordinary")).distinct()
    return identity.inferred_ratios(pairs, closes, DAY("1998-06-30")).withColumns({"ratio": R(F.col("ratio")), "nice": R(F.col("nice"))})


@query("idn_16_prefix_classes", "obligations", sql="""WITH c AS (SELECT DISTINCT naics AS code FROM obligations UNION SELECT '331'), p("group", prefix) AS (VALUES ('metals', '3311'), ('parts', '332'), ('few', '33')), k AS (SELECT 'metals' AS "group", '3320' AS code),
 r AS (SELECT "group", code, 1 AS r FROM c JOIN p ON starts_with(code, prefix) UNION ALL SELECT "group", code, 0 FROM c JOIN p ON starts_with(prefix, code) AND length(code) > 2 UNION ALL SELECT *, 2 FROM k) SELECT "group", code, CASE max(r) WHEN 2 THEN 'curated' WHEN 1 THEN 'full' ELSE 'partial' END AS how FROM r GROUP BY 1, 2""")
def prefix_classes(o):
    spark = o.sparkSession
    codes = o.select(F.col("naics").alias("code")).unionByName(spark.createDataFrame([("331",)], "code string")).distinct()
    prefixes = spark.createDataFrame([("metals", "3311"), ("parts", "332"), ("few", "33")], "group string, prefix string")
    return identity.prefix_classes(codes, prefixes, spark.createDataFrame([("metals", "3320")], "group string, code string"))


@query("idn_18_capped", "filings", sql="""WITH c AS (SELECT DISTINCT 'g' || cik % 3 AS "group", cik AS company, cik % 11 = 0 AS named, CAST(cik * 37 % 101 AS DOUBLE) AS size FROM filings UNION SELECT DISTINCT 'g' || (cik + 1) % 3, cik, false, CAST(cik * 37 % 101 AS DOUBLE) FROM filings),
 a AS (SELECT *, row_number() OVER (ORDER BY named DESC, size DESC NULLS LAST, company) AS rank FROM c WHERE "group" = 'g0' QUALIFY rank <= 9), b AS (SELECT *, row_number() OVER (ORDER BY named DESC, size DESC NULLS LAST, company) AS rank FROM c WHERE "group" = 'g1' AND company NOT IN (SELECT company FROM a) QUALIFY rank <= 9),
 d AS (SELECT *, row_number() OVER (ORDER BY named DESC, size DESC NULLS LAST, company) AS rank FROM c WHERE "group" = 'g2' AND company NOT IN (SELECT company FROM a UNION SELECT company FROM b) QUALIFY rank <= 9) SELECT "group", company, CAST(rank AS INT) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d)""")
def capped(f):
    ciks = f.select("cik").distinct()
    row = lambda shift, named: ciks.select(F.concat(F.lit("g"), ((F.col("cik") + shift) % 3).cast("string")).alias("group"), F.col("cik").alias("company"), named.alias("named"), (F.col("cik") * 37 % 101).cast("double").alias("size"))
    return identity.capped_assignment(row(0, F.col("cik") % 11 == 0).unionByName(row(1, F.lit(False))).distinct(), ["g0", "g1", "g2"], 9)


@query("idn_21_enriched", "securities", sql="""SELECT CASE WHEN security_id % 5 = 0 THEN 'new' || security_id ELSE ticker END AS symbol, CASE WHEN security_id % 5 = 0 THEN 'second' ELSE 'first' END AS name, CASE WHEN security_id % 7 != 0 THEN 'CS' END AS kind, CASE WHEN security_id % 7 != 0 THEN mic END AS exchange, CASE WHEN security_id % 5 = 0 THEN ticker END AS known_as, CASE WHEN security_id % 5 = 0 THEN CASE WHEN security_id % 2 = 0 THEN 'rename' ELSE 'alias' END WHEN security_id % 7 = 0 THEN 'kept' ELSE 'filled' END AS what FROM securities WHERE NOT (security_id % 5 = 0 AND security_id % 7 = 0)
 UNION ALL SELECT ticker, 'first', NULL, NULL, NULL, 'kept' FROM securities WHERE security_id % 5 = 0""")
def enriched(s):
    k = F.col("security_id")
    figi = F.concat(F.lit("F"), k.cast("string"))
    first = s.select(F.col("ticker").alias("symbol"), F.lit("first").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("exchange"), figi.alias("figi"), (k % 2 == 0).alias("owned"))
    second = s.where(k % 7 != 0).select(F.when(k % 5 == 0, F.concat(F.lit("new"), k.cast("string"))).otherwise(F.col("ticker")).alias("symbol"), F.lit("second").alias("name"), F.lit("CS").alias("kind"), F.col("mic").alias("exchange"), figi.alias("figi"))
    return identity.enriched(first, second)


@query("idn_22_delisted", "closes", "securities", sql="""SELECT ticker AS symbol, date, CASE WHEN security_id % 4 = 0 THEN 'new' WHEN security_id % 4 = 1 THEN 'separate' ELSE 'delisted' END AS what, CASE WHEN security_id % 4 = 0 THEN CASE WHEN date <= DATE '1997-06-30' THEN ticker || '*' END WHEN security_id % 4 = 1 AND date <= DATE '1997-06-30' THEN ticker || '*' ELSE CAST(security_id AS VARCHAR) END AS entity FROM closes JOIN securities USING (security_id) WHERE security_id % 3 = 0""")
def delisted(closes, s):
    k = F.col("security_id")
    rows = closes.join(s.select("security_id", F.col("ticker").alias("symbol")), "security_id").select("symbol", "date")
    gone = s.where(k % 3 == 0).select(F.col("ticker").alias("symbol"), F.when(k % 4 == 2, None).otherwise(F.lit("A")).alias("figi"), DAY("1997-06-30").alias("until"))
    current = s.where(k % 4 != 0).select(F.col("ticker").alias("symbol"), "security_id", F.when(k % 4 == 1, "B").otherwise("A").alias("figi"))
    return identity.delisted_moves(rows, gone, current)


@query("idn_23_home_market", "securities", sql="SELECT DISTINCT cik FROM securities WHERE cik % 5 != 0")
def home_market(s):
    same = s.select("cik", F.when(F.col("cik") % 5 == 0, F.col("cik") + 1).alias("home")).distinct()
    return identity.without_cross_listings(s.select("cik").distinct(), same)


@query("idn_25_find_names", "securities", sql="SELECT security_id, ticker AS name FROM securities WHERE contains(lower(ticker), 'r#00000000') ORDER BY ticker LIMIT 8")
def find_names(s):
    return identity.find_names(s.select("security_id", F.col("ticker").alias("name")), "R#00000000", 8)
