"""Queries of fundamentals, company metrics and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fundamentals, metrics, prices
from tidemark.plans.registry import query

R = lambda c, d=6: F.round(c, d)
DAY = lambda d: F.lit(d).cast("date")
KIND = "CASE WHEN period_start IS NULL THEN 'instant' WHEN datediff('day', period_start, period_end) + 1 BETWEEN 80 AND 100 THEN 'quarter' WHEN datediff('day', period_start, period_end) + 1 BETWEEN 170 AND 195 THEN 'half' WHEN datediff('day', period_start, period_end) + 1 BETWEEN 260 AND 285 THEN 'nine_months' WHEN datediff('day', period_start, period_end) + 1 BETWEEN 350 AND 380 THEN 'annual' ELSE 'other' END"
ENDS = f"""fe AS (SELECT cik, accession, max((period_end, fiscal_year)) AS x FROM facts WHERE taxonomy != 'dei' AND form = '10-K' AND period_end <= filed AND {KIND} = 'annual' GROUP BY 1, 2), fl AS (SELECT cik, x[1] AS period_end, x[2] AS fiscal_year, count(*) AS n FROM fe GROUP BY 1, 2, 3), ends AS (SELECT cik, period_end, max_by(fiscal_year, (n, fiscal_year)) AS fiscal_year FROM fl GROUP BY 1, 2)"""


def _ends(f):
    return fundamentals.fiscal_ends(f)


def _years(f):
    own = F.when((F.col("cik") % 6 == 0) & (F.col("period_end") >= "1998-01-01"), (F.col("cik") + 1) % 4 + 1).otherwise(F.col("cik") % 4 + 1)
    return _ends(f).where(F.quarter("period_end") == own)


@query("fnd_02_fiscal_ends", "facts", sql=f"WITH {ENDS} SELECT cik, period_end, fiscal_year FROM ends")
def fiscal_ends(f):
    return _ends(f)


def _regime_rounds(rounds: int = 8) -> str:
    """The fixpoint as so many rounds one after the other; the test data need fewer."""
    place = lambda d: f"dayofyear(make_date(2000, month({d}), day({d})))"
    away = f"abs({place('period_end')} - {place('p')})"
    parts = [f"{ENDS}, s0 AS (SELECT * FROM ends WHERE quarter(period_end) = CASE WHEN cik % 6 = 0 AND period_end >= DATE '1998-01-01' THEN (cik + 1) % 4 + 1 ELSE cik % 4 + 1 END)"]
    for k in range(rounds):
        parts.append(f"g{k} AS MATERIALIZED (SELECT * EXCLUDE (b, p), sum(b) OVER (PARTITION BY cik ORDER BY period_end) AS segment FROM (SELECT *, CASE WHEN p IS NULL OR least({away}, 366 - {away}) > 10 THEN 1 ELSE 0 END AS b FROM (SELECT *, lag(period_end) OVER (PARTITION BY cik ORDER BY period_end) AS p FROM s{k})))")
        parts.append(f"s{k + 1} AS (SELECT cik, period_end, fiscal_year FROM (SELECT *, count(*) OVER (PARTITION BY cik, segment) AS n, max(segment) OVER (PARTITION BY cik) AS m FROM g{k}) WHERE n > 1 OR segment = m)")
    last = f"g{rounds - 1}"
    nominal = lambda y: f"make_date({y}, month(l), least(day(l), day(last_day(make_date({y}, month(l), 1)))))"
    late = "(period_end - 10)"
    end = f"CASE WHEN {nominal(f'year({late})')} >= {late} THEN year({late}) ELSE year({late}) + 1 END"
    parts.append(f"o AS (SELECT cik, segment, l, fiscal_year - {end} AS offs, count(*) AS n, min(period_end) AS f FROM (SELECT *, max(period_end) OVER (PARTITION BY cik, segment) AS l FROM {last}) GROUP BY 1, 2, 3, 4)")
    return "WITH " + ", ".join(parts) + " SELECT cik, CAST(segment AS BIGINT) AS segment, CAST(month(any_value(l)) AS INT) AS month, CAST(day(any_value(l)) AS INT) AS day, CAST(arg_max(offs, (n, -epoch(f))) AS INT) AS \"offset\", any_value(l) AS last_end FROM o GROUP BY 1, 2"


@query("fnd_02_transition_ends", "facts", sql=f"""WITH k AS (SELECT *, CASE WHEN accession % 19 = 0 THEN '10-KT' WHEN accession % 23 = 0 THEN '10-K/A' ELSE form END AS f, CASE WHEN accession % 7 = 0 THEN 'Q4' ELSE 'FY' END AS fp FROM facts), fe AS (SELECT cik, accession, max((period_end, fiscal_year)) AS x FROM k WHERE taxonomy != 'dei' AND period_start IS NOT NULL AND period_end <= filed AND (f = '10-KT' OR (f IN ('10-K', '10-K/A') AND fp = 'FY' AND {KIND} = 'annual')) GROUP BY 1, 2),
 fl AS (SELECT cik, x[1] AS period_end, x[2] AS fiscal_year, count(*) AS n FROM fe GROUP BY 1, 2, 3) SELECT cik, period_end, max_by(fiscal_year, (n, fiscal_year)) AS fiscal_year FROM fl GROUP BY 1, 2""")
def transition_ends(f):
    form = F.when(F.col("accession") % 19 == 0, "10-KT").when(F.col("accession") % 23 == 0, "10-K/A").otherwise(F.col("form"))
    return fundamentals.fiscal_ends(f.withColumns({"form": form, "filing_period": F.when(F.col("accession") % 7 == 0, "Q4").otherwise("FY")}))


@query("fnd_03_regimes", "facts", sql=_regime_rounds())
def regimes(f):
    return fundamentals.year_end_regimes(_years(f)).select("cik", "segment", "month", "day", "offset", "last_end")


@query("fnd_04_located", "facts")
def located(f):
    days = f.select("cik", F.col("period_end").alias("date")).distinct()
    return fundamentals.located(days, fundamentals.year_end_regimes(_years(f))).select("cik", "date", "year_end", "fiscal_year", "quarter")


@query("fnd_05_transitions", "facts")
def transitions(f):
    periods = f.where("period_start IS NOT NULL").select("cik", "period_start", "period_end").distinct()
    return fundamentals.transitions(periods, fundamentals.year_end_regimes(_years(f)))


@query("fnd_06_labels", "facts", sql=f"""WITH k AS (SELECT accession, concept, {KIND} AS kind, quarter(period_end) AS q FROM facts) SELECT accession, concept, kind, CASE kind WHEN 'annual' THEN 'FY' WHEN 'quarter' THEN 'Q' || q WHEN 'half' THEN CASE WHEN q <= 2 THEN 'H1' ELSE 'H2' END WHEN 'nine_months' THEN '9M' WHEN 'instant' THEN CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END END AS fiscal_period FROM k""")
def labels(f):
    places = f.select("cik", F.col("period_end").alias("date")).distinct().select("cik", "date", F.year("date").alias("fiscal_year"), F.quarter("date").alias("quarter"))
    return fundamentals.fact_labels(f, places).select("accession", "concept", "kind", "fiscal_period")


@query("fnd_07_report_period", "facts", sql="SELECT accession, max(period_end) AS period_end FROM facts WHERE taxonomy != 'dei' AND period_start IS NOT NULL AND period_end <= filed GROUP BY 1")
def report_period(f):
    return fundamentals.report_period_end(f)


@query("fnd_09_split_restated", "facts", "actions", sql="""WITH sp AS (SELECT security_id % 50 AS cik, ex_date, max(value) AS ratio FROM actions WHERE action = 'split' AND security_id <= 60 GROUP BY 1, 2), j AS (SELECT accession, concept, unit, f.value, product(coalesce(ratio, 1)) AS k FROM facts f LEFT JOIN sp ON sp.cik = f.cik AND sp.ex_date > filed AND sp.ex_date <= DATE '1999-06-30' GROUP BY ALL)
 SELECT accession, concept, round(CASE WHEN unit = 'shares' THEN value * k WHEN unit LIKE '%/shares' THEN value / k ELSE value END, 4) AS value FROM j""")
def split_restated(f, a):
    splits = a.where("action = 'split' AND security_id <= 60").groupBy((F.col("security_id") % 50).alias("cik"), "ex_date").agg(F.max("value").alias("ratio"))
    return fundamentals.split_restated(f, splits, DAY("1999-06-30")).select("accession", "concept", R(F.col("value"), 4).alias("value"))


@query("fnd_10_fourth_quarters", "statement_items", sql="SELECT cik, CAST(year(period_end) AS INT) AS fiscal_year, round(value, 2) AS value FROM statement_items WHERE quarter(period_end) = 4 AND (cik, year(period_end)) IN (SELECT cik, year(period_end) FROM statement_items GROUP BY 1, 2 HAVING count(*) = 4)")
def fourth_quarters(s):
    out = fundamentals.standalone_quarters(fundamentals.cumulative(s)).where("quarter = 4 AND derived")
    return out.select("cik", "fiscal_year", R(F.col("value"), 2).alias("value"))


@query("fnd_11_fact_query", "facts", sql=f"SELECT cik, max_by(accession, (filed, accession, value)) AS accession, period_start, period_end, max_by(value, (filed, accession, value)) AS value, max(filed) AS filed FROM facts WHERE concept = 'c1' AND unit = 'USD' AND form = '10-K' AND {KIND} = 'annual' GROUP BY cik, period_start, period_end")
def fact_query(f):
    return fundamentals.fact_query(f, "c1", "USD", "annual", "10-K")


CONCEPTS = [("c1", "revenue", 1), ("c2", "revenue", 2), ("c3", "income", 1), ("c7", "income", 2), ("c4", "assets", 1)]


@query("fnd_12_line_items", "facts", sql="""WITH m(concept, line_item, rank) AS (VALUES ('c1', 'revenue', 1), ('c2', 'revenue', 2), ('c3', 'income', 1), ('c7', 'income', 2), ('c4', 'assets', 1))
 SELECT cik, line_item, period_start, period_end, concept, unit, value, filed FROM facts JOIN m USING (concept) QUALIFY row_number() OVER (PARTITION BY cik, line_item, period_start, period_end ORDER BY (unit != 'USD')::INT, rank, filed DESC, accession) = 1""")
def line_items(f):
    table = f.sparkSession.createDataFrame(CONCEPTS, "concept string, line_item string, rank int")
    return fundamentals.line_items(f, table, F.lit("USD"))


@query("fnd_13_currency", "facts", sql="WITH p AS (SELECT DISTINCT cik, period_start, period_end, unit FROM facts WHERE length(unit) = 3), n AS (SELECT cik, unit, count(*) AS n FROM p GROUP BY 1, 2) SELECT cik, max_by(unit, (n, unit)) AS currency FROM n GROUP BY 1")
def currency(f):
    return fundamentals.reporting_currency(f)


@query("fnd_15_kinds", "facts", sql=f"SELECT accession, concept FROM facts WHERE CASE WHEN concept = 'c4' THEN {KIND} = 'instant' ELSE {KIND} IN ('annual', 'quarter') OR {KIND} IN ('half', 'nine_months') AND unit NOT LIKE '%shares' END")
def kinds(f):
    return fundamentals.of_kind(f.withColumn("stock", F.col("concept") == "c4")).select("accession", "concept")


@query("fnd_17_statement", "balances", sql="""WITH p AS (SELECT cik, period_end, max(value) FILTER (line_item = 'assets') AS assets, max(value) FILTER (line_item = 'liabilities') AS liabilities, max(value) FILTER (line_item = 'cash') AS cash FROM balances GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) AS INT) AS rank FROM p QUALIFY rank <= 3""")
def statement(b):
    return fundamentals.statement(b, ["assets", "liabilities", "cash"], 3)


@query("fnd_18_derived", "balances", sql="SELECT cik, period_end, CASE WHEN line_item IN ('debt', 'current_liabilities') THEN 'interest_bearing' ELSE 'liquid' END AS concept, round(sum(value), 2) AS value FROM balances WHERE line_item IN ('debt', 'current_liabilities', 'cash') GROUP BY 1, 2, 3")
def derived(b):
    parts = b.sparkSession.createDataFrame([("debt", "interest_bearing"), ("current_liabilities", "interest_bearing"), ("cash", "liquid")], "line_item string, concept string")
    return fundamentals.derived_sums(b, parts).withColumn("value", R(F.col("value"), 2))


@query("fnd_19_listings", "facts", sql="SELECT cik, taxonomy, concept, unit, count(*) AS facts, min(filed) AS first, max(filed) AS last FROM facts GROUP BY 1, 2, 3, 4")
def listings(f):
    return fundamentals.listings(f)


@query("met_01_trailing_or_year", "statement_items", "items", sql="""WITH g AS (SELECT *, count(value) OVER w4 AS n, sum(value) OVER w4 AS ttm, datediff('day', min(period_start) OVER w4, period_end) + 1 AS d, datediff('day', lag(period_end) OVER o, period_start) BETWEEN 1 AND 7 AS ok FROM statement_items WINDOW o AS (PARTITION BY cik ORDER BY period_end), w4 AS (PARTITION BY cik ORDER BY period_end ROWS 3 PRECEDING)),
 q AS (SELECT cik, max((period_end, ttm)) AS q FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY cik ORDER BY period_end ROWS 2 PRECEDING) AS c FROM g) WHERE n = 4 AND c = 3 AND d BETWEEN 350 AND 380 AND period_end <= DATE '1998-06-30' GROUP BY 1), y AS (SELECT cik, max((period_end, value)) AS y FROM items WHERE line_item = 'revenue' AND unit = 'USD' AND period_end <= DATE '1998-12-31' GROUP BY 1)
 SELECT coalesce(q.cik, y.cik) AS cik, CASE WHEN q IS NOT NULL AND (y IS NULL OR q[1] >= y[1]) THEN q[1] ELSE y[1] END AS period_end, round(CASE WHEN q IS NOT NULL AND (y IS NULL OR q[1] >= y[1]) THEN q[2] ELSE y[2] END, 2) AS ttm FROM q FULL OUTER JOIN y ON y.cik = q.cik""")
def trailing_or_year(s, items):
    years = items.where("line_item = 'revenue' AND unit = 'USD' AND period_end <= '1998-12-31'")
    return fundamentals.trailing_or_year(s.where("period_end <= '1998-06-30'"), years).select("cik", "period_end", R(F.col("ttm"), 2).alias("ttm"))


DOLLARS = """own AS (SELECT cik, max_by(unit, (period_end, unit)) AS currency FROM items WHERE line_item IN ('revenue', 'net_income', 'assets') GROUP BY 1), dol AS (SELECT i.* REPLACE (value * CASE unit WHEN 'EUR' THEN 1.25::DOUBLE ELSE 1 END AS value), currency FROM items i JOIN own USING (cik) WHERE unit = currency)"""


def _dollars(items):
    rates = items.sparkSession.createDataFrame([("USD", 1.0), ("EUR", 1.25)], "unit string, rate double")
    return metrics.in_dollars(items, rates)


@query("met_03_dollars", "items", sql=f"WITH {DOLLARS} SELECT cik, line_item, period_end, currency, round(value, 2) AS value FROM dol")
def dollars(items):
    return _dollars(items).select("cik", "line_item", "period_end", "currency", R(F.col("value"), 2).alias("value"))


@query("met_04_split_alignment", "facts", "actions", sql="""WITH sp AS (SELECT security_id % 50 AS cik, ex_date, max(value) AS ratio FROM actions WHERE action = 'split' AND security_id <= 60 GROUP BY 1, 2), j AS (SELECT accession, f.value, product(coalesce(ratio, 1)) AS k FROM facts f LEFT JOIN sp ON sp.cik = f.cik AND sp.ex_date > filed AND sp.ex_date <= DATE '1998-06-30' WHERE unit = 'shares' GROUP BY ALL) SELECT accession, round(value * k, 8) AS shares FROM j""")
def split_alignment(f, a):
    splits = a.where("action = 'split' AND security_id <= 60").groupBy((F.col("security_id") % 50).alias("cik"), "ex_date").agg(F.max("value").alias("ratio"))
    return fundamentals.split_restated(f.where("unit = 'shares'"), splits, DAY("1998-06-30")).select("accession", R(F.col("value"), 8).alias("shares"))


NOW = "DATE '1999-06-30'"
ITEMS = f"""kn AS (SELECT cik, line_item, period_end, value FROM items WHERE first_filed <= {NOW} AND unit = 'USD' UNION ALL SELECT cik, line_item, period_end, value FROM balances WHERE first_filed <= {NOW} AND unit = 'USD'), en AS (SELECT cik, max(period_end) AS e FROM kn WHERE line_item IN ('revenue', 'net_income', 'assets') GROUP BY 1 HAVING datediff('day', max(period_end), {NOW}) <= 550),
 w AS (SELECT cik, e AS period_end, {', '.join(f"max_by(value, period_end) FILTER (line_item = '{n}' AND period_end <= e AND datediff('day', period_end, e) <= 400) AS {n}, max_by(value, period_end) FILTER (line_item = '{n}' AND period_end <= e - 365 AND datediff('day', period_end, e - 365) <= 400) AS {n}_0" for n in ("revenue", "operating_income", "net_income", "operating_cash_flow", "capex", "interest_expense", "tax", "assets", "liabilities", "current_assets", "current_liabilities", "retained_earnings", "cash", "debt"))} FROM kn JOIN en USING (cik) GROUP BY 1, 2)"""
WIDE = f"""{ITEMS}, pr AS (SELECT cik, max_by(close, (date, security_id)) AS price FROM closes JOIN securities USING (security_id) WHERE date <= {NOW} GROUP BY 1),
 b AS (SELECT w.*, price, 1000 + cik AS shares, price * (1000 + cik) AS mc, operating_cash_flow - coalesce(capex, 0) AS fcf, coalesce(cash, 0) AS csh, coalesce(debt, 0) AS dbt, assets - liabilities AS equity FROM w JOIN pr USING (cik)),
 m AS (SELECT *, mc + dbt - csh AS ev, equity + dbt - csh AS invested, least(greatest(0.21, 0), 0.5) AS rate FROM b)"""


def _wide(items, balances):
    out = metrics.wide_items(items.where("unit = 'USD'"), balances.where("unit = 'USD'"), DAY("1999-06-30"))
    return out.withColumns({"shares": (1000 + F.col("cik")).cast("double"), "shares_0": F.lit(None).cast("double")})


def _price(closes, securities):
    return closes.where("date <= '1999-06-30'").join(securities.select("security_id", "cik"), "security_id").groupBy("cik").agg(F.max_by("close", F.struct("date", "security_id")).alias("price"))


@query("met_05_metrics", "items", "balances", "closes", "securities", sql=f"""WITH {WIDE} SELECT cik, period_end, round(mc, 4) AS market_cap, round(ev, 4) AS enterprise_value, round(CASE WHEN net_income > 0 THEN mc / net_income END, 6) AS pe, round(CASE WHEN operating_income > 0 THEN ev / operating_income END, 6) AS ev_ebit, round(CASE WHEN equity > 0 THEN mc / equity END, 6) AS p_b, round(CASE WHEN ev > 0 THEN operating_income / ev END, 6) AS earnings_yield, round(fcf / mc, 6) AS fcf_yield,
 round(operating_income / nullif(revenue, 0), 6) AS operating_margin, round(CASE WHEN equity > 0 THEN net_income / equity END, 6) AS roe, round(CASE WHEN invested > 0 THEN operating_income * (1 - rate) / invested END, 6) AS roic, round(CASE WHEN equity > 0 THEN dbt / equity END, 6) AS debt_to_equity, round(current_assets / nullif(current_liabilities, 0), 6) AS current_ratio, round(operating_income / nullif(abs(interest_expense), 0), 5) AS interest_coverage, round((revenue - revenue_0) / nullif(abs(revenue_0), 0), 6) AS revenue_growth FROM m""")
def issuer_metrics(items, balances, closes, securities):
    out = metrics.issuer_metrics(_wide(items, balances), _price(closes, securities))
    names = ["pe", "ev_ebit", "p_b", "earnings_yield", "fcf_yield", "operating_margin", "roe", "roic", "debt_to_equity", "current_ratio", "revenue_growth"]
    return out.select("cik", "period_end", R(F.col("market_cap"), 4).alias("market_cap"), R(F.col("enterprise_value"), 4).alias("enterprise_value"), *(R(F.col(n)).alias(n) for n in names), R(F.col("interest_coverage"), 5).alias("interest_coverage"))


@query("met_06_share_count", "securities", "closes", sql="""WITH r AS (SELECT security_id, 1000.0::DOUBLE + security_id * 100 AS a, CASE WHEN security_id % 3 = 0 THEN NULL ELSE 2000.0::DOUBLE + security_id END AS b, 3000.0::DOUBLE AS c, (security_id % 7) * 500.0::DOUBLE AS income, (security_id % 5) / 10.0::DOUBLE AS eps, 1.0 + security_id % 4 AS price FROM securities), t AS (SELECT *, income > 0 AND eps >= 0.05 AS told FROM r)
 SELECT security_id, CASE WHEN a > 0 AND (NOT told OR price / eps >= 1 AND a / (income / eps) BETWEEN 1 / 1.5::DOUBLE AND 1.5) THEN a WHEN b > 0 AND (NOT told OR price / eps >= 1 AND b / (income / eps) BETWEEN 1 / 1.5::DOUBLE AND 1.5) THEN b WHEN c > 0 AND (NOT told OR price / eps >= 1 AND c / (income / eps) BETWEEN 1 / 1.5::DOUBLE AND 1.5) THEN c END AS shares FROM t""")
def share_count(s, closes):
    k = F.col("security_id")
    count = metrics.share_count(1000.0 + k * 100, F.when(k % 3 != 0, 2000.0 + k), F.lit(3000.0), (1 + k % 4).cast("double"), (k % 7) * 500.0, F.when(k % 5 != 0, (k % 5) / 10.0))
    return s.select("security_id", count.alias("shares"))


@query("met_07_margin", "items", sql="""WITH p AS (SELECT cik, period_end, max(value) FILTER (line_item = 'revenue') AS r, max(value) FILTER (line_item = 'operating_income') AS o FROM items GROUP BY 1, 2), l AS (SELECT * FROM p WHERE r IS NOT NULL AND o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) <= 5) SELECT cik, count(*) AS years, round(avg(o / r), 6) AS margin FROM l WHERE r != 0 GROUP BY 1 HAVING count(*) >= 3""")
def margin(items):
    return metrics.five_year_margin(items).withColumn("margin", R(F.col("margin")))


@query("met_08_piotroski", "items", "balances", sql=f"""WITH {ITEMS} SELECT cik, CASE WHEN net_income IS NOT NULL AND net_income_0 IS NOT NULL AND operating_cash_flow IS NOT NULL AND assets != 0 AND assets_0 != 0 THEN coalesce((net_income > 0)::INT, 0) + coalesce((operating_cash_flow > 0)::INT, 0) + coalesce((net_income / assets > net_income_0 / assets_0)::INT, 0) + coalesce((operating_cash_flow > net_income)::INT, 0) + coalesce((coalesce(debt, 0) / assets <= coalesce(debt_0, 0) / assets_0)::INT, 0)
 + coalesce((current_assets / nullif(current_liabilities, 0) > current_assets_0 / nullif(current_liabilities_0, 0))::INT, 0) + coalesce((revenue / nullif(assets, 0) > revenue_0 / nullif(assets_0, 0))::INT, 0) END AS score FROM w""")
def piotroski(items, balances):
    return _wide(items, balances).select("cik", metrics.piotroski().alias("score"))


@query("met_09_altman", "items", "balances", "closes", "securities", sql=f"""WITH {WIDE} SELECT cik, round(1.2 * (current_assets - current_liabilities) / assets + 1.4 * retained_earnings / assets + 3.3 * operating_income / assets + 0.6 * mc / liabilities + revenue / assets, 5) AS z, round(6.56 * (current_assets - current_liabilities) / assets + 3.26 * retained_earnings / assets + 6.72 * operating_income / assets + 1.05 * equity / liabilities, 5) AS z2 FROM m""")
def altman(items, balances, closes, securities):
    wide = _wide(items, balances).join(_price(closes, securities), "cik")
    return wide.select("cik", R(metrics.altman(F.col("price") * F.col("shares")), 5).alias("z"), R(metrics.altman_book(), 5).alias("z2"))


@query("met_11_wide", "items", "balances", sql=f"WITH {ITEMS} SELECT cik, period_end, revenue, revenue_0, cash, cash_0 FROM w")
def wide_items(items, balances):
    return _wide(items, balances).select("cik", "period_end", "revenue", "revenue_0", "cash", "cash_0")


@query("met_12_history", "closes", sql="SELECT security_id, as_of, round(close, 9) AS close, CAST(row_number() OVER (PARTITION BY security_id ORDER BY as_of DESC) AS INT) AS rank FROM (SELECT security_id, date AS as_of, close FROM closes) QUALIFY rank <= 4")
def history(closes):
    return metrics.history(closes.select("security_id", F.col("date").alias("as_of"), R(F.col("close"), 9).alias("close")), "security_id", 3)


@query("met_13_runway", "items", "balances", sql=f"WITH {ITEMS} SELECT cik, CASE WHEN operating_cash_flow IS NOT NULL AND capex IS NOT NULL AND cash IS NOT NULL THEN -(operating_cash_flow - abs(capex)) > 0 AND cash / CASE WHEN -(operating_cash_flow - abs(capex)) > 0 THEN -(operating_cash_flow - abs(capex)) ELSE 1 END < 1 END AS short FROM w")
def runway(items, balances):
    return _wide(items, balances).select("cik", metrics.short_runway().alias("short"))


SCREEN = """m AS (SELECT security_id, sic, avg(close) * 1e6 AS market_cap, stddev_samp(close) / avg(close) AS roic, avg(close) / 1000 - 0.5 AS earnings_yield, 0.01::DOUBLE * (security_id % 20) AS operating_margin_vs_5y FROM closes JOIN securities USING (security_id) GROUP BY 1, 2)"""


@query("scr_03_presets", "closes", "securities", sql=f"""WITH {SCREEN}, f AS (SELECT * FROM m WHERE market_cap >= 1e9 AND earnings_yield > 0 AND roic > 0 AND operating_margin_vs_5y < 0.1 AND NOT coalesce(sic BETWEEN 6000 AND 6799 OR sic BETWEEN 4900 AND 4999, false))
 SELECT security_id, row_number() OVER (ORDER BY round(earnings_yield, 9) DESC, security_id) + row_number() OVER (ORDER BY round(roic, 9) DESC, security_id) - 2 AS rank FROM f ORDER BY rank, security_id LIMIT 50""")
def presets(closes, s):
    m = closes.join(s.select("security_id", "sic"), "security_id").groupBy("security_id", "sic").agg((F.avg("close") * 1e6).alias("market_cap"), R(F.stddev_samp("close") / F.avg("close"), 9).alias("roic"), R(F.avg("close") / 1000 - 0.5, 9).alias("earnings_yield"))
    m = m.withColumn("operating_margin_vs_5y", 0.01 * (F.col("security_id") % 20))
    return metrics.screen(m, preset="magic", limit=50).select("security_id", "rank")


@query("scr_04_backtest", "closes", sql="""WITH cal AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM closes WHERE security_id = 0)), s(as_of) AS (VALUES (DATE '1996-01-15'), (DATE '1997-01-15'), (DATE '1998-01-15')), e AS (SELECT as_of, min(i) AS i FROM s JOIN cal ON date > as_of GROUP BY 1), k AS (SELECT DISTINCT security_id FROM closes),
 mk AS (SELECT as_of, h, date FROM e CROSS JOIN (VALUES (0), (63), (126)) t(h) JOIN cal c ON c.i = e.i + h), a AS (SELECT as_of, h, date, security_id FROM mk CROSS JOIN k), p AS (SELECT a.as_of, a.h, a.security_id, CASE WHEN a.h > 0 OR c.date = a.date THEN c.close END AS price FROM a ASOF LEFT JOIN (SELECT * FROM closes WHERE close > 0) c ON c.security_id = a.security_id AND c.date <= a.date),
 r AS (SELECT p.as_of, p.h, p.security_id, p.price / q.price - 1 AS ret, p.security_id % 5 = 1 AS picked FROM p JOIN p q ON q.as_of = p.as_of AND q.h = 0 AND q.security_id = p.security_id WHERE p.h > 0 AND q.price IS NOT NULL)
 SELECT as_of, CAST(h AS INT) AS h, count(ret) FILTER (picked) AS picks, round(avg(ret) FILTER (picked), 6) AS mean, round(median(ret) FILTER (picked), 6) AS median, round(avg(ret), 6) AS universe_mean, round(median(ret), 6) AS universe_median, round(max(b), 6) AS bench FROM r LEFT JOIN (SELECT as_of, h, ret AS b FROM r WHERE security_id = 0) z USING (as_of, h) WHERE security_id != 0 GROUP BY 1, 2""")
def screen_backtest(closes):
    days = closes.sparkSession.createDataFrame([("1996-01-15",), ("1997-01-15",), ("1998-01-15",)], "d string").select(F.col("d").cast("date").alias("as_of"))
    picks = closes.select("security_id").distinct().crossJoin(F.broadcast(days)).withColumn("picked", F.col("security_id") % 5 == 1)  # three snapshot days
    out = metrics.screen_backtest(picks, closes, prices.calendar(closes), [63, 126])
    return out.select("as_of", "h", "picks", *(R(F.col(c)).alias(c) for c in ("mean", "median", "universe_mean", "universe_median", "bench")))


@query("out_03_rerating", "statement_items", sql="""WITH s AS (SELECT cik AS key, period_end AS as_of, value FROM statement_items) SELECT a.key, a.as_of, round(ln(min_by(b.value, b.as_of) / a.value), 6) AS rerating FROM s a JOIN s b ON b.key = a.key AND b.as_of - a.as_of >= 360 GROUP BY a.key, a.as_of, a.value""")
def rerating(s):
    rows = s.select(F.col("cik").alias("key"), F.col("period_end").alias("as_of"), "value")
    return metrics.rerating(rows, "value").withColumn("rerating", R(F.col("rerating")))
