"""Company metrics (MET operators) and screens (SCR): one wide row of items per issuer, then expressions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import breadth, fundamentals
from tidemark.operators.fundamentals import growth

CURRENT, STALE = 400, 550
FLOWS = ["revenue", "operating_income", "net_income", "operating_cash_flow", "capex", "interest_expense", "tax", "pretax", "depreciation", "dividends", "buybacks", "gross_profit", "cost_of_revenue"]
BALANCES = ["assets", "liabilities", "equity", "current_assets", "current_liabilities", "retained_earnings", "cash", "short_term_investments", "debt", "short_term_debt", "leases", "shares"]


def latest_balance(items: DataFrame, as_of: Column, keys: list[str], within: int = 400) -> DataFrame:
    """MET-02: per key the value of the newest period that had ended and was filed by a day, unless it ended more than ``within`` days before; of several filings the last."""
    known = items.where((F.col("filed") <= as_of) & (F.col("period_end") <= as_of) & F.col("value").isNotNull())
    newest = known.groupBy(*keys).agg(F.max("period_end").alias("period_end"), F.max_by("value", F.struct("period_end", "filed")).alias("value"))
    return newest.where(F.datediff(as_of, "period_end") <= within)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def positive(a: Column, b: Column, what: Column | None = None) -> Column:
    return F.when((b if what is None else what) > 0, ratio(a, b))


def in_dollars(items: DataFrame, rates: DataFrame) -> DataFrame:
    """MET-03: values in the issuer's reporting currency (that of its newest revenue, income or assets) in dollars; other currencies go. rates: unit, rate."""
    own = items.where(F.col("line_item").isin("revenue", "net_income", "assets")).groupBy("cik").agg(F.max_by("unit", F.struct("period_end", "unit")).alias("currency"))
    rows = items.join(own, "cik").where(F.col("unit") == F.col("currency")).join(rates, "unit")
    return rows.withColumn("value", F.col("value") * F.col("rate")).drop("rate")


def wide_items(flows: DataFrame, balances: DataFrame, as_of: Column) -> DataFrame:
    """MET-11: per issuer the items known on a day (first_filed), now and a year before (suffix _0): flows of the year, balances at its end.

    A value counts within 400 days of the period described; issuers whose period
    is older than 550 days are left out.
    """
    known = [d.where(F.col("first_filed") <= as_of).select("cik", "line_item", "period_end", "value") for d in (flows, balances)]
    rows = known[0].unionByName(known[1])
    ends = rows.where(F.col("line_item").isin("revenue", "net_income", "assets")).groupBy("cik").agg(F.max("period_end").alias("end")).where(F.datediff(as_of, "end") <= STALE)
    near = rows.join(ends, "cik")
    now = (F.col("period_end") <= F.col("end")) & (F.datediff("end", "period_end") <= CURRENT)
    ago = F.date_sub("end", 365)
    then = (F.col("period_end") <= ago) & (F.datediff(ago, "period_end") <= CURRENT)
    pick = lambda name, when, alias: F.max_by(F.when(when & (F.col("line_item") == name), F.col("value")), F.when(when & (F.col("line_item") == name), F.col("period_end"))).alias(alias)
    return near.groupBy("cik", F.col("end").alias("period_end")).agg(*(pick(n, now, n) for n in FLOWS + BALANCES), *(pick(n, then, f"{n}_0") for n in FLOWS + BALANCES))


def share_count(count: Column, diluted: Column, implied: Column, price: Column, income: Column, eps: Column) -> Column:
    """MET-06: the first of three counts that agrees with income and earnings per share; with no such earnings the first there is."""
    told = (income > 0) & (eps >= 0.05)
    fits = lambda c: ~F.coalesce(told, F.lit(False)) | ((ratio(price, eps) >= 1) & ratio(c, ratio(income, eps)).between(1 / 1.5, 1.5))
    return F.coalesce(*(F.when((c > 0) & fits(c), c) for c in (count, diluted, implied)))


def issuer_metrics(wide: DataFrame, prices: DataFrame) -> DataFrame:
    """MET-05: the metrics of each issuer from its items and price. prices: cik, price; shares in the items."""
    c = F.col
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    rows = wide.join(prices, "cik")
    fcf = c("operating_cash_flow") - zero("capex")
    cash, debt = zero("cash") + zero("short_term_investments"), zero("debt") + zero("short_term_debt")
    rows = rows.withColumns({"fcf": fcf, "_cash": cash, "_debt": debt + zero("leases"), "gross": F.coalesce(c("gross_profit"), c("revenue") - c("cost_of_revenue")), "equity": F.coalesce(c("equity"), c("assets") - c("liabilities")), "liabilities": F.coalesce(c("liabilities"), c("assets") - c("equity")), "market_cap": F.when(c("shares") > 0, c("price") * c("shares"))})
    rate = F.least(F.greatest(F.coalesce(F.nullif(ratio(c("tax"), c("pretax")), F.lit(0.0)), F.lit(0.21)), F.lit(0.0)), F.lit(0.5))
    rows = rows.withColumns({"ev": c("market_cap") + c("_debt") - c("_cash"), "ebit": c("operating_income"), "ebitda": c("operating_income") + zero("depreciation"), "invested": c("equity") + c("_debt") - c("_cash"), "_rate": rate})
    cap = c("market_cap")
    return rows.select(
        "cik", "period_end", "market_cap", c("ev").alias("enterprise_value"), c("revenue").alias("revenue_ttm"), c("net_income").alias("net_income_ttm"), c("ebit").alias("ebit_ttm"), c("fcf").alias("fcf_ttm"),
        positive(cap, c("net_income")).alias("pe"), positive(c("ev"), c("ebit")).alias("ev_ebit"), positive(c("ev"), c("ebitda")).alias("ev_ebitda"), ratio(c("ev"), c("revenue")).alias("ev_sales"), positive(cap, c("fcf")).alias("p_fcf"), positive(cap, c("equity")).alias("p_b"),
        positive(c("ebit"), c("ev")).alias("earnings_yield"), ratio(c("fcf"), cap).alias("fcf_yield"), F.when(zero("dividends") == 0, 0.0).otherwise(ratio(F.abs("dividends"), cap)).alias("dividend_yield"), ratio(F.abs(zero("dividends")) + F.abs(zero("buybacks")), cap).alias("shareholder_yield"),
        ratio(c("gross"), c("revenue")).alias("gross_margin"), ratio(c("ebit"), c("revenue")).alias("operating_margin"), ratio(c("net_income"), c("revenue")).alias("net_margin"), positive(c("net_income"), c("equity")).alias("roe"), positive(c("ebit") * (1 - c("_rate")), c("invested")).alias("roic"),
        positive(c("_debt"), c("equity")).alias("debt_to_equity"), positive(c("_debt") - c("_cash"), c("ebitda")).alias("net_debt_to_ebitda"), ratio(c("current_assets"), c("current_liabilities")).alias("current_ratio"), ratio(c("ebit"), F.abs("interest_expense")).alias("interest_coverage"),
        growth(c("revenue"), c("revenue_0")).alias("revenue_growth"), growth(c("net_income"), c("net_income_0")).alias("earnings_growth"), growth(c("ebit"), c("operating_income_0")).alias("ebit_growth"), piotroski().alias("piotroski_f"), altman(cap).alias("altman_z"),
    )


def five_year_margin(years: DataFrame) -> DataFrame:
    """MET-07: mean operating margin over the last five common fiscal years, of three at least. years: cik, line_item, period_end, value."""
    both = years.where(F.col("line_item").isin("revenue", "operating_income")).groupBy("cik", "period_end").pivot("line_item", ["revenue", "operating_income"]).agg(F.max("value")).where("revenue IS NOT NULL AND operating_income IS NOT NULL")
    last = both.withColumn("_n", F.row_number().over(W.partitionBy("cik").orderBy(F.desc("period_end")))).where("_n <= 5 AND revenue <> 0")
    return last.groupBy("cik").agg(F.count(F.lit(1)).alias("years"), F.avg(F.col("operating_income") / F.col("revenue")).alias("margin")).where("years >= 3")


def piotroski() -> Column:
    """MET-08: nine signs against a year earlier; null without income, cash flow or assets; missing debt counts as none."""
    c = F.col
    needed = ["net_income", "net_income_0", "operating_cash_flow"]
    debt = lambda s: F.coalesce(c(f"debt{s}"), F.lit(0.0)) / c(f"assets{s}")
    gross = lambda s: ratio(F.coalesce(c(f"gross_profit{s}"), c(f"revenue{s}") - c(f"cost_of_revenue{s}")), c(f"revenue{s}"))
    signs = [c("net_income") > 0, c("operating_cash_flow") > 0, c("net_income") / c("assets") > c("net_income_0") / c("assets_0"), c("operating_cash_flow") > c("net_income"), debt("") <= debt("_0"), ratio(c("current_assets"), c("current_liabilities")) > ratio(c("current_assets_0"), c("current_liabilities_0")), c("shares") <= c("shares_0"), gross("") > gross("_0"), ratio(c("revenue"), c("assets")) > ratio(c("revenue_0"), c("assets_0"))]
    total = F.lit(0)
    for s in signs:
        total = total + F.coalesce(s.cast("int"), F.lit(0))
    known = (c("assets") != 0) & (c("assets_0") != 0)
    for n in needed:
        known = known & c(n).isNotNull()
    return F.when(known, total)


def altman(cap: Column) -> Column:
    """MET-09: Altman's Z with the market value of equity."""
    c, a = F.col, F.col("assets")
    return F.when((a != 0) & (c("liabilities") != 0), 1.2 * (c("current_assets") - c("current_liabilities")) / a + 1.4 * c("retained_earnings") / a + 3.3 * c("operating_income") / a + 0.6 * cap / c("liabilities") + c("revenue") / a)


def altman_book() -> Column:
    """MET-09: Z'' without a price."""
    c, a = F.col, F.col("assets")
    equity = F.coalesce(c("equity"), a - c("liabilities"))
    return F.when((a != 0) & (c("liabilities") != 0), 6.56 * (c("current_assets") - c("current_liabilities")) / a + 3.26 * c("retained_earnings") / a + 6.72 * c("operating_income") / a + 1.05 * equity / c("liabilities"))


def short_runway() -> Column:
    """MET-13: whether cash covers less than a year of burn; null without inputs."""
    burn = -(F.col("operating_cash_flow") - F.abs("capex"))
    return F.when(burn.isNotNull() & F.col("cash").isNotNull(), (burn > 0) & (F.col("cash") / F.when(burn > 0, burn).otherwise(1.0) < 1))


def history(metrics: DataFrame, key: str, n: int) -> DataFrame:
    """MET-12: the newest row of each key and ``n`` before it."""
    return metrics.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("as_of")))).where(F.col("rank") <= n + 1)


PEAK = "operating_margin_vs_5y<0.1"
#: SCR-03 (fixed values): filters, order and sectors left out of each preset.
PRESETS = {
    "magic": (["market_cap>=1e9", "earnings_yield>0", "roic>0", PEAK], "magic", ["finance", "utilities"]),
    "deep_value": (["p_b<1", "piotroski_f>=7", "current_ratio>=1.5", "market_cap>=3e8", PEAK], "p_b", []),
    "quality": (["roic>=0.15", "operating_margin>=0.15", "debt_to_equity<=1", "revenue_growth>=0.05", "market_cap>=1e9", PEAK], "-roic", []),
    "cash_cows": (["fcf_yield>=0.08", "shareholder_yield>=0.04", "interest_coverage>=5", "market_cap>=1e9", PEAK], "-fcf_yield", ["finance"]),
}


def condition(text: str) -> Column:
    """A ``metric op number`` filter; a null metric fails."""
    m = re.fullmatch(r"\s*(\w+)\s*(<=|>=|<|>|=)\s*([-+\d.eE]+)\s*", text)
    if not m:
        raise ValueError(f"{text!r}: expected metric<op>number")
    a, b = F.col(m[1]), F.lit(float(m[3]))
    return F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[m[2]], F.lit(False))


def screen(metrics: DataFrame, filters: list[str] = (), sort: str | None = None, preset: str | None = None, exclude: list[str] = (), sector: list[str] = (), limit: int | None = None) -> DataFrame:
    """SCR-01, SCR-03: rows that pass all filters, in order (nulls last), with their rank. An asked sector cancels a preset's exclusion; no sector code stays in.

    metrics: security_id, sic and the metrics' columns.
    """
    filters, exclude = list(filters), list(exclude)
    if preset:
        conditions, order, out = PRESETS[preset]
        filters, sort, exclude = conditions + filters, sort or order, exclude + [s for s in out if s not in sector]
    rows = metrics
    for text in filters:
        rows = rows.where(condition(text))
    name = breadth.sector(F.col("sic"))
    if sector:
        rows = rows.where(F.coalesce(name.isin(list(sector)), F.lit(False)))
    if exclude:
        rows = rows.where(~F.coalesce(name.isin(exclude), F.lit(False)))
    if sort == "magic":
        rows = fundamentals.magic_rank(rows.where("earnings_yield IS NOT NULL AND roic IS NOT NULL"))
        order = [F.col("rank"), F.col("security_id")]
    elif sort:
        column = sort.lstrip("-")
        order = [F.desc_nulls_last(column) if sort.startswith("-") else F.asc_nulls_last(column), F.col("security_id")]
    else:
        order = [F.col("security_id")]
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def screen_backtest(picks: DataFrame, closes: DataFrame, calendar: DataFrame, horizons: list[int]) -> DataFrame:
    """SCR-04: per snapshot and horizon the mean and median return of picks and of the whole universe, and the benchmark's.

    Bought on the first calendar day after the snapshot, if the security has a
    close on that very day, and held h days of the calendar; a series that stops
    then keeps its last price. picks: as_of, security_id, picked.
    """
    days = calendar.select("date", F.row_number().over(W.orderBy("date")).alias("i"))  # a calendar: one row a day
    snapshots = picks.select("as_of").distinct()
    entries = snapshots.crossJoin(days).where("date > as_of").groupBy("as_of").agg(F.min("i").alias("i"))  # dates by dates, both short
    marks = entries.select("as_of", F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("i").alias("i")), *(F.struct(F.lit(h).alias("h"), (F.col("i") + h).alias("i")) for h in horizons))).alias("m")).select("as_of", "m.h", "m.i").join(days, "i")
    asked = picks.select("as_of", "security_id", "picked").join(marks, "as_of")
    told = closes.where("close > 0").select("security_id", "date", "close")
    both = asked.select("security_id", "date", "as_of", "h", "picked", F.lit(None).cast("double").alias("close"), F.lit(1).alias("k")).unionByName(told.withColumn("k", F.lit(0)), allowMissingColumns=True)
    last = F.last(F.when(F.col("k") == 0, F.struct("date", "close")), ignorenulls=True).over(W.partitionBy("security_id").orderBy("date", "k").rowsBetween(W.unboundedPreceding, 0))
    priced = both.withColumn("_last", last).where("k = 1").withColumn("price", F.col("_last.close"))
    start = priced.where("h = 0").select("as_of", "security_id", F.when(F.col("_last.date") == F.col("date"), F.col("price")).alias("p0"))
    held = priced.where("h > 0").join(start, ["as_of", "security_id"]).where("p0 IS NOT NULL").withColumn("ret", F.col("price") / F.col("p0") - 1)
    bench = held.where("security_id = 0").select("as_of", "h", F.col("ret").alias("bench"))
    pick = F.when(F.col("picked"), F.col("ret"))
    out = held.where("security_id <> 0").groupBy("as_of", "h").agg(F.count(pick).alias("picks"), F.avg(pick).alias("mean"), F.percentile(pick, F.lit(0.5)).alias("median"), F.avg("ret").alias("universe_mean"), F.percentile("ret", F.lit(0.5)).alias("universe_median"))
    return out.join(bench, ["as_of", "h"], "left")


def rerating(metrics: DataFrame, column: str, days: int = 360) -> DataFrame:
    """OUT-03: ln(later / now) of a ratio at the first snapshot ``days`` or more later. metrics: key, as_of."""
    rows = metrics.select("key", "as_of", F.col(column).alias("now"))
    later = rows.select("key", F.col("as_of").alias("later_on"), F.col("now").alias("later"))
    first = rows.join(later, "key").where(F.datediff("later_on", "as_of") >= days).groupBy("key", "as_of").agg(F.min(F.struct("later_on", "later")).alias("x"))
    return rows.join(first, ["key", "as_of"]).select("key", "as_of", F.when((F.col("now") > 0) & (F.col("x.later") > 0), F.log(F.col("x.later") / F.col("now"))).alias("rerating"))
