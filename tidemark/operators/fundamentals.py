"""Fundamentals and company metrics (FND, MET, SCR and OUT operators)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranks import numbered, staged
from tidemark.functions.windows import running_product


def period_type(start: Column, end: Column) -> Column:
    """FND-01: instant, quarter, half, nine_months, annual or other, by inclusive days."""
    days = F.datediff(end, start) + 1
    return F.when(start.isNull(), "instant").when(days.between(80, 100), "quarter").when(days.between(170, 195), "half").when(days.between(260, 285), "nine_months").when(days.between(350, 380), "annual").otherwise("other")


def cumulative(quarters: DataFrame) -> DataFrame:
    """Year-to-date values (H1, 9M, FY) beside the quarters of calendar years."""
    year, quarter = F.year("period_end"), F.quarter("period_end")
    by = W.partitionBy("cik", "line_item", "unit", "fiscal_year").orderBy("q")
    q = quarters.withColumn("fiscal_year", year).withColumn("q", quarter)
    ytd = q.withColumns({"ytd": F.sum("value").over(by.rowsBetween(W.unboundedPreceding, 0)), "n": F.count(F.lit(1)).over(by.rowsBetween(W.unboundedPreceding, 0)), "start": F.min("period_start").over(by.rowsBetween(W.unboundedPreceding, 0))})
    return ytd.where("n = q").select("cik", "line_item", "unit", "fiscal_year", "q", F.col("start").alias("period_start"), "period_end", F.col("ytd").alias("value"), "filed")


def standalone_quarters(facts: DataFrame) -> DataFrame:
    """FND-10, FND-16: quarters from year-to-date values: each less the one before, from the year's start.

    facts: cik, line_item, unit, fiscal_year, q (quarters covered), value, filed. first_filed is the latest of the parts.
    """
    wide = facts.groupBy("cik", "line_item", "unit", "fiscal_year").pivot("q", [1, 2, 3, 4]).agg(F.first("value").alias("v"), F.max("filed").alias("f"))
    parts = F.array(*(F.struct(F.lit(k).alias("quarter"), (F.col(f"{k}_v") - (F.col(f"{k - 1}_v") if k > 1 else F.lit(0.0))).alias("value"), (F.greatest(f"{k}_f", f"{k - 1}_f") if k > 1 else F.col("1_f")).alias("first_filed"), F.lit(k > 1).alias("derived")) for k in (1, 2, 3, 4)))
    return wide.select("cik", "line_item", "unit", "fiscal_year", F.inline(parts)).where("value IS NOT NULL")


def latest_per_period(facts: DataFrame) -> DataFrame:
    """FND-08, FND-14: the value filed last of each period, and the day it was first filed."""
    return facts.groupBy("cik", "line_item", "unit", "period_start", "period_end").agg(F.max_by("value", F.struct("filed", "value")).alias("value"), F.min("filed").alias("first_filed"))


def trailing_year(quarters: DataFrame) -> DataFrame:
    """MET-01: at each quarter the sum of the last four, if they follow each other (1 to 7 days apart) and span 350 to 380 days."""
    by = W.partitionBy("cik", "line_item", "unit").orderBy("period_end")
    gap = F.datediff("period_start", F.lag("period_end").over(by))
    q = quarters.withColumn("_g", F.when(gap.between(1, 7), 1).otherwise(0))
    four = by.rowsBetween(-3, 0)
    out = q.withColumns({"_n": F.count("value").over(four), "_c": F.sum("_g").over(by.rowsBetween(-2, 0)), "_d": F.datediff("period_end", F.min("period_start").over(four)) + 1, "ttm": F.sum("value").over(four)})
    return out.select("cik", "line_item", "unit", "period_end", F.when((F.col("_n") == 4) & (F.col("_c") == 3) & F.col("_d").between(350, 380), F.col("ttm")).alias("ttm"))


def growth(now: Column, before: Column) -> Column:
    """MET-10: (now - before) / |before|, null at zero."""
    return F.when(before != 0, (now - before) / F.abs(before))


def magic_rank(rows: DataFrame) -> DataFrame:
    """SCR-02: sum of zero-based ranks by earnings yield and ROIC, both descending; ties go by security_id, nulls come last.

    Both ranks are row numbers of range-partitioned sorts, so no task ranks everything.
    """
    out = rows.withColumn("_all", F.lit(0))
    for c in ("earnings_yield", "roic"):
        out = numbered(out, ["_all"], [F.desc_nulls_last(c), "security_id"], "ranks").withColumnRenamed("place", f"_{c}").drop("size")
    return out.withColumn("rank", F.col("_earnings_yield") + F.col("_roic")).drop("_all", "_earnings_yield", "_roic")


def forward_returns(closes: DataFrame, calendar: DataFrame, horizons: list[int]) -> DataFrame:
    """OUT-01: of each day's row the return from the next calendar day over h calendar days, and the largest fall over the longest horizon.

    Bought at the next calendar day's close, if there is one. A series that
    stops keeps its last price, so the dead stay in; null only where the
    calendar ends before the horizon. Closes that are null or not positive do
    not count, nor do those off the calendar.

    The fall looks over a sliding window. With blocks as long as the window, a
    window is the rest of one block and the beginning of the next: running
    extremes from both ends of the blocks give it, and no list of prices is kept.
    """
    days = calendar.select("date").distinct().withColumn("_i", F.row_number().over(W.orderBy("date")))  # a calendar: one row a day
    total, most = calendar.select("date").distinct().count(), max(horizons)
    rows = closes.where("close > 0").join(days, "date").withColumn("_b", F.floor(F.col("_i") / (most + 1)))
    by, block = W.partitionBy("security_id").orderBy("_i"), W.partitionBy("security_id", "_b")
    upto = block.orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    onward = block.orderBy("_i").rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumns({"_peak": F.max("close").over(upto), "_low": F.min("close").over(upto), "_high": F.max("close").over(onward), "_trough": F.min("close").over(onward)})
    rows = rows.withColumns({"_fall": F.min(F.col("close") / F.col("_peak") - 1).over(upto), "_rest": F.min(F.col("_trough") / F.col("close") - 1).over(onward)})
    last = F.last(F.struct("_b", "_low", "_fall")).over(by.rangeBetween(0, most))
    across = F.least(F.col("_rest"), last["_fall"], last["_low"] / F.col("_high") - 1)
    found = {f"ret_{h}": F.when(F.col("_i") + h <= total, F.last("close").over(by.rangeBetween(0, h)) / F.col("close") - 1) for h in horizons}
    found["max_drawdown"] = F.when(F.col("_i") + most <= total, F.when(last["_b"] == F.col("_b"), F.col("_rest")).otherwise(across))
    rows = rows.withColumns(found)
    bought = F.lead("_i").over(by) == F.col("_i") + 1
    out = rows.withColumns({c: F.when(bought, F.lead(c).over(by)) for c in found})
    return out.drop("_i", "_b", "_peak", "_low", "_high", "_trough", "_fall", "_rest")


def over_peers(outcomes: DataFrame, value: str, group: str, least: int = 2) -> DataFrame:
    """OUT-02: ``value`` less the median of its date, and less that of its group on the date where the group has ``least`` values."""
    rows = outcomes.where(F.col(value).isNotNull())
    middle = F.percentile(value, F.lit(0.5))
    whole = rows.groupBy("date").agg(middle.alias("_u"))
    groups = rows.groupBy("date", group).agg(middle.alias("_g"), F.count(F.lit(1)).alias("_n"))
    out = rows.join(whole, "date").join(groups, ["date", group])
    return out.withColumns({"over_universe": F.col(value) - F.col("_u"), f"over_{group}": F.when(F.col("_n") >= least, F.col(value) - F.col("_g"))}).drop("_u", "_g", "_n")


#: Forms of annual reports, and of reports on the stub when a year end moves (fixed values); amendments end in /A.
ANNUAL, TRANSITION = ["10-K", "20-F", "40-F", "annual"], ["10-KT"]


def fiscal_ends(facts: DataFrame) -> DataFrame:
    """FND-02: year ends of an issuer: of each annual filing the latest annual period end not after it (dei left out), with the commonest year label.

    A transition report counts with its latest period of any length: that end is
    the new year end. Instants do not count, nor filings without a year label;
    where ``filing_period`` is given, an annual filing's must be FY. facts:
    accession, cik, taxonomy, form, period_start, period_end, filed, fiscal_year.
    """
    form = F.regexp_replace("form", "/A$", "")
    full = form.isin(ANNUAL) & (period_type(F.col("period_start"), F.col("period_end")) == "annual")
    if "filing_period" in facts.columns:
        full = full & (F.col("filing_period") == "FY")
    sound = (F.col("taxonomy") != "dei") & F.col("period_start").isNotNull() & F.col("fiscal_year").isNotNull() & (F.col("filed").isNull() | (F.col("period_end") <= F.col("filed")))
    used = facts.where(sound & (full | form.isin(TRANSITION)))
    ends = used.groupBy("cik", "accession").agg(F.max(F.struct("period_end", "fiscal_year")).alias("x")).select("cik", "x.*")
    labels = ends.groupBy("cik", "period_end", "fiscal_year").agg(F.count(F.lit(1)).alias("n"))
    return labels.groupBy("cik", "period_end").agg(F.max_by("fiscal_year", F.struct("n", "fiscal_year")).alias("fiscal_year"))


def year_distance(a: Column, b: Column) -> Column:
    """Days between two dates' places in a leap year, over New Year where that is shorter."""
    place = lambda d: F.dayofyear(F.make_date(F.lit(2000), F.month(d), F.dayofmonth(d)))
    d = F.abs(place(a) - place(b))
    return F.least(d, 366 - d)


def year_end_regimes(ends: DataFrame, near: int = 10) -> DataFrame:
    """FND-03: runs of year ends at about the same day of the year; lone ends before the last run go and the rest is grouped again, until none is left.

    A round is two windows over the issuers that still change; those that are
    settled are put aside. Every round takes an end of each such issuer away, so
    it ends; its tables are written, so the plan does not grow.
    """
    by = W.partitionBy("cik").orderBy("period_end")
    begins = F.coalesce(year_distance(F.col("period_end"), F.lag("period_end").over(by)) > near, F.lit(True)).cast("int")
    lone = (F.count(F.lit(1)).over(W.partitionBy("cik", "segment")) == 1) & (F.col("segment") < F.max("segment").over(W.partitionBy("cik")))
    open_, settled = ends.select("cik", "period_end", "fiscal_year"), []
    while True:
        runs = open_.withColumn("_b", begins).withColumn("segment", F.sum("_b").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_b")
        runs = staged(runs.withColumn("_lone", lone).withColumn("_open", F.max("_lone").over(W.partitionBy("cik"))), "regimes")
        settled.append(runs.where("NOT _open").drop("_lone", "_open"))
        open_ = runs.where("_open AND NOT _lone").select("cik", "period_end", "fiscal_year")
        if not runs.where("_open").limit(1).count():
            break
    rows = reduce(DataFrame.unionByName, settled)
    last = rows.withColumn("_last", F.max("period_end").over(W.partitionBy("cik", "segment")))
    # the label's distance from the year of the nominal end at or after the end less the tolerance
    offset = F.col("fiscal_year") - F.year(nominal_end(F.col("period_end"), F.month("_last"), F.dayofmonth("_last"), near))
    labels = last.groupBy("cik", "segment", offset.alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.max("period_end").alias("last"), F.min("period_end").alias("_f"))
    return labels.groupBy("cik", "segment").agg(F.max("last").alias("last_end"), F.max_by("offset", F.struct("n", -F.unix_date("_f"))).alias("offset")).select("cik", "segment", F.month("last_end").alias("month"), F.dayofmonth("last_end").alias("day"), "offset", "last_end")


def nominal_end(date: Column, month: Column, day: Column, near: int = 10) -> Column:
    """The first nominal year end (29 February clamped) on or after the date less ``near`` days."""
    late = F.date_sub(date, near)
    on = lambda y: F.date_add(F.make_date(y, month, F.lit(1)), F.least(day, F.dayofmonth(F.last_day(F.make_date(y, month, F.lit(1))))) - 1)
    return F.when(on(F.year(late)) >= late, on(F.year(late))).otherwise(on(F.year(late) + 1))


def located(rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """FND-04: fiscal year and quarter of each (cik, date): the regime that is the first to end on or after the date less ten days, else the last.

    The year end is the regime's nominal day (29 February clamped) on or after the date less ten days.
    """
    asked = rows.select("cik", "date").distinct()
    pairs = asked.join(regimes, "cik")  # an issuer has a few regimes
    late = F.date_sub("date", 10)
    rank = F.struct((F.col("last_end") < late).cast("int"), F.when(F.col("last_end") < late, -F.datediff("last_end", F.lit("1970-01-01").cast("date"))).otherwise(F.datediff("last_end", F.lit("1970-01-01").cast("date"))))
    best = pairs.groupBy("cik", "date").agg(F.min_by(F.struct("month", "day", "offset"), rank).alias("r"))
    out = best.withColumn("year_end", nominal_end(F.col("date"), F.col("r.month"), F.col("r.day")))
    quarter = F.greatest(F.lit(1), F.least(F.lit(4), (4 - F.bround(F.datediff("year_end", "date") / 91.31)).cast("int")))
    return out.select("cik", "date", "year_end", (F.year("year_end") + F.col("r.offset")).alias("fiscal_year"), quarter.alias("quarter"))


def transitions(periods: DataFrame, regimes: DataFrame, near: int = 10) -> DataFrame:
    """FND-05: periods that begin about the day after the old regime's last end and end about the new regime's first year end."""
    by = W.partitionBy("cik").orderBy("segment")
    moves = regimes.withColumn("old_end", F.lag("last_end").over(by)).where("old_end IS NOT NULL").select("cik", "old_end", "month", "day")
    first = F.make_date(F.year("old_end") + F.when(F.make_date(F.year("old_end"), F.col("month"), F.lit(28)) > F.col("old_end"), 0).otherwise(1), F.col("month"), F.least("day", F.lit(28)))
    joined = periods.join(moves.withColumn("_first", first), "cik")
    return joined.where((F.abs(F.datediff("period_start", "old_end") - 1) <= near) & (F.abs(F.datediff("period_end", "_first")) <= near)).select("cik", "period_start", "period_end").distinct()


def fact_labels(facts: DataFrame, places: DataFrame) -> DataFrame:
    """FND-06: period type, fiscal year and period (FY, Q1..Q4, H1/H2, 9M, T) of facts; an instant in quarter 4 is FY."""
    kind = period_type(F.col("period_start"), F.col("period_end"))
    rows = facts.join(places.select("cik", F.col("date").alias("period_end"), F.col("fiscal_year").alias("fy"), F.col("quarter").alias("fq")), ["cik", "period_end"], "left")
    q = F.concat(F.lit("Q"), F.col("fq").cast("string"))
    label = F.when(F.col("fq").isNull(), None).when(kind == "annual", "FY").when(kind == "quarter", q).when(kind == "half", F.when(F.col("fq") <= 2, "H1").otherwise("H2")).when(kind == "nine_months", "9M").when(kind == "instant", F.when(F.col("fq") == 4, "FY").otherwise(q))
    return rows.withColumns({"kind": kind, "fiscal_period": label})


def report_period_end(facts: DataFrame) -> DataFrame:
    """FND-07: a filing's latest duration end on or before the filing day, dei left out."""
    return facts.where((F.col("taxonomy") != "dei") & F.col("period_start").isNotNull() & (F.col("period_end") <= F.col("filed"))).groupBy("accession").agg(F.max("period_end").alias("period_end"))


def split_restated(facts: DataFrame, splits: DataFrame, as_of: Column) -> DataFrame:
    """FND-09, MET-04: share counts times, and per-share values over, the splits after the filing and not after ``as_of``. splits: cik, ex_date, ratio.

    Facts and splits run through one window per issuer, from the latest day down.
    """
    rows = facts.withColumns({"_d": F.col("filed"), "_k": F.lit(1), "_r": F.lit(1.0)})
    marks = splits.where(F.col("ex_date") <= as_of).select("cik", F.col("ex_date").alias("_d"), F.lit(0).alias("_k"), F.col("ratio").alias("_r"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    factor = F.when(F.col("_d").isNull(), 1.0).otherwise(running_product(F.col("_r"), W.partitionBy("cik").orderBy(F.desc_nulls_last("_d"), F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)))
    value = F.when(F.col("unit") == "shares", F.col("value") * F.col("_f")).when(F.col("unit").endswith("/shares"), F.col("value") / F.col("_f")).otherwise(F.col("value"))
    return both.withColumn("_f", factor).where("_k = 1").withColumn("value", value).drop("_d", "_k", "_r", "_f")


def fact_query(facts: DataFrame, concept: str, unit: str, kind: str | None = None, form: str | None = None, as_reported: bool = False) -> DataFrame:
    """FND-11: facts of one concept and unit; the value filed last of each period unless as reported."""
    rows = facts.where((F.col("concept") == concept) & (F.col("unit") == unit))
    rows = rows if form is None else rows.where(F.col("form") == form)
    rows = rows if kind is None else rows.where(period_type(F.col("period_start"), F.col("period_end")) == kind)
    if as_reported:
        return rows.select("cik", "accession", "period_start", "period_end", "value", "filed")
    return rows.groupBy("cik", "period_start", "period_end").agg(F.max(F.struct("filed", "accession", "value")).alias("x")).select("cik", "x.accession", "period_start", "period_end", "x.value", "x.filed")


def line_items(facts: DataFrame, concepts: DataFrame, currency: Column) -> DataFrame:
    """FND-12: each line item and period from the concept of best rank (values in another currency last), filed last. concepts: concept, line_item, rank."""
    rows = facts.join(concepts, "concept")
    order = F.struct((F.col("unit") != currency).cast("int"), "rank", (-F.datediff("filed", F.lit("1970-01-01").cast("date"))).alias("late"), "accession")
    return rows.groupBy("cik", "line_item", "period_start", "period_end").agg(F.min_by(F.struct("concept", "unit", "value", "filed"), order).alias("x")).select("cik", "line_item", "period_start", "period_end", "x.*")


def reporting_currency(facts: DataFrame) -> DataFrame:
    """FND-13: the commonest currency over an issuer's distinct (period, currency) pairs."""
    pairs = facts.where(F.length("unit") == 3).select("cik", "period_start", "period_end", "unit").distinct()
    return pairs.groupBy("cik", "unit").agg(F.count(F.lit(1)).alias("n")).groupBy("cik").agg(F.max_by("unit", F.struct("n", "unit")).alias("currency"))


def of_kind(facts: DataFrame) -> DataFrame:
    """FND-15: stocks at instants; flows over years, quarters, halves and nine months; per-share values over years and quarters. stock: boolean column."""
    kind = period_type(F.col("period_start"), F.col("period_end"))
    flow = kind.isin("annual", "quarter") | (kind.isin("half", "nine_months") & ~F.col("unit").endswith("shares"))
    return facts.where(F.when(F.col("stock"), kind == "instant").otherwise((kind != "instant") & flow))


def statement(items: DataFrame, names: list[str], newest: int) -> DataFrame:
    """FND-17: one row per issuer and period with a column for each line item, the newest periods first."""
    periods = items.groupBy("cik", "period_end").pivot("line_item", names).agg(F.max("value"))
    return periods.withColumn("rank", F.row_number().over(W.partitionBy("cik").orderBy(F.desc("period_end")))).where(F.col("rank") <= newest)


def derived_sums(balances: DataFrame, parts: DataFrame) -> DataFrame:
    """FND-18: concepts that are sums of component balances of one instant. parts: line_item, concept."""
    return balances.join(parts, "line_item").groupBy("cik", "period_end", "concept").agg(F.sum("value").alias("value"))


def listings(facts: DataFrame) -> DataFrame:
    """FND-19: facts, first and last day of each concept and unit of an issuer."""
    return facts.groupBy("cik", "taxonomy", "concept", "unit").agg(F.count(F.lit(1)).alias("facts"), F.min("filed").alias("first"), F.max("filed").alias("last"))


def trailing_or_year(quarters: DataFrame, years: DataFrame) -> DataFrame:
    """MET-01: the newest trailing year of quarters, unless a fiscal year ends later or there is none. years: cik, line_item, unit, period_end, value."""
    four = trailing_year(quarters).where("ttm IS NOT NULL").groupBy("cik", "line_item", "unit").agg(F.max(F.struct("period_end", "ttm")).alias("q"))
    last = years.groupBy("cik", "line_item", "unit").agg(F.max(F.struct("period_end", "value")).alias("y"))
    out = four.join(last, ["cik", "line_item", "unit"], "full_outer")
    use = F.col("q").isNotNull() & (F.col("y").isNull() | (F.col("q.period_end") >= F.col("y.period_end")))
    return out.select("cik", "line_item", "unit", F.when(use, F.col("q.period_end")).otherwise(F.col("y.period_end")).alias("period_end"), F.when(use, F.col("q.ttm")).otherwise(F.col("y.value")).alias("ttm"))
