"""Prices: source merge, adjustment for splits and dividends, calendars and point lookups (PRC operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.windows import product, running_product


def merge_sources(bars: DataFrame) -> DataFrame:
    """PRC-03: per date the bar of the source that reaches back furthest; others fill gaps. Ties go by source name."""
    since = F.min("date").over(W.partitionBy("security_id", "source"))
    ranked = bars.withColumn("_since", since)
    first = F.row_number().over(W.partitionBy("security_id", "date").orderBy("_since", "source"))
    return ranked.withColumn("_n", first).where("_n = 1").drop("_n", "_since")


def calendar(bars: DataFrame, benchmark: int = 0) -> DataFrame:
    """PRC-06: the days on which the benchmark has a bar."""
    return bars.where(F.col("security_id") == benchmark).select("date").distinct()


def action_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Price and volume factor of each action, for bars before its ex-date; actions after the last bar are left out.

    A dividend's base is the close of the last bar before the ex-date, found by one window over bars and actions together.
    """
    last = bars.groupBy("security_id").agg(F.max("date").alias("last"))
    used = actions.join(last, "security_id").where("ex_date <= last")
    both = bars.select("security_id", F.col("date").alias("day"), F.lit(1).alias("kind"), "close", F.lit(None).cast("string").alias("action"), F.lit(None).cast("double").alias("value"))
    both = both.unionByName(used.select("security_id", F.col("ex_date").alias("day"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("close"), "action", "value"))
    before = F.last("close", ignorenulls=True).over(W.partitionBy("security_id").orderBy("day", "kind").rowsBetween(W.unboundedPreceding, -1))
    based = both.withColumn("base", before).where("kind = 0")
    split = F.col("action") == "split"
    price = F.when(split, 1 / F.col("value")).when(F.col("base") != 0, 1 - F.col("value") / F.col("base")).otherwise(1.0)
    return based.select("security_id", F.col("day").alias("ex_date"), "action", price.alias("price_factor"), F.when(split, F.col("value")).otherwise(1.0).alias("volume_factor"))


def adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """PRC-01, PRC-02: adjusted close and volume with their factors, back from the latest bar.

    Bars and actions run through one window from the latest day down, so a bar
    sees the product of all actions after it without a range join.
    """
    factors = action_factors(bars, actions).groupBy("security_id", "ex_date").agg(product(F.col("price_factor")).alias("pf"), product(F.col("volume_factor")).alias("vf"))
    rows = bars.select("security_id", "date", F.lit(0).alias("kind"), "close", "volume", F.lit(1.0).alias("pf"), F.lit(1.0).alias("vf"))
    rows = rows.unionByName(factors.select("security_id", F.col("ex_date").alias("date"), F.lit(1).alias("kind"), "pf", "vf"), allowMissingColumns=True)
    over = W.partitionBy("security_id").orderBy(F.desc("date"), "kind").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({"price_factor": running_product(F.col("pf"), over), "volume_factor": running_product(F.col("vf"), over)}).where("kind = 0")
    return out.select("security_id", "date", "close", "volume", "price_factor", "volume_factor", (F.col("close") * F.col("price_factor")).alias("adj_close"), (F.col("volume") * F.col("volume_factor")).alias("adj_volume"))


def cut_jumps(closes: DataFrame, actions: DataFrame) -> DataFrame:
    """PRC-04: history starts after the last unexplained jump.

    A jump is a close of 1 or more, four times the one before, with the median
    of five closes from it on four times that of the five before, and no split
    within 7 days.
    """
    by = W.partitionBy("security_id").orderBy("date")
    ahead, behind = by.rowsBetween(0, 4), by.rowsBetween(-5, -1)
    rows = closes.withColumns(
        {
            "_before": F.lag("close").over(by),
            "_ahead": F.percentile("close", F.lit(0.5)).over(ahead),
            "_behind": F.percentile("close", F.lit(0.5)).over(behind),
            "_n": F.count("close").over(ahead),
        }
    )
    jumps = rows.where("close >= 1 AND close >= 4 * _before AND _n = 5 AND _ahead >= 4 * _behind")
    splits = actions.where("action = 'split'").select(F.col("security_id").alias("_s"), "ex_date")
    plain = jumps.join(splits, (F.col("security_id") == F.col("_s")) & (F.abs(F.datediff("date", "ex_date")) <= 7), "left_anti")
    cut = plain.groupBy("security_id").agg(F.max("date").alias("_from"))
    return closes.join(cut, "security_id", "left").where(F.col("_from").isNull() | (F.col("date") >= F.col("_from"))).drop("_from")


def on_calendar(adjusted: DataFrame, days: DataFrame, value: str = "adj_close") -> DataFrame:
    """PRC-05: one row per security and trading day, null where there is no bar."""
    grid = adjusted.select("security_id").distinct().crossJoin(F.broadcast(days))  # days: a few thousand dates at most
    return grid.join(adjusted.select("security_id", "date", F.col(value).alias("value")), ["security_id", "date"], "left")


def latest_close(bars: DataFrame, as_of: Column, within: int = 10) -> DataFrame:
    """PRC-07: newest close at or before a day, no more than ``within`` days old."""
    near = bars.where((F.col("date") <= as_of) & (F.col("date") >= F.date_sub(as_of, within)) & F.col("close").isNotNull())
    return near.groupBy("security_id").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


def split_factor(pairs: DataFrame, actions: DataFrame) -> DataFrame:
    """PRC-09: product of the split ratios in (lo, hi]; inverted when going back. pairs: security_id, lo, hi."""
    splits = actions.where("action = 'split'").select(F.col("security_id").alias("_s"), "ex_date", F.col("value").alias("_v"))
    low, high = F.least("lo", "hi"), F.greatest("lo", "hi")
    hit = pairs.join(splits, (F.col("security_id") == F.col("_s")) & (F.col("ex_date") > low) & (F.col("ex_date") <= high), "left")
    out = hit.groupBy("security_id", "lo", "hi").agg(product(F.col("_v")).alias("_p"))
    return out.select("security_id", "lo", "hi", F.when(F.col("lo") <= F.col("hi"), F.col("_p")).otherwise(1 / F.col("_p")).alias("factor"))


def median_prices(positions: DataFrame) -> DataFrame:
    """PRC-10: per identifier and period the median of value / shares over share positions, distinct filers and totals."""
    plain = positions.where("put_call = '' AND shares > 0")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c)
    return plain.groupBy("cusip", "period").agg(F.percentile(F.col("value") / F.col("shares"), F.lit(0.5)).alias("price"), F.count_distinct("filer_cik").alias("filers"), total("shares"), total("value"))


def quarter_returns(medians: DataFrame) -> DataFrame:
    """PRC-12: return to the next period of the same identifier, shares held telling splits.

    A whole ratio of 2 or more is a split when price and shares moved by
    opposite factors (logs cancel within 0.15) and the share ratio is within 10%
    of it. Above +300% null.
    """
    by = W.partitionBy("cusip").orderBy("period")
    rows = medians.withColumns({"_p": F.lead("price").over(by), "_s": F.lead("shares").over(by), "next": F.lead("period").over(by)})
    ratio = F.col("_s") / F.col("shares")
    whole = F.round(ratio)
    split = (whole >= 2) & (F.abs(ratio / whole - 1) <= 0.1) & (F.abs(F.log(F.col("_p") / F.col("price") * ratio)) <= 0.15)
    ret = F.col("_p") * F.when(split, whole).otherwise(1.0) / F.col("price") - 1
    return rows.where("next = last_day(add_months(period, 3))").select("cusip", "period", F.when(split, whole).otherwise(1.0).alias("split"), F.when(ret <= 3, ret).alias("ret"))


def latest_rates(rates: DataFrame, as_of: Column, inverted: list[str]) -> DataFrame:
    """PRC-13: the latest rate per currency on or before a day, inverted where it is quoted per dollar."""
    last = rates.where((F.col("date") <= as_of) & F.col("value").isNotNull()).groupBy("currency").agg(F.max_by("value", "date").alias("rate"))
    return last.withColumn("rate", F.when(F.col("currency").isin(inverted), 1 / F.col("rate")).otherwise(F.col("rate")))


def with_fallback(market: DataFrame, held: DataFrame) -> DataFrame:
    """PRC-08: the market's latest price of a symbol, else the broker's. Both: symbol, price."""
    both = market.select("symbol", F.col("price").alias("_m")).join(held.select("symbol", F.col("price").alias("_h")), "symbol", "full_outer")
    return both.select("symbol", F.coalesce("_m", "_h").alias("price"), F.when(F.col("_m").isNotNull(), "market").otherwise("broker").alias("source"))


def best_part(parts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """PRC-11: of the parts of a quarter the first in order."""
    return parts.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
