"""Monthly premium studies (BKT-12): months from daily inputs, sorts by expanding rank, and an on/off rule against always holding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranks import expanding_counts
from tidemark.functions.windows import product, running_product
from tidemark.operators import statistics

MONTHS = 12


def premium_months(days: DataFrame, vol_days: int = 21) -> DataFrame:
    """key, end, vrp, slope, ret, bench, rf: a row for each month end with every input, and what the month after it brought.

    days: key, date, price (the instrument), index, implied and implied3 (volatility
    in points), bill (percent a year), on one calendar per key. vrp is the implied
    less the realised volatility of the index, unknown without ``vol_days`` + 1
    positive prices in a row; slope is implied3 - implied.
    """
    by = W.partitionBy("key").orderBy("date")
    before = F.lag("index").over(by)
    rows = days.withColumn("_l", F.when((F.col("index") > 0) & (before > 0), F.log(F.col("index") / before)))
    frame = by.rowsBetween(1 - vol_days, 0)
    realised = F.when(F.count("_l").over(frame) == vol_days, F.stddev_samp("_l").over(frame) * F.sqrt(F.lit(252.0)) * 100)
    ends = rows.withColumns({"_v": realised, "_next": F.trunc(F.lead("date").over(by), "month")}).where("_next IS NULL OR _next <> trunc(date, 'month')")
    after = lambda c: F.lead(c).over(by)
    months = ends.select("key", F.col("date").alias("end"), (F.col("implied") - F.col("_v")).alias("vrp"), (F.col("implied3") - F.col("implied")).alias("slope"), (after("price") / F.col("price") - 1).alias("ret"), (after("index") / F.col("index") - 1).alias("bench"), (F.col("bill") / 100 / MONTHS).alias("rf"), "implied")
    return months.where("implied IS NOT NULL AND ret IS NOT NULL AND bench IS NOT NULL AND rf IS NOT NULL").drop("implied")


def with_history(months: DataFrame, signal: str, least: int = 60) -> DataFrame:
    """``months`` with ``rank``, the share of the signal's earlier values below the month's, and ``above``, whether it is over their median; unknown before ``least`` of them."""
    counts = expanding_counts(months, "key", "end", signal, strict=True)
    past = F.col("seen") - 1
    ranks = counts.select(F.col("key").alias("_k"), F.col("end").alias("_e"), F.when(past >= least, F.col("below") / past).alias("rank"))
    earlier = W.partitionBy("key").orderBy("end").rowsBetween(W.unboundedPreceding, -1)  # one row a month
    middle = F.when(F.count(signal).over(earlier) >= least, F.percentile(signal, F.lit(0.5)).over(earlier))
    rows = months.withColumn("above", F.col(signal) > middle)
    return rows.join(ranks, F.col("key").eqNullSafe(F.col("_k")) & (F.col("end") == F.col("_e")), "left").drop("_k", "_e")


def sorts(ranked: DataFrame, outcome: Column) -> DataFrame:
    """key, bucket, mean, low, high, months: the outcome's mean by tercile of the rank, with errors of one lag."""
    bucket = F.when(F.col("rank") < 1 / 3, "bottom").when(F.col("rank") < 2 / 3, "middle").otherwise("top")
    rows = ranked.where("rank IS NOT NULL").select(F.struct("key", bucket.alias("bucket")).alias("key"), F.col("end").alias("date"), outcome.alias("value"))
    return statistics.newey_west(rows, 1).select("key.key", "key.bucket", "mean", "low", "high", F.col("n").alias("months"))


def regression(months: DataFrame, signal: str, outcome: Column, alpha: float = 0.025) -> DataFrame:
    """key, slope, error, t, p, n, verdict: the outcome on the signal, one-sided."""
    fit = statistics.hac_slope(months.select("key", F.col("end").alias("date"), F.col(signal).alias("x"), outcome.alias("y")), 1)
    t = F.when(F.col("error") > 0, F.col("slope") / F.col("error"))
    out = fit.withColumns({"t": t, "p": statistics.normal_tail(t)})
    verdict = F.when((F.col("p") < alpha) & (F.col("slope") > 0), "support").when(F.col("p").isNull() | (F.col("p") >= 0.1) | (F.col("slope") <= 0), "no").otherwise("weak")
    return out.select("key", "slope", "error", "t", "p", "n", verdict.alias("verdict"))


def sharpe(excess: str) -> Column:
    """An aggregate: yearly ratio of an excess return's mean and deviation; unknown under three months or without spread."""
    spread = F.stddev_samp(excess)
    return F.when((F.count(excess) > 2) & (spread > 0), F.avg(excess) / spread * F.sqrt(F.lit(float(MONTHS))))


def rule_months(ranked: DataFrame) -> DataFrame:
    """Months whose ``above`` is known, with ``rule``: the instrument while above, bills otherwise; and both excess returns."""
    rows = ranked.where("above IS NOT NULL").withColumn("rule", F.when(F.col("above"), F.col("ret")).otherwise(F.col("rf")))
    return rows.withColumns({"rule_excess": F.col("rule") - F.col("rf"), "always_excess": F.col("ret") - F.col("rf")})


def described(rows: DataFrame, returns: list[str]) -> DataFrame:
    """key, leg, cagr, vol, sharpe, max_drawdown, months of each return column, beside the bill rate."""
    legs = F.explode(F.array(*(F.struct(F.lit(c).alias("leg"), F.col(c).alias("r")) for c in returns))).alias("x")
    long = rows.select("key", "end", "rf", legs).select("key", "end", "rf", "x.leg", "x.r").withColumn("e", F.col("r") - F.col("rf"))
    order = W.partitionBy("key", "leg").orderBy("end").rowsBetween(W.unboundedPreceding, 0)
    held = long.withColumn("_w", running_product(1 + F.col("r"), order))
    held = held.withColumn("_f", F.col("_w") / F.greatest(F.lit(1.0), F.max("_w").over(order)) - 1)
    total, n = product(1 + F.col("r")), F.count(F.lit(1))
    return held.groupBy("key", "leg").agg(
        F.when(total > 0, F.pow(total, MONTHS / n) - 1).alias("cagr"), (F.when(n > 2, F.stddev_samp("r")) * F.sqrt(F.lit(float(MONTHS)))).alias("vol"),
        sharpe("e").alias("sharpe"), F.least(F.min("_f"), F.lit(0.0)).alias("max_drawdown"), n.alias("months"),
    )


def rule_test(ranked: DataFrame, least: int = 24, block: int = 24, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """key, months, share_on, difference, low, high, verdict: the rule's Sharpe ratio less that of always holding, with a block-bootstrap interval.

    Keys with fewer than ``least`` months are left out; under two blocks there is no interval.
    """
    rows = rule_months(ranked)
    rows = rows.withColumns({"i": (F.row_number().over(W.partitionBy("key").orderBy("end")) - 1).cast("long"), "_n": F.count(F.lit(1)).over(W.partitionBy("key"))}).where(F.col("_n") >= least)
    gap = lambda: sharpe("rule_excess") - sharpe("always_excess")
    point = rows.groupBy("key").agg(F.count(F.lit(1)).alias("months"), F.avg(F.col("above").cast("double")).alias("share_on"), gap().alias("difference"))
    spread = statistics.block_bootstrap(rows.where(F.col("_n") >= 2 * block).select("key", "i", "rule_excess", "always_excess"), gap, ["key"], replicates, block, seed)
    out = point.join(spread, "key", "left")
    verdict = F.when(F.col("low") > 0, "support").when(F.col("difference") <= 0, "no").otherwise("weak")
    return out.select("key", "months", "share_on", "difference", "low", "high", verdict.alias("verdict"))
