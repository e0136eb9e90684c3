"""Market breadth per universe and day (BRD operators): one pass over the bars for all universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.prices import adjust

#: Sectors by inclusive SIC ranges, and exchanges of listed stocks.
SECTORS = [
    ("agriculture", 100, 999), ("mining", 1000, 1499), ("construction", 1500, 1799), ("manufacturing", 2000, 3999), ("transportation", 4000, 4899),
    ("utilities", 4900, 4999), ("wholesale", 5000, 5199), ("retail", 5200, 5999), ("finance", 6000, 6799), ("services", 7000, 8999), ("public", 9100, 9999),
]
EXCHANGES = ["XNYS", "XNAS", "XASE"]


def sector(sic: Column) -> Column:
    """IDN-17: sector of a SIC code; null outside of all ranges."""
    out = F.lit(None).cast("string")
    for name, low, high in SECTORS:
        out = F.when(sic.between(low, high), F.lit(name)).otherwise(out)
    return out


def memberships(securities: DataFrame) -> DataFrame:
    """BRD-06: (security_id, universe) of common stocks on the exchanges: all of them, and their sector."""
    stocks = securities.where((F.col("security_type") == "CS") & F.col("mic").isin(EXCHANGES))
    universes = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("sector:"), sector(F.col("sic")))))
    return stocks.select("security_id", F.explode(universes).alias("universe"))


def stock_days(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Per stock and day the counters' inputs; closes that are null or zero are skipped, splits apply backwards."""
    valid = adjust(bars.where("close > 0"), actions.where("action = 'split'"))
    price = F.round("adj_close", 6)
    by = W.partitionBy("security_id").orderBy("date")
    out = valid.withColumn("p", price).withColumn("before", F.lag("p").over(by))

    def window(n: int):
        return by.rowsBetween(1 - n, 0)

    full = lambda n: F.count("p").over(window(n)) == n
    out = out.withColumns({f"ma{n}": F.when(full(n), F.round(F.avg("p").over(window(n)), 6)) for n in (50, 200)})
    return out.withColumns({"high252": F.when(full(252), F.max("p").over(window(252))), "low252": F.when(full(252), F.min("p").over(window(252)))})


def breadth(bars: DataFrame, actions: DataFrame, securities: DataFrame) -> DataFrame:
    """BRD-01 to BRD-05: counters, moving-average and high/low counts, the cumulative line and the ratios."""
    days = stock_days(bars, actions).join(memberships(securities), "security_id")
    up, down = F.col("p") > F.col("before"), F.col("p") < F.col("before")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    volume = lambda c: F.sum(F.when(c, F.col("volume")).otherwise(0)).cast("long")
    out = days.groupBy("universe", "date").agg(
        count(F.col("before").isNotNull()).alias("stocks"), count(up).alias("advancers"), count(down).alias("decliners"), count(F.col("p") == F.col("before")).alias("unchanged"),
        volume(up).alias("up_volume"), volume(down).alias("down_volume"),
        count(F.col("ma50").isNotNull()).alias("eligible_50"), count(F.col("p") > F.col("ma50")).alias("above_50"), count(F.col("ma200").isNotNull()).alias("eligible_200"), count(F.col("p") > F.col("ma200")).alias("above_200"),
        count(F.col("high252").isNotNull()).alias("eligible_252"), count(F.col("p") >= F.col("high252")).alias("new_highs"), count(F.col("p") <= F.col("low252")).alias("new_lows"),
    )
    line = F.sum(F.col("advancers") - F.col("decliners")).over(W.partitionBy("universe").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    ratio = lambda a, b, k=1.0: F.round(k * F.try_divide(F.col(a), F.col(b)), 6)
    return out.withColumns(
        {
            "ad_line": line, "pct_above_50": ratio("above_50", "eligible_50", 100.0), "pct_above_200": ratio("above_200", "eligible_200", 100.0), "ad_ratio": ratio("advancers", "decliners"),
            "up_volume_share": F.round(F.try_divide(F.col("up_volume"), F.col("up_volume") + F.col("down_volume")), 6),
            "net_advances": F.when(F.col("stocks") > 0, F.col("advancers") - F.col("decliners")), "net_new_highs": F.when(F.col("eligible_252") > 0, F.col("new_highs") - F.col("new_lows")),
        }
    )
