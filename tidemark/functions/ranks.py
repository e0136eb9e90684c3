"""Row numbers and counts that no single task has to make alone: a group of any size is spread over many tasks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.views import shared_folder

#: Rows of a dominance block: no window of ``expanding_counts`` is longer.
BLOCK = 4096


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: it outlives executors and is computed once."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "numbered") -> DataFrame:
    """``df`` with ``place``, a row's number from 0 within its group by ``order``, and ``size``, the group's rows.

    One range-partitioned sort over all groups is written; the counts of each
    partition and group are summed to offsets, one row for each of those.
    """
    rows = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    table = staged(rows.withColumn("_id", F.monotonically_increasing_id()), name)  # the partition above 33 bits of the row
    part = F.shiftright("_id", 33)
    counts = table.groupBy(*groups, part.alias("_part")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of = W.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("_part"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("size"))
    same = part == F.col("_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return table.join(offsets, same).withColumn("place", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift", *(f"_{g}" for g in groups))


def running_sums(df: DataFrame, groups: Sequence[str], order: str, values: Sequence[str], name: str = "running") -> DataFrame:
    """``df`` with ``before_`` and ``all_`` of each value: its sum over the rows before in the group, and over the whole group. A group's rows differ in ``order``.

    One range-partitioned sort is written; each partition is summed where it lies, from the
    sums of those before, one row for each partition and group.
    """
    rows = df.repartitionByRange(*groups, order).sortWithinPartitions(*groups, order)
    table = staged(rows.withColumn("_part", F.spark_partition_id()), name)
    parts = table.groupBy(*groups, "_part").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    of = W.partitionBy(*groups)
    earlier = of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(*groups, "_part", *(F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values), *(F.sum(f"_t_{v}").over(of).alias(f"all_{v}") for v in values))
    inside = W.partitionBy("_part", *groups).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    summed = table.withColumns({f"_i_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    out = summed.join(F.broadcast(offsets), [*groups, "_part"])  # one row for each partition and group
    return out.withColumns({f"before_{v}": F.col(f"_i_{v}") + F.col(f"_o_{v}") for v in values}).drop("_part", *(f"_{k}_{v}" for k in "io" for v in values))


def bits(n: Column) -> Column:
    """Binary digits of n - 1, at least one."""
    return F.length(F.bin(F.greatest(n - 1, F.lit(0))))


def _smaller_before(rows: DataFrame, within: Sequence[str], at: str, digits: Column) -> DataFrame:
    """key, place, n: rows of the same ``within`` with a smaller ``at`` and a smaller rank, a part for each binary digit.

    Two rows differ first in one digit of ``at``: there the earlier one has 0
    and the later 1, and above it they agree. So a running count over the rank
    in every block of that digit counts each pair once.
    """
    level = rows.withColumn("_l", F.explode(F.sequence(F.lit(0), digits - 1)))
    one = F.expr(f"shiftright({at}, _l) & 1")
    block = F.expr(f"shiftright({at}, _l + 1)")
    upto = W.partitionBy(*within, "_l", "_block").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    counted = level.withColumns({"_one": one, "_block": block}).withColumn("_z", F.coalesce(F.sum(1 - F.col("_one")).over(upto), F.lit(0)))
    return counted.select("key", "place", F.when(F.col("_one") == 1, F.col("_z")).otherwise(0).alias("n"))


def expanding_counts(rows: DataFrame, key: str, order: str, value: str, *, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Of every row with a value: ``seen``, the values of its key so far with its own, and ``below``, those at or below it (``strict``: below it).

    Dominance counting: values are numbered by time and by size. Within blocks
    of time, and within blocks of rank over the blocks of time, binary digits
    count the pairs; whole blocks of both come from a table of counts. n log n
    rows, and no window is longer than ``block``. Rows without a value are not
    returned; equal times are ordered by value.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(value).alias("v"))
    timed = numbered(known, ["key"], ["at", "v"], "times").withColumnRenamed("place", "time").drop("size")
    ties = F.desc("time") if strict else F.asc("time")
    both = numbered(timed, ["key"], ["v", ties], "sizes").withColumnsRenamed({"place": "rank", "time": "place"})
    both = both.withColumns({"chunk": F.floor(F.col("place") / block), "offset": F.col("place") % block, "bucket": F.floor(F.col("rank") / block)})
    parts = _smaller_before(both, ["key", "chunk"], "offset", bits(F.least("size", F.lit(block))))
    if (both.agg(F.max("size")).first()[0] or 0) > block:
        long = both.where(F.col("size") > block)
        parts = parts.unionByName(_smaller_before(long, ["key", "bucket"], "chunk", bits(F.ceil(F.col("size") / block))))
        numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))
        grid = long.select("key", "size").distinct().withColumn("chunk", F.explode(numbers)).withColumn("bucket", F.explode(numbers)).drop("size")
        cells = grid.join(long.groupBy("key", "chunk", "bucket").agg(F.count(F.lit(1)).alias("c")), ["key", "chunk", "bucket"], "left")
        earlier = cells.withColumn("c", F.coalesce(F.sum("c").over(W.partitionBy("key", "bucket").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        lower = earlier.withColumn("n", F.coalesce(F.sum("c").over(W.partitionBy("key", "chunk").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        parts = parts.unionByName(long.join(lower, ["key", "chunk", "bucket"]).select("key", "place", "n"))
    sums = parts.groupBy("key", "place").agg(F.sum("n").alias("n"))
    out = both.join(sums, ["key", "place"])
    return out.select(F.col("key").alias(key), F.col("at").alias(order), F.col("v").alias(value), (F.col("place") + 1).alias("seen"), (F.col("n") + F.lit(0 if strict else 1)).alias("below"))
