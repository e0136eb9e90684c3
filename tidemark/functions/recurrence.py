"""Linear recurrences over time as an associative scan: a series of any length is spread over many tasks.

A row turns the state s into A s + c. Rows are numbered and cut into blocks; a
task composes the maps of a block's rows from the block's start, which needs no
state. The maps of whole blocks are the rows of the same problem at the next
level, and its states enter the blocks. A block is seen with the last rows of
the one before it, so that windows of a few rows need no other task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import numbered, staged

#: Rows of a block.
BLOCK = 4096
#: Of a block with its lead: values (missing: nan), row numbers, extra columns; the maps (n, k, d, d), (n, k, d) of all rows and which states count (n, k).
Maps = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def blocks(series: DataFrame, lead: int, size: int = BLOCK) -> DataFrame:
    """key, date, value, place, block, inside: every row in its block, and a block's last ``lead`` rows in the next one, too."""
    rows = numbered(series.select("key", "date", "value"), ["key"], ["date"], "series").withColumns({"block": F.floor(F.col("place") / size), "inside": F.lit(True)})
    tails = rows.where((F.col("place") % size >= size - lead) & (F.col("block") < F.floor((F.col("size") - 1) / size)))
    return rows.unionByName(tails.withColumns({"block": F.col("block") + 1, "inside": F.lit(False)})).drop("size")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("segment", F.xxhash64("key", "block")).repartition("key", "block").sortWithinPartitions("key", "block", "place")


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            g = batch.column("segment").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("segment")[0].as_py() != g[begin]:
                    yield pa.concat_batches(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.concat_batches(held)


def numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def composed(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps from the first row's input to each row's state, by doubling."""
    a, c, shift = a.copy(), c.copy(), 1
    while shift < len(a):
        late_a, late_c = a[shift:], c[shift:]
        c[shift:] = (late_a @ c[:-shift, :, :, None])[..., 0] + late_c
        a[shift:] = late_a @ a[:-shift]
        shift *= 2
    return a, c


def _composing(maps: Maps, extras: list[str], kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments(batches):
            inside = part.column("inside").to_numpy(zero_copy_only=False).astype(bool)
            value = numbers(part.column("value")) if "value" in part.schema.names else np.zeros(part.num_rows)
            a, c, ready = maps(value, part.column("place").to_numpy(), {e: part.column(e) for e in extras})
            first = len(inside) - int(inside.sum())  # the lead comes first
            a, c = composed(a[first:], c[first:])
            ready, n = ready[first:], len(a)
            listed = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x[0].size).cast(pa.list_(kind))
            own = part.slice(first)
            if n:
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in kept), listed(a, pa.float64()), listed(c, pa.float64()), listed(ready, pa.bool_())], names=[*kept, "a", "c", "ready"])

    return run


def _stored(k: int, d: int) -> Maps:
    def maps(value: np.ndarray, place: np.ndarray, extra: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(place)
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
        return flat(extra["a"]).reshape(n, k, d, d), flat(extra["c"]).reshape(n, k, d), np.ones((n, k), dtype=bool)

    return maps


def applied(a: Column, c: Column, s: Column, k: int, d: int) -> Column:
    """A s + c, channel by channel; arrays hold k vectors of d numbers and k matrices of d x d."""
    rows = [(i, j) for i in range(k) for j in range(d)]
    term = lambda i, j: sum((a[(i * d + j) * d + m] * s[i * d + m] for m in range(d)), c[i * d + j])
    return F.array(*(term(i, j) for i, j in rows))


def scan(rows: DataFrame, maps: Maps, k: int, d: int, extras: list[str] | None = None, size: int = BLOCK) -> DataFrame:
    """``rows`` (of ``blocks``) inside, with ``state``, k vectors of d numbers, and ``ready``. The state before the first row is zero."""
    extras, kept = extras or [], [c for c in ("key", "date", "value", "place", "block") if c in rows.columns]
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    inner = staged(dealt(rows).mapInArrow(_composing(maps, extras, kept), f"{types}, a array<double>, c array<double>, ready array<boolean>"), "maps")
    if not inner.where("block > 0").limit(1).count():
        return inner.withColumnRenamed("c", "state").drop("a")
    ends = inner.where(F.col("place") % size == size - 1).select("key", F.col("block").alias("place"), "a", "c")
    upper = scan(ends.withColumns({"block": F.floor(F.col("place") / size), "inside": F.lit(True)}), _stored(k, d), k, d, ["a", "c"], size)
    entering = upper.select(F.col("key").alias("_k"), (F.col("place") + 1).alias("_b"), F.col("state").alias("_s"))
    joined = inner.join(entering, F.col("key").eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_b")), "left")
    state = F.when(F.col("_s").isNull(), F.col("c")).otherwise(applied(F.col("a"), F.col("c"), F.col("_s"), k, d))
    return joined.withColumn("state", state).drop("a", "c", "_k", "_b", "_s")
