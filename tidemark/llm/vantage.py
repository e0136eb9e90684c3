"""Nearest neighbours by cosine: vantage-point trees per shard, with relaxed pruning.

Unit vectors have the Euclidean distance sqrt(2 - 2 cosine), a metric. Every
shard's tree splits its vectors by their distance from a vantage point at the
median and keeps the least and the greatest distance of both halves. A query at
distance d from the vantage point can have no neighbour nearer than
max(d - greatest, least - d) in a half; the half is left out where that bound
times ``factor`` exceeds the query's worst neighbour so far. Factor one is exact;
a greater one prunes more and may miss neighbours.

Rows of equal vectors meet first: only the k + 1 smallest ids of a vector can be
among anyone's k nearest, so a vector that fills a third of the table is one
entry (Spark limits each group before its shuffle), and queries of equal vectors
are searched once. Entries are dealt to shards of bounded size by a hash. The
stated query set goes to every shard in blocks, sorted behind the shard's
entries: a task keeps one shard, builds its tree once and streams the queries
through it, each node meeting a block of queries at a time. A query first goes
down to one leaf, then through the whole tree with the worst distance found
there, or in a bounded sample of the entries, which only gives the starting
bound. Every shard returns its best by exact double precision cosines of the
original vectors; Spark ranks them.

Null vectors, zero vectors and vectors with null or non-finite components take
no part, nor do rows without an id; vectors of different lengths are never
compared. Repeated rows count once; rows of the query's own id are never its
neighbours. Equal scores go by the smaller id. Empty tables have an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Entries of a shard at most (on average), and at least while there are fewer shards than cores.
MOST, LEAST = 65_536, 2_048
#: Entries that give each query its starting bound.
SAMPLE = 1_024
#: Vectors of a leaf, queries that meet a node at a time, further neighbours kept against rounding.
LEAF, BLOCK, SPARE = 64, 2_048, 4
#: Rounding of a distance near zero, and of a cosine.
SLACK, TIE = 1e-6, 1e-12


def takes_part(vec_id: Column, x: Column) -> Column:
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(vec_id.isNotNull() & x.isNotNull() & (F.size(x) > 0), finite & F.exists(x, lambda c: c != 0)).otherwise(False)


def entries(vectors: DataFrame, keep: int, vec_id: str, embedding: str) -> DataFrame:
    """a, b (the vector's key), x, ids: every distinct vector with its ``keep`` smallest ids."""
    x = F.col(embedding)
    rows = vectors.where(takes_part(F.col(vec_id), x)).select(F.col(vec_id).alias("id"), x.alias("x"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    rows = rows.groupBy("id", "a", "b").agg(F.first("x").alias("x"))
    place = F.row_number().over(W.partitionBy("a", "b").orderBy("id"))
    return rows.withColumn("n", place).where(F.col("n") <= keep).groupBy("a", "b").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("id")).alias("ids"))  # keep rows a group at most


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, with the same order of addition for every row; vectors beyond the range of squares are scaled first."""
    with np.errstate(all="ignore"):
        dots, sizes = (a * b).sum(1), np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
        odd = ~(np.isfinite(sizes) & np.isfinite(dots) & (sizes > 1e-290))
        if odd.any():
            dots[odd], sizes[odd] = (units(a[odd]) * units(b[odd])).sum(1), 1.0
    return dots / sizes


def distances(scores: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * scores))


class Best:
    """The best neighbours so far of a block of queries."""

    def __init__(self, n: int, keep: int, rank: int, bound: np.ndarray) -> None:
        self.score, self.of, self.rank, self.bound = np.full((n, keep), -np.inf), np.full((n, keep), -1, dtype=np.int64), rank, bound

    def offer(self, who: np.ndarray, score: np.ndarray, of: np.ndarray) -> None:
        """New scores, a row for each of ``who`` and a column for each of ``of``."""
        better = (score > self.score[who, -1:]).any(1)
        who, score = who[better], score[better]
        if len(who):
            both = np.concatenate([self.score[who], score], axis=1)
            names = np.concatenate([self.of[who], np.broadcast_to(of, (len(who), len(of)))], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, : self.score.shape[1]]
            self.score[who], self.of[who] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def worst(self, who: np.ndarray) -> np.ndarray:
        own = self.score[who, self.rank - 1]
        return np.minimum(np.where(np.isfinite(own), distances(np.where(np.isfinite(own), own, 0.0)), np.inf), self.bound[who])


class VantageTree:
    def __init__(self, x: np.ndarray) -> None:
        """A tree over the rows of ``x``, which are unit vectors."""
        self.x, self.nodes, self.met = x, [], 0
        self.build(np.arange(len(x)))

    def build(self, rows: np.ndarray) -> int:
        """A node is (vantage point, median, [bounds and number of each half]) or a leaf's rows."""
        me = len(self.nodes)
        if len(rows) <= LEAF:
            self.nodes.append(rows)
            return me
        self.nodes.append(None)
        point, rest = rows[len(rows) // 2], np.delete(rows, len(rows) // 2)
        d = distances(self.x[rest] @ self.x[point])
        half = len(rest) // 2
        order = np.argpartition(d, half)
        sides = [order[:half], order[half:]]
        self.nodes[me] = (point, float(d[order[half]]), [(float(d[s].min()), float(d[s].max()), self.build(rest[s])) for s in sides])
        return me

    def descend(self, q: np.ndarray, best: Best) -> None:
        """Each query to one leaf."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                best.offer(who, q[who] @ self.x[node].T, node)
                continue
            point, median, sides = node
            inside = distances(q[who] @ self.x[point]) < median
            todo += [(side[2], part) for side, part in zip(sides, (who[inside], who[~inside]), strict=True) if len(part)]

    def search(self, q: np.ndarray, keep: int, rank: int, bound: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows of the ``keep`` best of each query; only the first ``rank`` of them are sure."""
        first = Best(len(q), keep, rank, bound)
        self.descend(q, first)
        best = Best(len(q), keep, rank, first.worst(np.arange(len(q))))
        todo = [(0, np.arange(len(q)))]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                self.met += len(who) * len(node)
                best.offer(who, q[who] @ self.x[node].T, node)
                continue
            point, _, sides = node
            self.met += len(who)
            score = q[who] @ self.x[point]
            best.offer(who, score[:, None], np.array([point]))
            d = distances(score)
            for low, high, child in sides:
                go = factor * np.maximum(d - high, low - d) <= best.worst(who) + SLACK
                if go.any():
                    todo.append((child, who[go]))
        return best.score, best.of

    def settled(self, q: np.ndarray, rank: int, bound: np.ndarray, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of the ``rank`` best and of all that tie with the last of them; queries with many ties are asked again for more."""
        todo = [(np.arange(len(q)), rank + SPARE)]
        while todo:
            who, keep = todo.pop()
            score, of = self.search(q[who], keep, rank, bound[who], factor)
            more = (of[:, -1] >= 0) & (score[:, -1] >= score[:, rank - 1] - TIE) & (keep < len(self.x))
            at, place = np.nonzero((of >= 0) & ~more[:, None])
            if len(at):
                yield who[at], of[at, place]
            again, step = who[more], max(1, BLOCK * rank // (4 * keep))
            todo += [(again[i : i + step], 4 * keep) for i in range(0, len(again), step)]


def dense(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def starting_bounds(q: np.ndarray, sample: np.ndarray | None, rank: int) -> np.ndarray:
    if sample is None or len(sample) < rank:
        return np.full(len(q), np.inf)
    return distances(np.partition(q @ sample.T, len(sample) - rank, axis=1)[:, len(sample) - rank])


def searching(samples: dict[int, np.ndarray], k: int, factor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a task come shard by shard, entries (ids is set) before queries."""

    def answers(tree: VantageTree, x: np.ndarray, ids: list[list[int]], segment: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin in range(0, segment.num_rows, BLOCK):
            part = segment.slice(begin, BLOCK)
            raw = dense(part.column("x"))
            q = units(raw)
            for who, of in tree.settled(q, k, starting_bounds(q, samples.get(raw.shape[1]), k), factor):
                score = cosines(raw[who], x[of])
                times = np.fromiter((len(ids[j]) for j in of), dtype=np.int64, count=len(of))
                who, score, names = np.repeat(who, times), np.repeat(score, times), np.array([i for j in of for i in ids[j]], dtype=np.int64)
                order = np.lexsort((names, -score, who))
                who, score, names = who[order], score[order], names[order]
                first = np.arange(len(who)) - np.searchsorted(who, who) < k
                rows = pa.array(who[first])
                yield pa.RecordBatch.from_arrays([part.column("a").take(rows), part.column("b").take(rows), pa.array(names[first]), pa.array(score[first])], names=["a", "b", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ids, tree, x = None, [], [], None, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            entry = batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (entry[1:] != entry[:-1])) + 1), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                segment = batch.slice(begin, end - begin)
                if shard[begin] != now:
                    now, parts, ids, tree, x = shard[begin], [], [], None, None
                if entry[begin]:
                    parts.append(dense(segment.column("x")))
                    ids += segment.column("ids").to_pylist()
                elif parts:
                    if tree is None:
                        x = np.concatenate(parts)
                        tree = VantageTree(units(x))
                    yield from answers(tree, x, ids, segment)

    return run


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, factor: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding", most: int = MOST, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score: of each row of ``vectors`` for which ``is_query`` holds, its k nearest other rows.

    ``factor`` one is exact. ``most`` bounds the entries that a task keeps at a time.
    """
    spark = vectors.sparkSession
    if factor < 1:
        raise ValueError("the factor is one or more")
    table = staged(entries(vectors, k + 1, vec_id, embedding), "vantage-entries")
    x = F.col(embedding)
    asked = vectors.where(takes_part(F.col(vec_id), x) & is_query).select(F.col(vec_id).cast("long").alias("query_id"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")).distinct()
    asked = staged(asked, "vantage-queries")
    sizes = {r.d: r.n for r in table.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of vectors
    total = max(1, sum(sizes.values()))
    shards = max(-(-total // most), min(-(-total // least), spark.sparkContext.defaultParallelism))
    sampled = table.orderBy("a", "b").select("x").limit(SAMPLE).collect()
    samples = {d: units(np.array([r.x for r in sampled if len(r.x) == d], dtype=np.float64)) for d in {len(r.x) for r in sampled}}
    # a shard holds vectors of one length: its number is the length times the shards, plus a hash
    length = F.size("x").cast("long") * shards
    held = table.select((length + F.pmod("a", F.lit(shards))).alias("shard"), "a", "b", "x", F.transform("ids", lambda i: i.cast("long")).alias("ids"))
    sought = table.join(asked.select("a", "b").distinct(), ["a", "b"], "left_semi")
    blocks = sought.select(F.explode(F.sequence(length, length + shards - 1)).alias("shard"), "a", "b", "x", F.lit(None).cast("array<bigint>").alias("ids"))
    dealt = held.unionByName(blocks).repartition(max(shards * len(sizes), 1), "shard").sortWithinPartitions("shard", F.col("ids").isNull())
    found = dealt.mapInArrow(searching(samples, k + 1, factor), "a bigint, b bigint, vec_id bigint, score double")
    by = W.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id")
    best = staged(found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).drop("n"), "vantage-found")
    pairs = asked.join(best, ["a", "b"]).where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(W.partitionBy("query_id", "a", "b").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
