"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full shingle sets.

A document's set is the distinct hashes of its five-word shingles (all words as
one shingle when there are fewer). Equal sets are one class, so copies never
meet each other. Each class has ``trees`` signatures of ``depth`` minimum hashes.
Every tree is one sorted order of its signatures (a range-partitioned sort), and
candidates are neighbours in that order: two classes meet when they share a
prefix of at least ``least_depth`` values and either stand within ``window``
places, or the region of the order that shares their longest common prefix has
at most ``region`` classes. Classes of larger regions (texts on one template)
that the links found there leave in several groups are also joined exactly with each other: two sets of the wanted similarity share
one of their rarest shingles (prefix filter), and lengths and places of the
shared shingle bound their overlap.

Confirmation takes three rounds so that large groups of near copies stay linear:
first each class with its best earlier neighbour, then those remaining pairs
whose ends the first round's links do not yet connect, then the pairs of the
exact join between groups that are still apart. All compare full sets
(intersection and union sizes of 64-bit shingle hashes, as integers).

Recall is that of the forest, in crowds as elsewhere: at similarity 0.85 a pair
shares three values in a tree with probability 0.61 and is then met, in a small
region directly and in a large one by the join, so all 16 trees miss it with
3e-7; a pair at the border of two range partitions is lost to that tree alone.

Null and empty texts have empty sets, are linked with nothing and are kept.
Repeated rows are returned as often as they occur. A row without doc_id has no
component and is not kept. Of the input only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.components import components

SHINGLE = 5
TREES, DEPTH, LEAST_DEPTH, WINDOW, REGION = 16, 8, 3, 3, 24
BUCKET_BITS = 16


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, ASCII letters in lower case."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes split at space and \t to \r only
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    factors = _constants(size + 1, 7)
    sums = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        sums += codes[j : j + len(sums)] * factors[j]
    sums ^= np.uint64(width) * factors[size:]
    sums ^= sums >> np.uint64(31)
    sums *= np.uint64(0x9E3779B97F4A7C15)
    sums ^= sums >> np.uint64(29)
    return np.unique(sums)


def minimum_hashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` minimum hashes of 32 bits."""
    factors, offsets = _constants(count, 11), _constants(count, 13)
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 512):  # blocks that fit the processor's cache
        np.minimum(out, (hashes[start : start + 512, None] * factors + offsets).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _signed(a: np.ndarray) -> np.ndarray:
    return (a ^ np.uint32(1 << 31)).view(np.int32)  # keeps the order


def signatures(docs: DataFrame, *, trees: int = TREES, depth: int = DEPTH, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, set_key (digest of the set), n_shingles and signature (array of int) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keys, sizes, flat, ends = [], [], [], [0]
                for text in part.column("text"):
                    h = shingle_hashes(text.as_py(), shingle)
                    keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    sizes.append(len(h))
                    if len(h):
                        flat.append(_signed(minimum_hashes(h, trees * depth)))
                    ends.append(len(flat) * trees * depth)
                values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                    ["doc_id", "set_key", "n_shingles", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, set_key binary, n_shingles long, signature array<int>")


def neighbours(tree: np.ndarray, keys: np.ndarray, ids: np.ndarray, least: int, window: int, region: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (smaller id, larger id, common prefix length) among rows in sorted order."""
    n, depth = keys.shape
    if n < 2:
        return ids[:0], ids[:0], np.empty(0, np.int32)
    same = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
    common = np.cumprod(same, axis=1).sum(axis=1)  # of rows i and i + 1
    sizes = np.empty((depth + 1, n), np.int64)
    for d in range(least, depth + 1):
        run = np.concatenate([[0], np.cumsum(common < d)])
        sizes[d] = np.bincount(run)[run]
    out, shared = [], common.copy()
    for k in range(1, max(window, region)):
        if k > 1:
            if len(shared) < 2:
                break
            shared = np.minimum(shared[:-1], common[k - 1 :])
        at = np.flatnonzero(shared >= least)
        if not len(at):
            break
        length = shared[at]
        if k > window:
            small = sizes[length, at] <= region
            at, length = at[small], length[small]
        out.append((ids[at], ids[at + k], length))
    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.empty(0, np.int64))
    differ = a != b
    return np.minimum(a, b)[differ], np.maximum(a, b)[differ], c[differ].astype(np.int32)


def crowded(tree: np.ndarray, keys: np.ndarray, ids: np.ndarray, least: int, region: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, region code) of the rows whose first ``least`` values more than ``region`` rows share."""
    if not len(ids):
        return ids, ids
    begins = (keys[1:, :least] != keys[:-1, :least]).any(axis=1) | (tree[1:] != tree[:-1])
    run = np.concatenate([[0], np.cumsum(begins)])
    many = np.bincount(run)[run] > region
    factors = _constants(least + 1, 19)
    codes = tree[many].astype(np.uint64) * factors[least]
    for j in range(least):
        codes += keys[many, j].astype(np.uint64) * factors[j]
    return ids[many], codes.view(np.int64)


def candidates(classes: DataFrame, *, depth: int = DEPTH, least_depth: int = LEAST_DEPTH, window: int = WINDOW, region: int = REGION) -> DataFrame:
    """(a, b, weight) of class pairs that meet in the forest, a < b; weight sums the common prefixes over the trees.

    Rows of weight 0 are the classes (a) of regions that are too large to be paired here, with a code of the region (b).
    """
    cuts = F.expr(f"transform(sequence(0, cast(size(signature) / {depth} as int) - 1), t -> slice(signature, t * {depth} + 1, {depth}))")
    rows = classes.select("class_id", F.posexplode_outer(cuts).alias("tree", "key")).where("key is not null")
    ordered = rows.repartitionByRange("tree", "key", "class_id").sortWithinPartitions("tree", "key", "class_id")
    block = 1 << 18

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] | None = None

        def columns(batch) -> list[np.ndarray]:
            key = batch.column("key")
            return [batch.column("tree").to_numpy(), key.flatten().to_numpy().reshape(-1, depth), batch.column("class_id").to_numpy()]

        def pairs(x: list[np.ndarray]):
            a, b, c = neighbours(*x, least_depth, window, region)
            many, codes = crowded(*x, least_depth, region)
            a, b, c = np.concatenate([a, many]), np.concatenate([b, codes]), np.concatenate([c, np.zeros(len(many), np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], ["a", "b", "common"])

        for batch in batches:
            new = columns(batch)
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) >= block:
                yield pairs(held)
                held = [x[-region:] for x in held]  # the next block's rows also meet these
        if held is not None:
            yield pairs(held)

    met = ordered.mapInArrow(run, "a long, b long, common int")
    return met.groupBy("a", "b").agg(F.sum("common").alias("weight"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(class_id, hashes) of the wanted classes, whose ids are doc_ids of ``docs``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in part.column("text")]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("class_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets), pa.int64()))], ["class_id", "hashes"])

    # merge: the same plan at every size, where a broadcast of the ids would only do for small inputs
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), "text").join(wanted.hint("merge"), "class_id", "left_semi")
    return texts.mapInArrow(run, "class_id long, hashes array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) with 100 * |intersection| >= percent * |union|."""
    left = pairs.select("a", "b").join(sets.select(F.col("class_id").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a")
    both = left.join(sets.select(F.col("class_id").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b")
    sized = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("n"))
    return sized.where(F.lit(100).cast("long") * F.col("n") >= percent * (F.col("nx") + F.col("ny") - F.col("n"))).select("a", "b").distinct()


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each hash bucket (of fixed number) occur; what occurs once in a task may be left out.

    It only serves an order of the shingles: every order gives all pairs, this one short lists.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            values = batch.column("hashes").flatten().to_numpy().view(np.uint64)
            seen += np.bincount((values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(seen))
        often = np.flatnonzero(seen > 1)
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(seen[often])], ["bucket", "n"])

    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in sets.select("hashes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def postings(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """class_id, n, hash, place (from 1) and indexed of the rarest shingles of each set, enough of them to share one with every similar set.

    ``indexed`` are those that are enough for a set that is not the larger one.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, sizes, hashes, places, indexed = [], [], [], [], []
                for key, values in zip(part.column("class_id").to_pylist(), part.column("hashes"), strict=True):
                    h = values.values.to_numpy()
                    n = len(h)
                    least = n + 1 + -percent * n // 100  # n - ceil(percent * n / 100) + 1
                    order = np.lexsort((h, counts[(h.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))[:least]
                    hashes.append(h[order])
                    places.append(np.arange(1, len(order) + 1))
                    indexed.append(places[-1] <= n + 1 + -2 * percent * n // (100 + percent))
                    ids += [key] * len(order)
                    sizes += [n] * len(order)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(np.concatenate(x)) for x in (hashes, places, indexed))], ["class_id", "n", "hash", "place", "indexed"])

    return sets.select("class_id", "hashes").mapInArrow(run, "class_id long, n long, hash long, place long, indexed boolean")


def prefix_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different groups, among them every pair with 100 * |intersection| >= percent * |union|.

    Shingles are ordered by rarity. The first shingle that such a pair shares lies
    in the prefix of both sets, where enough shingles follow for the overlap.
    """
    known = groups.select(F.col("node").alias("class_id"), "component")
    rows = postings(sets, bucket_counts(sets), percent).join(known, "class_id", "left")
    posted = staged(rows.select("hash", "class_id", F.coalesce("component", "class_id").alias("component"), "n", "place", "indexed"), "postings")
    tops = posted.groupBy("hash", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("hash").agg(F.max_by("component", F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    # pairs inside the largest group of a list are never formed: one side is always of another group
    tagged = posted.join(tops.hint("merge"), "hash").select("hash", "class_id", "component", "n", "place", "indexed", (F.col("component") == F.col("top")).alias("main"))
    x, y = tagged.where("indexed").alias("x"), tagged.alias("y")
    overlap = f"ceil({percent} * cast(x.n + y.n as bigint) / {100 + percent} - 1e-9)"
    fits = F.expr(f"x.hash = y.hash and (x.n < y.n or x.n = y.n and x.class_id < y.class_id) and x.component <> y.component and 100 * x.n >= {percent} * y.n and x.n - x.place + 1 >= {overlap} and y.n - y.place + 1 >= {overlap}")
    found = [left.hint("merge").join(right, fits).select(F.least("x.class_id", "y.class_id").alias("a"), F.greatest("x.class_id", "y.class_id").alias("b")) for left, right in ((x.where("not x.main"), y), (x.where("x.main"), y.where("not y.main")))]
    return found[0].unionByName(found[1]).distinct()


def regrouped(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, component) of the groups after linked pairs (a, b) of nodes join them."""
    group_a = groups.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    group_b = groups.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    links = staged(pairs.join(group_a, "a", "left").join(group_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "links")
    merged = components(links).select(F.col("node").alias("component"), F.col("component").alias("final"))
    final = groups.join(merged, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    alone = merged.join(groups.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("final").alias("component"))
    return final.unionByName(alone)


def near_duplicates(docs: DataFrame, *, percent: int = 85, trees: int = TREES, depth: int = DEPTH, least_depth: int = LEAST_DEPTH, window: int = WINDOW, region: int = REGION, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    signed = staged(signatures(docs, trees=trees, depth=depth, shingle=shingle), "signatures")
    some = signed.where("set_key is not null and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.any_value("signature").alias("signature"))
    found = staged(candidates(classes, depth=depth, least_depth=least_depth, window=window, region=region), "candidates")
    met, crowd = found.where("weight > 0"), found.where("weight = 0").select(F.col("a").alias("class_id"), F.col("b").alias("region"))
    wanted = found.select(F.col("a").alias("class_id")).unionByName(met.select(F.col("b").alias("class_id"))).distinct()
    sets = staged(shingle_sets(docs, wanted, shingle=shingle), "sets")
    first = met.groupBy("b").agg(F.max_by("a", F.struct("weight", -F.col("a"))).alias("a"))
    groups = components(confirm(first, sets, percent))
    group_a = groups.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    group_b = groups.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = met.select("a", "b").join(first.select("a", "b"), ["a", "b"], "left_anti").join(group_a, "a", "left").join(group_b, "b", "left")
    apart = apart.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")
    groups = regrouped(groups, confirm(apart, sets, percent))
    groups = staged(groups, "groups")
    # a region whose classes are linked already has nothing more to join
    placed = crowd.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    mixed = placed.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("region")
    dense = staged(placed.join(mixed, "region", "left_semi").select("class_id").distinct(), "dense")
    if not dense.isEmpty():
        dense = staged(sets.join(dense.hint("merge"), "class_id", "left_semi"), "dense-sets")  # read for the counts and for the order
        groups = regrouped(groups, confirm(prefix_pairs(dense, groups, percent), sets, percent))
    members = some.groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    known = members.join(groups.select(F.col("node").alias("class_id"), F.col("component").alias("found")), "class_id", "left").select("set_key", F.coalesce("found", "class_id").alias("component_id"))
    out = signed.select("doc_id", "set_key", "n_shingles").join(known, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"))
