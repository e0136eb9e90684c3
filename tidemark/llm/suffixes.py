"""Passages that repeat across documents, by a sparse suffix array over minimiser positions.

The suffixes kept are those that begin at a minimiser: a word position whose
hashed k-gram is the least of some window of consecutive ones. The choice rests
on content alone, so copies of a passage keep the same suffixes, and any common
stretch of ``gram + window - 1`` words keeps at least one. Suffixes whose k-gram
occurs once are dropped; the others get their context, the hashed words that
follow and precede, are sorted by it with a range-partitioned sort, and each is
compared with its next neighbours of other documents: the common words to the
right and to the left of the minimiser make the match, and matches of ``least``
words or more are reported. A second order goes by the words that precede, so
that a passage whose end is boilerplate but whose beginning is rare has its
partner near as well. Overlapping matches of a document are merged, which extends them over
passages of any length.

Copies meet only their neighbours in the sorted order, so a passage that fills
the corpus costs as much per copy as one that occurs twice. Words are compared
by 16-bit hashes: a reported end may lie one word too far with probability
1.5e-5. A neighbour pair is lost where a partition of the sort ends; other
suffixes of the same passage show it.

Null ids, null texts and texts of fewer than ``least`` words have no passages.
Repeated rows of one doc_id count as one document. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import deleted, staged

GRAM, WINDOW, LEAST, AHEAD, BEHIND, PLACES = 8, 24, 50, 56, 24, 4
_FACTORS = np.random.default_rng(17).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_codes(text: str | None) -> np.ndarray:
    import xxhash

    words = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    n = max(0, len(codes) - gram + 1)
    out = np.zeros(n, np.uint64)
    for j in range(gram):
        out += codes[j : j + n] * _FACTORS[j]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def minimisers(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window; of a run of equal hashes only the first can be chosen."""
    if not len(hashes):
        return np.empty(0, np.int64)
    ranked = hashes.copy()
    top = np.iinfo(np.uint64).max
    ranked[1:][hashes[1:] == hashes[:-1]] = top
    if len(ranked) <= window:
        chosen = np.array([ranked.argmin()])
    else:
        views = np.lib.stride_tricks.sliding_window_view(ranked, window)
        chosen = np.concatenate([views[s : s + 8192].argmin(axis=1) + np.arange(s, min(s + 8192, len(views))) for s in range(0, len(views), 8192)])
        chosen = np.unique(chosen)
    return chosen[ranked[chosen] != top]


def anchors(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(hash, doc_id, place) of the minimisers of every document with ``least`` words or more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                hashes, ids, places = [], [], []
                for key, text in zip(part.column("doc_id").to_numpy(), part.column("text"), strict=True):
                    codes = word_codes(text.as_py())
                    if len(codes) >= least:
                        h = gram_hashes(codes, gram)
                        at = minimisers(h, window)
                        hashes.append(h[at].view(np.int64))
                        ids.append(np.full(len(at), key, np.int64))
                        places.append(at.astype(np.int32))
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, ids, places)], ["hash", "doc_id", "place"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "hash long, doc_id long, place int")


def contexts(docs: DataFrame, wanted: DataFrame, *, gram: int = GRAM, ahead: int = AHEAD, behind: int = BEHIND) -> DataFrame:
    """(hash, after, before, doc_id, place) of wanted places; after and before hold 16-bit word hashes, before read backwards."""
    places = wanted.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(places.hint("merge"), "doc_id")  # merge: places grow with the documents

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, text, at in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                codes = word_codes(text.as_py())
                h = gram_hashes(codes, gram)
                at = np.sort(at.values.to_numpy())
                at = at[at < len(h)]
                small = ((codes >> np.uint64(20)).astype(np.uint16)).astype(">u2")
                forward, backward = small.tobytes(), small[::-1].tobytes()
                size = len(backward)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[at].view(np.int64)),
                        pa.array([forward[2 * p : 2 * (p + ahead)] for p in at.tolist()], pa.binary()),
                        pa.array([backward[size - 2 * p : size - 2 * p + 2 * behind] for p in at.tolist()], pa.binary()),
                        pa.array(np.full(len(at), key, np.int64)),
                        pa.array(at.astype(np.int32)),
                    ],
                    ["hash", "after", "before", "doc_id", "place"],
                )

    return rows.mapInArrow(run, "hash long, after binary, before binary, doc_id long, place int")


def common_words(x: bytes, y: bytes) -> int:
    """Equal 16-bit words at the front of two byte strings."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // 2
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return (n * 8 - differ.bit_length()) // 16


def matches(suffixes: DataFrame, *, least: int = LEAST, places: int = PLACES, leftwards: bool = False) -> DataFrame:
    """(doc_id, first, last, other_doc_id): word spans [first, last) that neighbours in the sorted order share.

    Each suffix meets the nearest suffixes of ``places`` other documents before
    it. The order goes by what follows the minimiser, or leftwards by what precedes it.
    """
    order = ["hash", "before", "after", "doc_id", "place"] if leftwards else ["hash", "after", "before", "doc_id", "place"]
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        recent: dict[int, tuple] = {}  # the last suffix of each of the last documents
        last = None
        for batch in batches:
            found: dict[tuple, None] = {}
            for key, after, before, doc, place in zip(*(batch.column(c).to_pylist() for c in ("hash", "after", "before", "doc_id", "place")), strict=True):
                if key != last:
                    recent, last = {}, key
                recent.pop(doc, None)
                for d, (a, b, p) in recent.items():
                    right, left = common_words(after, a), common_words(before, b)
                    if left + right >= least:
                        found[doc, place - left, place + right, d] = None
                        found[d, p - left, p + right, doc] = None
                recent[doc] = (after, before, place)
                if len(recent) > places:
                    del recent[next(iter(recent))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["doc_id", "first", "last", "other_doc_id"])

    return ordered.mapInArrow(run, "doc_id long, first long, last long, other_doc_id long")


def repeated_passages(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Merged spans of each document: doc_id, start_word, n_words, first_other_doc_id and n_matches.

    first_other_doc_id is the smallest document found to share a part of the span.
    """
    if gram + window - 1 > least:
        raise ValueError("a passage of the least length must hold a whole window")
    entries = staged(anchors(docs, gram=gram, window=window, least=least), "anchors")
    several = entries.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = entries.join(several.select("hash").hint("merge"), "hash", "left_semi").select("doc_id", "place")
    kept = staged(contexts(docs, wanted, gram=gram), "suffixes")
    spans = [staged(matches(kept, least=least, leftwards=x), "spans") for x in (False, True)]
    deleted(entries, kept)
    spans = spans[0].unionByName(spans[1]).distinct()
    spans = spans.groupBy("doc_id", "first", "last").agg(F.min("other_doc_id").alias("other"), F.count(F.lit(1)).alias("n"))
    by_start = W.partitionBy("doc_id").orderBy("first", "last")
    reach = F.max("last").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("begins", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("begins").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "island").agg(F.min("first").alias("start_word"), F.max("last").alias("end"), F.min("other").alias("first_other_doc_id"), F.sum("n").alias("n_matches"))
    return merged.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "first_other_doc_id", "n_matches")
