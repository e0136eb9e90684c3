"""Benchmark decontamination: a q-gram filter that loses nothing, and exact alignment of what passes it.

Texts and benchmark items are sequences of words (runs of letters and digits,
lower case). A document holds an item when some stretch of it is within
``distance`` * (item length) word edits of the item. Within k edits of an item of
n words at least n - q + 1 - k q of its q-grams survive, in order and within k
places of their own offset. Where a document shows that many, the item is aligned
exactly (bit-parallel semi-global edit distance), so nothing false is reported
and nothing is missed.

The index of the benchmark is broadcast in blocks of at most ``block_chars``
characters of items, one pass over the documents for each block; documents are
never shuffled. Null and empty texts and items hold nothing. All rows and
columns pass through (``hits`` is replaced).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

DISTANCE, GRAM = 0.2, 3
HIT = StructType().add("item_id", LongType()).add("start_word", LongType()).add("n_words", LongType()).add("distance", LongType())
_WORDS = re.compile(r"[^\W_]+").findall


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        return 0


def allowed(n: int, distance: float = DISTANCE) -> int:
    """Word edits that an item of n words may have."""
    return int(math.floor(distance * n + 1e-9))


class Index:
    """Items of one block: word codes, and q-grams with offsets."""

    def __init__(self, items: list[tuple[int, str]], *, distance: float = DISTANCE):
        self.distance = distance
        self.codes, self.ids, self.words = _Codes(), [], []
        for key, text in items:
            if found := _WORDS(text.lower()):
                self.ids.append(key)
                self.words.append(np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in found], np.int64))
        self.base = len(self.codes) + 1
        grams = {q: defaultdict(list) for q in range(1, GRAM + 1)}
        for i, w in enumerate(self.words):
            k = allowed(len(w), distance)
            q = min(GRAM, len(w) // (k + 1))
            for offset, gram in enumerate(self._grams(w, q).tolist()):
                grams[q][gram].append((i, offset))
        self.grams = {q: (np.array(sorted(g), np.int64), g) for q, g in grams.items() if g}

    def _grams(self, codes: np.ndarray, q: int) -> np.ndarray:
        out = np.zeros(max(0, len(codes) - q + 1), np.int64)
        for j in range(q):
            out = out * self.base + codes[j : len(codes) - q + 1 + j]
        return out

    def seeds(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item: (diagonal, offset) of the q-grams that a document shares with it."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        known = codes > 0
        for q, (keys, places) in self.grams.items():
            if len(codes) < q:
                continue
            full = known[: len(codes) - q + 1].copy()
            for j in range(1, q):
                full &= known[j : len(codes) - q + 1 + j]
            at = np.flatnonzero(full)
            found = self._grams(codes, q)[at]
            place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            same = keys[place] == found
            for p, gram in zip(at[same].tolist(), found[same].tolist(), strict=True):
                for item, offset in places[gram]:
                    out[item].append((p - offset, offset))
        return out

    def hits(self, text: str) -> list[dict]:
        """The items that a text holds, each with the best place found."""
        codes = np.fromiter(map(self.codes.__getitem__, _WORDS(text.lower())), np.int64)
        best: dict[int, tuple[int, int, int]] = {}
        for item, found in self.seeds(codes).items():
            n = len(self.words[item])
            k = allowed(n, self.distance)
            q = min(GRAM, n // (k + 1))
            needed = n - q + 1 - k * q
            if len({o for _, o in found}) < needed:
                continue
            diagonals = np.array(sorted(d for d, _ in found))
            near = np.searchsorted(diagonals, diagonals + k, "right") - np.searchsorted(diagonals, diagonals - k, "left")
            spans: list[list[int]] = []  # stretches that overlap are aligned as one
            for start in np.unique(diagonals[near >= needed]).tolist():
                low, high = max(0, start - k), max(0, start + n + k)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            for low, high in spans:
                d, end = align(self.words[item], codes[low:high])
                if d <= k:
                    best[item] = min(best.get(item, (d + 1, 0, 0)), (d, max(low, low + end - n), n))
        return [{"item_id": self.ids[i], "start_word": s, "n_words": n, "distance": d} for i, (d, s, n) in sorted(best.items(), key=lambda x: (self.ids[x[0]], x[1]))]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where that stretch ends (bit-parallel)."""
    m = len(item)
    places = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        places[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text.tolist(), 1):
        eq = places.get(w, 0) if w else 0
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = (minus | ~(xh | plus)) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
        if score < best[0]:
            best = (score, j)
    return best


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, distance: float = DISTANCE, block_chars: int = 32_000_000, text: str = "text") -> DataFrame:
    """Add ``hits``: the benchmark items (item_id, text) that each document holds, with place and distance."""
    items = benchmark.select("item_id", "text").dropna().distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    out = docs.select([c for c in docs.columns if c != "hits"]).withColumn("hits", F.lit(None).cast(ArrayType(HIT)))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # at most about block_chars
        shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in rows])

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            index = Index(shared.value, distance=distance)
            kind = to_arrow_type(ArrayType(HIT))
            for batch in batches:
                at = batch.schema.get_field_index("hits")
                found = [(h.as_py() or []) + (index.hits(t.as_py()) if t.is_valid else []) for t, h in zip(batch.column(text), batch.column(at), strict=True)]
                yield batch.set_column(at, "hits", pa.array(found, kind))

        out = out.mapInArrow(run, out.schema)
    return out
