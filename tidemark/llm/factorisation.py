"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words hashed into 2^16 places (log counts,
unit length), and one-hot bins of structure statistics (share of capitals,
symbols and digits, word length, repeated words, repeated lines, length) and of
the metadata column n_chars. Pairwise interactions have rank ``rank`` and are
scored in linear time: the sum over pairs is half of the square of the sum less
the sum of squares, per factor.

The model is fitted on a bounded sample of labelled rows (``sample``); Spark
turns texts into vectors and scores every whole text with the broadcast
parameters, whose size is fixed. Labels, lang, source and doc_id are no inputs.

Null and empty texts have no words and get a score from the structure bins
alone. Rows are returned as often as they occur.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_PLACES = 1 << 16
BINS = 8
STATISTICS = ["capitals", "symbols", "digits", "word_length", "repeated_words", "repeated_lines", "short_lines", "n_words", "n_chars"]
PLACES = WORD_PLACES + BINS * len(STATISTICS)
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")

_hashed: dict[str, int] = {}


def _place(token: str) -> int:
    if (p := _hashed.get(token)) is None:
        if len(_hashed) > 300_000:
            _hashed.clear()
        p = _hashed[token] = zlib.crc32(token.encode()) & WORD_PLACES - 1
    return p


def vector(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (int32) and values (float32) of a document."""
    text = text or ""
    tokens = _TOKENS.findall(text.lower())
    counts = Counter(tokens)
    places = np.fromiter(map(_place, counts), np.int32, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(values):
        values /= np.sqrt((values * values).sum())
    lines = [x for x in text.split("\n") if x.strip()]
    size = max(1, len(text))
    total = max(1, len(tokens))
    symbols = sum(n * len(t) for t, n in counts.items() if not t[0].isalnum())
    shares = {
        "capitals": sum(map(str.isupper, text)) / size * 8,
        "symbols": symbols / size * 24,
        "digits": sum(n * len(t) for t, n in counts.items() if t[0].isdigit()) / size * 16,
        "word_length": math.log2(1 + size / total),
        "repeated_words": (1 - len(counts) / total) * BINS,
        "repeated_lines": (1 - len(set(lines)) / max(1, len(lines))) * BINS,
        "short_lines": sum(len(x) < 30 for x in lines) / max(1, len(lines)) * BINS,
        "n_words": math.log2(1 + len(tokens)) / 2,
        "n_chars": 0 if n_chars is None else math.log2(1 + max(0, n_chars)) / 2.5,
    }
    bins = [WORD_PLACES + k * BINS + min(BINS - 1, int(shares[name])) for k, name in enumerate(STATISTICS)]
    return np.concatenate([places, np.array(bins, np.int32)]), np.concatenate([values, np.full(len(bins), 0.35, np.float32)])


def raw_scores(model: tuple[float, np.ndarray, np.ndarray], places: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores before the logistic function; row i has the entries ends[i] to ends[i + 1]."""
    bias, w, v = model
    n = len(ends) - 1
    row = np.repeat(np.arange(n), np.diff(ends))
    linear = np.bincount(row, w[places] * values, n)
    pairs = np.zeros(n)
    for f in range(v.shape[1]):
        x = v[places, f] * values
        pairs += np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n)
    return bias + linear + pairs / 2


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def maximise(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, rank: int = 4, epochs: int = 12, batch: int = 64, rate: float = 0.2, penalty: float = 1e-4, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad on the logistic loss; the result depends on the rows and the seed only."""
    random = np.random.default_rng(seed)
    bias, w, v = 0.0, np.zeros(PLACES), random.normal(0, 0.02, (PLACES, rank))
    seen_bias, seen_w, seen_v = 1e-6, np.full(PLACES, 1e-6), np.full((PLACES, rank), 1e-6)
    for _ in range(epochs if rows else 0):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            sizes = [len(rows[i][0]) for i in chosen]
            places, x = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), sizes)
            error = _logistic(raw_scores((bias, w, v), places, x, np.concatenate([[0], np.cumsum(sizes)]))) - labels[chosen]
            used, at = np.unique(places, return_inverse=True)
            g = error[row] * x
            gw = np.bincount(at, g, len(used)) / len(chosen) + penalty * w[used]
            gv = np.empty((len(used), rank))
            for f in range(rank):
                entry = v[places, f] * x
                total = np.bincount(row, entry, len(chosen))
                gv[:, f] = np.bincount(at, g * (total[row] - entry), len(used)) / len(chosen) + penalty * v[used, f]
            gb = error.mean()
            seen_bias += gb * gb
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            bias -= rate * gb / math.sqrt(seen_bias)
            w[used] -= rate * gw / np.sqrt(seen_w[used])
            v[used] -= 0.25 * rate * gv / np.sqrt(seen_v[used])
    return float(bias), w.astype(np.float32), v.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 6_000, **options) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on at most ``sample`` labelled rows (doc_id, quality), taken in hash order of doc_id.

    Of several labels for one id the largest counts, of several documents the least text. Without labels every score is one half.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "n_chars", F.col("quality").cast("int").alias("quality"))
    # of several rows of a labelled id one counts, so no more than ``sample`` rows reach the driver
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "quality")).alias("r")).select("doc_id", "r.*")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [vector(t.as_py(), n.as_py()) for t, n in zip(batch.column("text"), batch.column("n_chars"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([p.tobytes() for p, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["doc_id", "quality", "places", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInArrow(run, f"doc_id {kind}, quality int, places binary, values binary").collect(), key=lambda r: (r["doc_id"], r["places"]))
    vectors = [(np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float32)) for r in got]
    return maximise(vectors, np.array([r["quality"] for r in got], float), **options)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [vector(t.as_py(), n.as_py()) for t, n in zip(part.column("text"), part.column("n_chars"), strict=True)]
                ends = np.cumsum([0] + [len(p) for p, _ in found])
                z = raw_scores(shared.value, np.concatenate([p for p, _ in found]), np.concatenate([x for _, x in found]), ends)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_logistic(z), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, f"doc_id {kind}, score double")
