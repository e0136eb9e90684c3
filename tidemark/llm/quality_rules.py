"""Quality rules: base statistics of a text and a hashed n-gram log-likelihood ratio.

Word unigrams and the character trigrams that end words are hashed into a fixed
number of buckets. Two multinomials over the buckets, one from trusted texts and
one from the whole corpus, give each bucket a log ratio; a document scores the
mean ratio of its n-grams and stays when the mean reaches a fixed threshold. Ratios
are rounded to integers of 1e-4, so sums do not depend on the order of addition
and the verdict of a document is the same on every run.

Only DataFrame expressions are used. The corpus counts need one aggregation
that is combined on the map side down to ``buckets`` rows per task; the ratio
table has ``buckets`` entries whatever the corpus size and reaches the tasks as
a scalar subquery, so scoring needs no shuffle at all.

Null text counts as empty; empty texts have no words and fail the base rules.
Repeated rows are judged one by one, extra columns pass through (a column that
has the name of a result is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, fresh, words

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
SCALE = 10_000


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once: a transform over a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array.

    Windows are hashed to 64 bits. Most texts have no equal hashes and end
    there. Else positions of the repeated windows come from a short list of
    repeated hashes, or, when that list is long, from sorting (hash, position)
    and comparing neighbours; both ways give the same positions. The covered
    words are the union of the intervals [i, i + 2].
    """
    n = F.size(w)
    ends = F.when(n >= 3, F.slice(w, 3, n - 2)).otherwise(F.array().cast("array<string>"))
    hashes = F.transform(ends, lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))

    def by_list(h: Column, repeated: Column) -> Column:
        return F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)))

    def by_order(h: Column) -> Column:
        def neighbours(s: Column) -> Column:
            hit = F.transform(s, lambda e, k: F.when((e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"]))
            return F.sort_array(F.array_compact(hit))

        return bound(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), neighbours)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(h: Column) -> Column:
        found = bound(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))
        at = bound(found, lambda r: F.when(F.size(r) <= 32, by_list(h, r)).otherwise(by_order(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bound(at, covered))

    return bound(hashes, repeated)


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def base_columns(df: DataFrame, text: str = "text", w: str = "_w") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; column ``w`` holds the words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    held = fresh(df, "_lines")
    out = df.withColumn(w, words(F.col(text))).withColumn(held, lines)
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(without(t, SPACES)).cast("long"),
            "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size(held) - F.size(F.array_distinct(held))).cast("long"),
            "n_repeat_words": repeated_words(F.col(w)),
        }
    ).drop(held)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ngram_buckets(w: Column, buckets: int) -> Column:
    """Bucket numbers of the words of an array and of their last three characters; ``buckets`` is a power of two."""
    low = F.lit(buckets - 1).cast("long")
    ends = F.transform(w, lambda x: F.xxhash64(F.lit(3), F.right(x, F.lit(3))).bitwiseAND(low).cast("int"))
    return F.concat(F.transform(w, lambda x: F.xxhash64(x).bitwiseAND(low).cast("int")), ends)


def ratio_table(corpus: DataFrame, trusted_ids: DataFrame, *, buckets: int = 1 << 16, smoothing: float = 1.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row with one array: for each bucket the rounded log of P(trusted) / P(corpus).

    Both multinomials are smoothed by the same share of their mass, ``smoothing``
    counts per bucket of the trusted one, so the ratio is that of the trusted
    count to the one expected from the corpus, at any corpus size.
    ``trusted_ids`` must be bounded by its maker (see ``trusted_sample``); it is
    broadcast. Counts cover every text of ``corpus``.
    """
    marked = corpus.select(F.col(key), F.col(text)).join(F.broadcast(trusted_ids.select(F.col(key), F.lit(1).alias("_t")).distinct()), key, "left")
    hashed = marked.select(F.coalesce("_t", F.lit(0)).alias("_t"), words(F.col(text)).alias("_w")).select("_t", ngram_buckets(F.col("_w"), buckets).alias("_b"))
    # explode_outer: for explode the optimizer adds a filter on the array, which would compute it a second time
    grams = hashed.select("_t", F.explode_outer("_b").alias("b")).where(F.col("b").isNotNull())
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("r"), F.sum("_t").alias("t"))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    cells = every.join(counts, "b", "left").select("b", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = cells.agg(F.sort_array(F.collect_list(F.struct("b", "r", "t"))).alias("c"), F.sum("r").alias("R"), F.sum("t").alias("T"))

    def ratio(x: Column) -> Column:
        expected = F.when(F.col("R") > 0, x["r"] * F.col("T") / F.col("R")).otherwise(F.lit(0.0))
        return F.round(F.log((x["t"] + smoothing) / (expected + smoothing)) * SCALE).cast("int")

    return rows.select(F.transform("c", ratio).alias("ratios"))


def trusted_sample(labels: DataFrame, *, limit: int = 20_000, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` ids labelled good and not toxic, taken in hash order (a stated bound for fitting)."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(key).dropna()
    return good.dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(limit)


def likelihood_score(df: DataFrame, table: DataFrame, *, buckets: int = 1 << 16, w: str = "_w") -> DataFrame:
    """Add n_grams, llr_sum (integer, 1e-4 units) and llr (mean log ratio; null without words) from an array of words."""
    # A subquery may not stand inside a lambda when it is written; each of b and r is used once, so the optimizer
    # inlines both and the table is never copied into rows.
    b, r = fresh(df, "_b"), fresh(df, "_r")
    out = df.withColumns({"n_grams": (2 * F.size(w)).cast("long"), b: ngram_buckets(F.col(w), buckets), r: table.scalar()})
    out = out.withColumn("llr_sum", F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + F.get(r, x))).drop(b, r)
    return out.withColumn("llr", F.when(F.col("n_grams") > 0, F.col("llr_sum") / F.col("n_grams") / SCALE))


def judge_quality(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 16, threshold: float = -0.5, trusted_limit: int = 20_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with the base columns, llr and ``kept``.

    ``kept`` is false when the base rules fail, else whether llr reaches the
    threshold. Without any trusted text every ratio is 0 and the base rules decide.
    """
    ratios = ratio_table(docs, trusted_sample(labels, limit=trusted_limit, key=key), buckets=buckets, text=text, key=key)
    w = fresh(docs, "_w")
    out = likelihood_score(base_columns(docs, text, w), ratios, buckets=buckets, w=w).drop(w)
    passes = F.coalesce(F.col("llr_sum") >= F.lit(int(threshold * SCALE)) * F.col("n_grams"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & passes)


def accepted(judged: DataFrame) -> DataFrame:
    """The kept rows of ``judge_quality``.

    A filter on ``kept`` alone would be pushed below the projections, with every
    expression it rests on written out again; a row number holds it in place.
    """
    row = fresh(judged, "_row")
    return judged.withColumn(row, F.monotonically_increasing_id()).where(F.col("kept") & (F.col(row) >= 0)).drop(row)
