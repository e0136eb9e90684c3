"""Full-text search (TXT-03): a stored inverted index in term buckets with block bounds, cover density and snippets."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stems import english_stem, stem

WORD = r"[\p{L}\p{N}]+"


def stop_words() -> list[str]:
    """Spark's list of English stop words, cut at apostrophes as texts are."""
    return sorted({w for x in StopWordsRemover.loadDefaultStopWords("english") for w in re.findall(r"\w+", x.lower())})


def _places(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Index:
    """A stored index of rows (bucket, term, block, key, places, n), n the number of places."""

    path: str
    key: str
    kind: str
    buckets: int
    ignored: frozenset[str]

    def read(self, spark, terms: list[str] | None = None) -> DataFrame:
        """The rows of some terms, or all; the filters on bucket and term reach the files."""
        schema = f"term string, block long, `{self.key}` {self.kind}, places array<int>, n int, bucket int"
        rows = spark.read.schema(schema).parquet(self.path)  # an empty index has no file to tell its columns
        return rows if terms is None else rows.where(F.col("bucket").isin(sorted({_bucket(t, self.buckets) for t in terms})) & F.col("term").isin(terms))


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def write_index(docs: DataFrame, key: str, path: str, text: str = "text", buckets: int = 64, spread: int = 8, block: int = 256, ignored: list[str] | None = None) -> Index:
    """TXT-03: store the index of a text column; ``key`` names each document once.

    Words are runs of letters and digits in lower case, counted from 0 with the
    ignored words (Spark's English stop words by default), which are not stored;
    null texts count as empty. Postings lie in folders by the hash of the stem,
    sorted by stem, and a common stem is spread over ``spread`` files by block.
    A block holds about ``block`` documents of like length, so that the most
    places of a stem in one of its documents says much about all of them. Each
    document is grouped by stem where it lies; one shuffle lays out the files.
    """
    ignored = stop_words() if ignored is None else ignored
    words = docs.select(F.col(key), _places(F.col(text)).alias("_w"))
    some = max(1, words.count() // block)
    shelf = F.floor(F.log2(F.size("_w") + 1)).cast("long") * some + F.pmod(F.xxhash64(key), F.lit(some))
    dropped, kind = frozenset(ignored), docs.schema[key].dataType.simpleString()

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row a document and bucket: its stems, and their places, as text, which is a third of nested arrays."""
        names = [key, "block", "bucket", "terms", "places"]
        for batch in batches:
            rows, held = [], 0
            for k, shelf, ws in zip(batch[key], batch["block"], batch["_w"], strict=True):
                at: dict[str, list[int]] = defaultdict(list)
                for i, w in enumerate(ws):
                    if w not in dropped:
                        at[english_stem(w)].append(i)
                cells: dict[int, list[str]] = defaultdict(list)
                for term in at:
                    cells[_bucket(term, buckets)].append(term)
                rows += [(k, shelf, n, " ".join(terms), " ".join(",".join(map(str, at[x])) for x in terms)) for n, terms in cells.items()]
                held += len(ws)
                if held > 500_000:  # long texts leave at once
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    each = words.where(F.size("_w") > 0).select(key, shelf.alias("block"), "_w").mapInPandas(grouped, f"`{key}` {kind}, block long, bucket int, terms string, places string")
    pairs = F.arrays_zip(F.split("terms", " ").alias("terms"), F.split("places", " ").alias("places"))
    laid = each.repartition("bucket", F.pmod("block", F.lit(spread))).select("bucket", "block", key, F.inline(pairs).alias("term", "places"))
    laid = laid.withColumn("places", F.split("places", ",").cast("array<int>"))
    laid.withColumn("n", F.size("places")).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(path)
    return Index(path, key, kind, buckets, dropped)


Unit = list[tuple[str, int]]  # stems with their distance from the first


def parse(query: str, ignored: frozenset[str] = frozenset()) -> list[tuple[list[Unit], list[Unit]]]:
    """Web syntax to groups joined by OR of (wanted, excluded) units: words, and "phrases" or hyphenated words as runs.

    Ignored words are dropped, but keep their place within a phrase.
    """
    groups: list[tuple[list[Unit], list[Unit]]] = [([], [])]
    for token in re.findall(r'-?"[^"]*"?|\S+', query):
        if token.lower() == "or":
            groups.append(([], []))
            continue
        words = re.findall(r"[^\W_]+", token.lower())
        kept = [(english_stem(w), i) for i, w in enumerate(words) if w not in ignored]
        if kept:
            groups[-1][token.startswith("-")].append([(w, i - kept[0][1]) for w, i in kept])
    return [(yes, no) for yes, no in groups if yes or no]


def _found(unit: Unit) -> Column:
    """Places where a unit begins."""
    at = lambda w: F.coalesce(F.col("_at")[w], F.array().cast("array<int>"))
    back = lambda d: lambda p: p - d
    runs = [F.transform(at(w), back(d)) if d else at(w) for w, d in unit]
    return reduce(F.array_intersect, runs)


def _matched(rows: DataFrame, key: str, groups: list[tuple[list[Unit], list[Unit]]]) -> DataFrame:
    """(key, score, first, last): documents that match with their cover density and the shortest cover.

    A cover is a span that holds every unit of a group and no shorter one; it
    counts 1 / (1 + words in it beyond one a unit). Covers come from one window
    over a document's places, so long documents cost n log n.
    """
    width = max(max(len(yes) for yes, _ in groups), 1)
    numbered = lambda i: lambda p: F.struct(p.alias("place"), F.lit(i).alias("unit"))
    tests, lists = [], []
    for g, (yes, no) in enumerate(groups):
        units = [_found(u) for u in yes]
        ok = reduce(lambda a, b: a & b, [F.size(u) > 0 for u in units] + [F.size(_found(u)) == 0 for u in no])
        tests.append(ok)
        cells = [F.transform(c, numbered(i)) for i, c in enumerate(units)]
        if cells:
            lists.append(F.struct(F.lit(g).alias("g"), F.lit(len(yes)).alias("n"), F.when(ok, F.concat(*cells)).alias("cells")))
    hits = rows.where(reduce(lambda a, b: a | b, tests))
    if not lists:
        return hits.select(key, F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    marks = hits.select(key, F.inline(F.array(*lists))).select(key, "g", "n", F.inline("cells"))
    ahead = W.partitionBy(key, "g").orderBy(F.desc("place"), F.desc("unit"))
    so_far = ahead.rowsBetween(W.unboundedPreceding, 0)
    ends = [F.when(F.col("n") <= i, F.col("place")).otherwise(F.last(F.when(F.col("unit") == i, F.col("place")), ignorenulls=True).over(so_far)) for i in range(width)]
    whole = reduce(lambda a, b: a & b, [e.isNotNull() for e in ends])
    spans = marks.withColumn("last", F.when(whole, F.greatest(*ends) if width > 1 else ends[0]))
    spans = spans.withColumn("_next", F.lag("last").over(ahead)).where("last IS NOT NULL AND (_next IS NULL OR _next > last)")
    noise = F.greatest(F.lit(0), F.col("last") - F.col("place") + 1 - F.col("n"))
    best = F.min(F.struct((F.col("last") - F.col("place")).alias("span"), F.col("place").alias("first"), F.col("last").alias("last")))
    scores = spans.groupBy(key).agg(F.sum(F.lit(1) / (F.lit(1) + noise)).alias("score"), best.alias("_b")).select(key, F.round("score", 6).alias("score"), "_b.first", "_b.last")
    if all(yes for yes, _ in groups):
        return scores
    return hits.select(key).join(scores, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"), "first", "last")


def _bounds(postings: DataFrame, groups: list[tuple[list[Unit], list[Unit]]]) -> DataFrame:
    """(block, bound): a score that no document of the block exceeds; blocks without a match are left out. Reads no places.

    A cover begins at a place of one of its units and counts at most 1, so a
    group cannot exceed the places of its units together.
    """
    at = postings.groupBy("block", "term").agg(F.max("n").alias("most")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "most"))).alias("_m"))  # one entry a term of the query
    total = F.lit(0)
    for yes, _ in groups:
        units = [F.least(*cs) if len(cs) > 1 else cs[0] for cs in ([F.coalesce(F.col("_m")[w], F.lit(0)) for w, _ in u] for u in yes)]
        total = total + F.when(reduce(lambda a, b: a & b, [u > 0 for u in units]), reduce(lambda a, b: a + b, units)).otherwise(0)
    return at.select("block", total.alias("bound")).where("bound > 0")


def search(index: Index, docs: DataFrame, query: str, limit: int | None = None, where: Column | None = None, text: str = "text", around: int = 8, first: int = 16) -> DataFrame:
    """TXT-03: (key, score, snippet) of the documents that match, best first, ties by key.

    ``where`` restricts documents by their other columns (entity, date). With a
    ``limit`` the ``first`` blocks of the highest bounds are scored, then those
    whose bound reaches the score of the last place: blocks below it cannot
    hold a better document, so the result is that of the whole index. A group
    of exclusions alone matches all other documents, with score 0. The snippet
    holds the shortest cover and ``around`` words, matches in brackets.
    """
    key, spark = index.key, docs.sparkSession
    groups = parse(query, index.ignored)
    scope = docs if where is None else docs.where(where)
    if not groups:
        return scope.select(key, F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    terms = sorted({w for yes, no in groups for u in yes + no for w, _ in u})
    postings = index.read(spark, terms)
    if where is not None:
        postings = postings.join(scope.select(key), key, "left_semi")

    def spread(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_at"))  # one entry a term of the query

    if not all(yes for yes, _ in groups):
        empty = F.create_map().cast("map<string,array<int>>")
        every = scope.select(key).join(spread(postings), key, "left").withColumn("_at", F.coalesce("_at", empty))
        best = _matched(every, key, groups)
    else:
        bounds = _bounds(index.read(spark, terms), groups)
        chosen = bounds.select("block")
        if limit is not None:
            head = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]  # at most first rows
            top = _matched(spread(postings.where(F.col("block").isin(head))), key, groups).orderBy(F.desc("score")).limit(limit).select("score").collect()  # at most limit rows
            if len(top) == limit and limit:
                chosen = bounds.where(F.col("bound") >= top[-1]["score"]).select("block")
        best = _matched(spread(postings.join(chosen, "block", "left_semi")), key, groups)
    if limit is not None:
        best = best.orderBy(F.desc("score"), key).limit(limit)
    wanted = sorted({w for yes, _ in groups for u in yes for w, _ in u})
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"([^\p{{L}}\p{{N}}]*)({WORD})"), F.lit(0))
    start = F.greatest(F.lit(0), F.coalesce("first", F.lit(0)) - around)
    shown = F.slice(pieces, start + 1, F.coalesce(F.col("last"), F.lit(0)) - start + 1 + around)
    cut = best.join(docs.select(key, text), key).select(key, "score", F.posexplode_outer(shown).alias("_i", "_p"))
    cut = cut.withColumn("_w", F.regexp_extract("_p", WORD, 0))
    word = F.when(stem(F.lower("_w")).isin(wanted), F.regexp_replace("_p", WORD, r"[$0]")).otherwise(F.col("_p"))
    parts = cut.withColumn("_p", word).groupBy(key, "score").agg(F.array_sort(F.collect_list(F.struct("_i", "_p"))).alias("_s"))
    return parts.select(key, "score", F.btrim(F.array_join(F.col("_s._p"), "")).alias("snippet")).orderBy(F.desc("score"), key)
