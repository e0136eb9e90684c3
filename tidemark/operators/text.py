"""Text operators (TXT): plain text of pages and boolean keyword filters."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Elements whose content is no text, those that break a line and those that end a cell (from HTML's element kinds).
UNSEEN = "head script style template ix:header".split()
BREAKING = "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main nav ol p pre section table tr ul".split()
CELLS = ["td", "th"]


def page_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """TXT-01: text of HTML: unseen elements go, cells become tabs and blocks lines, entities are decoded, at most one blank line.

    The source is split at its tags and each piece brings the mark of its tag;
    only entities pass through a vectorised function.
    """

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)

    source = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "(?s)<!--.*?(-->|$)", "")
    for name in UNSEEN:
        source = F.regexp_replace(source, rf"(?is)<{name}\b[^>]*>.*?(</{name}\s*>|$)", "")
    pieces = F.split(F.regexp_replace(source, "<(?![a-zA-Z/!?])", "&lt;"), "<")

    def shown(piece: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, "^/?([a-zA-Z][a-zA-Z0-9:]*)", 1))
        words = F.regexp_replace(F.when(i == 0, piece).otherwise(F.regexp_extract(piece, "(?s)>(.*)$", 1)), r"\s+", " ")
        mark = F.when(name.isin(CELLS) & piece.startswith("/"), "\t").when(name.isin(BREAKING), "\n").otherwise("")
        return F.when(i == 0, words).otherwise(F.concat(mark, words))

    out = pages.withColumn("text", decoded(F.array_join(F.transform(pieces, shown), "")))
    lines = F.transform(F.split("text", "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \x{A0}]+", " "), F.lit(" ")))
    kept = F.filter(lines, lambda x, i: (F.btrim(x, F.lit(" \t")) != "") | ((i > 0) & (F.btrim(F.get(lines, i - 1), F.lit(" \t")) != "")))
    return out.withColumn("text", F.btrim(F.array_join(kept, "\n"), F.lit(" \t\n")))


def keyword_filter(text: Column, query: str) -> Column:
    """TXT-04: words AND, "phrases", OR and -exclusions over a text, whole words in any case; null counts as empty."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    groups: list[list[Column]] = [[]]
    for token in re.findall(r'-?"[^"]+"|\S+', query):
        if token.upper() == "OR" and token.isupper():
            groups.append([])
            continue
        exclude, words = token.startswith("-"), re.findall(r"\w+", token.lower())
        if words:
            hit = lowered.rlike(r"(?U)\b" + r"\W+".join(map(re.escape, words)) + r"\b")
            groups[-1].append(~hit if exclude else hit)
    out = F.lit(False)
    for g in groups:
        both = F.lit(bool(g))
        for c in g:
            both = both & c
        out = out | both
    return out


def inverted_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """TXT-03: (term, key, positions) of the lower-case words of every text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    spread = docs.select(F.col(key), words.alias("_w")).select(key, F.posexplode_outer("_w").alias("position", "term")).where("term IS NOT NULL")
    return spread.groupBy("term", key).agg(F.sort_array(F.collect_list("position")).alias("positions"))


def stem(term: Column) -> Column:
    """A word without its common English endings; both texts and queries are stemmed alike."""
    plain = F.regexp_replace(term, "(ies)$", "y")
    return F.when(F.length(term) > 4, F.regexp_replace(plain, "(?<=..[a-z])(ings?|edly|ed|es|ly|s)$", "")).otherwise(term)


def parsed_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Groups joined by OR of (excluded, words) terms; a phrase has several words."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for token in re.findall(r'-?"[^"]+"|\S+', query):
        if token == "OR":
            groups.append([])
        elif words := re.findall(r"\w+", token.lower()):
            groups[-1].append((token.startswith("-"), words))
    return [g for g in groups if any(not no for no, _ in g)]


def search(index: DataFrame, docs: DataFrame, key: str, query: str, limit: int | None = None, k: float = 1.2) -> DataFrame:
    """TXT-03: documents that match words AND, "phrases", OR and -exclusions, stems alike, best first, with a snippet.

    The score is the sum of saturated term counts times inverse document
    frequency. Only the postings of the query's words are read, which the filter
    on terms brings to before the index's shuffle, and each document's stand side
    by side, an array a stem; a phrase is a run of positions. ``docs`` (key, text)
    gives the number of documents and the snippets.
    """
    groups = parsed_query(query)
    words = sorted({w for g in groups for _, ws in g for w in ws})
    stems = dict(zip(words, index.sparkSession.range(1).select(*(stem(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words))).first(), strict=True)) if words else {}
    kept = sorted(set(stems.values()))
    near = F.left("term", F.lit(2)).isin(sorted({s[:2] for s in kept}))  # a stem begins like its words; spares most of them the stemmer
    found = index.where(near).withColumn("_s", stem(F.col("term"))).where(F.col("_s").isin(kept)).groupBy(key).agg(F.collect_list(F.struct("_s", "positions")).alias("_f"))
    of = lambda s: F.flatten(F.transform(F.filter("_f", lambda x: x["_s"] == s), lambda x: x["positions"]))
    spread = found.select(key, *(of(s).alias(f"_p{i}") for i, s in enumerate(kept)))
    at = {w: F.col(f"_p{kept.index(s)}") for w, s in stems.items()}

    def begun(n: int) -> Callable[[Column], Column]:
        return lambda p: p - n

    def holds(ws: list[str]) -> Column:
        runs = at[ws[0]]
        for i, w in enumerate(ws[1:], 1):
            runs = F.array_intersect(runs, F.transform(at[w], begun(i)))
        return F.size(runs) > 0

    match = F.lit(False)
    for g in groups:
        both = F.lit(True)
        for no, ws in g:
            both = both & (~holds(ws) if no else holds(ws))
        match = match | both
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    held = spread.agg(F.array(*(F.count_if(F.size(f"_p{i}") > 0) for i in range(len(kept)))).alias("df"))
    score = F.lit(0.0)
    for i in range(len(kept)):
        tf, df = F.size(f"_p{i}"), F.col("_df")[i]
        score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (k + 1) / (tf + k)
    wanted = {w for g in groups for no, ws in g if not no for w in ws}
    # one value each, not computed where the score is not asked for
    best = spread.where(match).withColumns({"_n": total.scalar(), "_df": held.scalar()}).select(key, F.round(score, 6).alias("score"))
    best = best if limit is None else best.orderBy(F.desc("score"), key).limit(limit)
    snippet = F.regexp_extract("text", r"(?is).{0,40}\b(" + "|".join(map(re.escape, sorted(wanted))) + r")\b.{0,40}", 0) if wanted else F.lit("")
    return best.join(docs.select(key, "text"), key).select(key, "score", snippet.alias("snippet"))


def section(text: Column, start: list[str], end: str, least: int = 200) -> Column:
    """TXT-02: the longest span from a start heading to the first end heading more than 20 characters later; null under ``least`` characters.

    The start patterns are tried in order; the first that gives a span counts.
    """
    found = []
    for pattern in start:
        spans = F.regexp_extract_all(text, F.lit(rf"(?ims)^[ \t]*(?:{pattern}).{{20}}.*?(?=^[ \t]*(?:{end}))"), F.lit(0))
        longest = F.array_sort(F.transform(spans, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
        best = F.btrim(F.get(longest, F.lit(0))["x"])
        found.append(F.when(F.length(best) >= least, best))
    return F.coalesce(*found)


def wanted_reports(filings: DataFrame, since: Column, forms: dict[str, list[str]]) -> DataFrame:
    """TXT-05: filings since a day of the wanted forms; where items are named, with one of them."""
    wanted = F.lit(False)
    for form, items in forms.items():
        hit = F.col("form") == form
        wanted = wanted | ((hit & F.arrays_overlap(F.split("items", ","), F.array(*map(F.lit, items)))) if items else hit)
    return filings.where((F.col("filed") >= since) & wanted)


def matching_bills(bills: DataFrame, query: str, areas: list[str], subjects: list) -> DataFrame:
    """TXT-06: bills whose title matches the query, or whose area and subject are both listed."""
    return bills.where(keyword_filter(F.col("title"), query) | (F.col("area").isin(areas) & F.col("subject").isin(subjects)))
