"""Line deduplication by an exact set-similarity join over the lines of all documents.

A line's set is its distinct words; two lines match when the Jaccard similarity
of their sets is ``percent`` / 100 or more, and a line goes when it matches any
line before it in (doc_id, line number) order. Only DataFrame expressions are
used.

Words are ordered by rarity: a word's token is a long whose high bits are the
rank of its hash bucket by corpus count and whose other bits are the rest of its
64-bit hash, so sorting tokens sorts words from rare to common and equal tokens
mean equal hashes. Lines of equal text form a class of which only the first line
goes on; the copies go at once. That line posts its rarest words, the prefix;
two lines can only match when they share a word of both prefixes (lines so short
that only an equal set matches post a hash of the set instead). A posted word
carries the set's size, the word's place and a parity sketch of the set (the
exclusive or of one of 64 bits per word, of long lines one of 128), so that the join itself applies the length
filter, the positional filter and a bound on the symmetric difference; all are
exact. A word is joined together with a class of the set's size, so that most
pairs the length filter would drop never meet. Pairs that pass are verified on
the words of their lines.

Large groups of near copies stay linear: lines that share the least or the
greatest of their word hashes have a head, the first of them. A line whose
sketch says that it may match its head is compared with that head first, and
needs nothing more when it does; every other line meets everything before it in
its lists. Of two lines that match, the one with fewer words shares a word of an
even shorter prefix, so only that is posted for it. The lists are joined in
parts, by hash of the word, so that one part's postings are on disk at a time.
Of several lines that a line matches, any may be named.

Lines without words (blank lines) are kept. A null text stays null; a row
without doc_id stays as it is and takes part in no match. Rows that repeat a
doc_id are ordered as if one document: lines at the same place never match each
other, and go together when one of them matches an earlier line. Very long lines
are sets like any other. Empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, deleted, fresh, staged

BUCKET_BITS = 16
PERCENT = 80
#: Posted words are joined in this many parts (a power of two), one after the other.
PARTS = 2
#: Lines of more words have a sketch of 128 bits; for the others one of 64 tells as much.
LONG = 80


def shift(value: Column, places: Column) -> Column:
    return F.call_function("shiftleft", value, places)


def rarity_ranks(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """One row with one array: for each hash bucket of words (of fixed number) its rank by corpus count and its number, combined by exclusive or, as high bits of a long."""
    size = 1 << BUCKET_BITS
    # explode_outer: for explode the optimizer adds a filter on the array, which would compute it a second time
    each = docs.select(F.explode_outer(split_words(F.col(text))).alias("w")).where("w <> ''")
    counts = each.select(F.shiftrightunsigned(F.xxhash64("w"), 64 - BUCKET_BITS).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(size).select(F.col("id").alias("b"))
    cells = every.join(counts, "b", "left").select(F.coalesce("n", F.lit(0)).alias("n"), "b")
    ordered = cells.agg(F.sort_array(F.collect_list(F.struct("n", "b"))).alias("c"))
    by_bucket = ordered.select(F.sort_array(F.transform("c", lambda x, i: F.struct(x["b"].alias("b"), i.cast("long").alias("rank")))).alias("c"))
    return by_bucket.select(F.transform("c", lambda x: shift((x["rank"] - F.lit(size // 2)).bitwiseXOR(x["b"]), F.lit(64 - BUCKET_BITS))).alias("ranks"))


def all_lines(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, line_no and line of every line with words."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode_outer(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.where(F.btrim("line", F.lit(SPACES)) != "")


def text_key(line: Column) -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64(line).alias("key"), F.xxhash64(F.lit(1), line).alias("key2")]


def split_words(text: Column) -> Column:
    """The words of a text, with an empty one where two white space characters meet."""
    return F.split(text, f"[{SPACES}]")


def word_hashes(line: Column) -> Column:
    """The distinct 64-bit hashes of a line's words."""
    hashes = F.transform(split_words(line), lambda x: F.xxhash64(x))
    return F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))


def parity(tokens: str, bits: list[int]) -> Column:
    """The exclusive or of one entry of ``bits`` for each token, at the place that the token's low bits give."""
    table = F.array(*(F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in bits))  # one constant: a look-up costs less than a shift for each word
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.get(table, x.bitwiseAND(F.lit(len(bits) - 1).cast("long")).cast("int"))))


def least_size(percent: int) -> int:
    """The smallest set that another set can match without being equal."""
    return next(k for k in range(1, 10_000) if 100 * k >= percent * (k + 1))


def first_lines(docs: DataFrame, percent: int) -> DataFrame:
    """The first line of each text: doc_id, line_no, n (set size), whole and half (parity sketches), low and high (of its words in another order), prefix (rarest words first), and key and key2 where the text stands more than once."""
    hashed = all_lines(docs).select("doc_id", "line_no", *text_key(F.col("line")), word_hashes(F.col("line")).alias("h"))
    # a hash's high bits are its bucket, and give way to the rank
    token = lambda h: F.get("r", F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")).bitwiseXOR(h)
    # above low and high, in the one expression that names it: there the optimizer puts the table (512 KB) into the expression; beside h it would be copied into every row
    ends = hashed.select("doc_id", "line_no", "key", "key2", F.array_min("h").alias("low"), F.array_max("h").alias("high"), "h").withColumn("r", rarity_ranks(docs).scalar())
    coded = ends.select("doc_id", "line_no", "key", "key2", "low", "high", F.sort_array(F.transform("h", token)).alias("tokens"))
    # whole is the parity of all words; half, of long lines only, that of the words whose hash has bit 6
    whole = parity("tokens", [1 << i for i in range(64)])
    half = F.when(F.size("tokens") > LONG, parity("tokens", [0] * 64 + [1 << i for i in range(64)]))
    n = F.size("tokens")
    prefix = F.when(n >= least_size(percent), F.slice("tokens", 1, (n - F.ceil(n * percent / 100).cast("int") + 1).cast("int"))).otherwise(F.array(F.xxhash64("tokens")))
    row = F.struct("doc_id", "line_no", n.alias("n"), whole.alias("whole"), half.alias("half"), "low", "high", prefix.alias("prefix"))
    several = [F.when(F.col("often") > 1, F.col(c)).alias(c) for c in ("key", "key2")]
    return coded.groupBy("key", "key2").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("often")).select("row.*", *several)


def copies(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b): the first line of a text, and each later line of the same text."""
    lines = all_lines(docs).select(*text_key(F.col("line")), F.struct("doc_id", "line_no").alias("own"))
    several = firsts.where("key is not null").select("key", "key2", F.struct("doc_id", "line_no").alias("first"))
    # shuffle_hash: a text stands once in the hashed table, and the lines need no sort
    return lines.join(several.hint("shuffle_hash"), ["key", "key2"]).where("own > first").select(F.col("first").alias("a"), F.col("own").alias("b"))


LINE = ("doc_id", "line_no", "n", "whole", "half")


def side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{name}_{c}") for c in (*LINE, *more)))


def place(name: str) -> Column:
    return F.struct(F.col(f"{name}_doc_id").alias("doc_id"), F.col(f"{name}_line_no").alias("line_no"))


def sizes(percent: int) -> tuple[Column, Column]:
    """Of lines a and b that match: the least overlap and the greatest symmetric difference."""
    total = F.col("a_n") + F.col("b_n")
    overlap = F.ceil(total * percent / (100 + percent)).cast("int")
    return overlap, total - 2 * overlap


def before(a: str, b: str) -> Column:
    return (F.col(f"{a}_doc_id") < F.col(f"{b}_doc_id")) | ((F.col(f"{a}_doc_id") == F.col(f"{b}_doc_id")) & (F.col(f"{a}_line_no") < F.col(f"{b}_line_no")))


def differences() -> Column:
    """No more than the symmetric difference of a and b."""
    whole, half = (F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")) for c in ("whole", "half"))
    return F.coalesce(F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half)), F.bit_count(whole))


def head_pairs(lines: DataFrame, percent: int) -> DataFrame:
    """(a, b): lines whose sketch says that they match a head."""
    keyed = lines.withColumn("k", F.explode(F.array("low", "high")))
    heads = keyed.groupBy("k").agg(F.min(F.struct(*LINE)).alias("head"), F.count(F.lit(1)).alias("often")).where("often > 1").select("k", "head.*")
    alike = before("a", "b") & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    met = side(keyed, "b", "k").join(side(heads, "a", "k").hint("shuffle_hash"), F.col("b_k") == F.col("a_k")).where(alike)
    bound = sizes(percent)[1]
    sure = differences() <= bound
    return met.where(sure).select(place("a").alias("a"), place("b").alias("b"), differences().alias("gap")).distinct()


def class_width(percent: int) -> float:
    """The logarithm of the largest ratio of two sizes in one class; the surplus covers rounding."""
    return math.log(100 / percent * 1.0001)


def size_class(percent: int) -> Column:
    """A number of a set's size: the larger one of two sets that match has the same number or the next."""
    return F.floor(F.log("n") / class_width(percent))


def smaller_posts(percent: int) -> Column:
    """Of a set that meets sets of its own size or more: the classes of those, each with the number of words that it posts there.

    The larger the partner, the more words must be shared, so fewer words are
    enough for the next class; sets that only match an equal one post nothing there.
    """
    n, size = F.col("n"), size_class(percent)
    next_least = F.greatest(n, F.ceil(F.exp((size + 1) * class_width(percent)) * (1 - 1e-9)))
    length = lambda least: F.greatest(n - F.ceil(percent * (n + least) / (100 + percent)) + 1, F.lit(0)).cast("int")
    few = n < least_size(percent)
    own, further = F.when(few, 1).otherwise(length(n)), F.when(few, 0).otherwise(length(next_least))
    return F.array(F.struct(size.alias("class"), own.alias("length")), F.struct((size + 1).alias("class"), further.alias("length")))


def larger_posts(percent: int) -> Column:
    """Of a set that meets smaller ones: its own class, with its whole prefix."""
    return F.array(F.struct(size_class(percent).alias("class"), F.size("prefix").alias("length")))


def posted(lines: DataFrame, name: str, posts: Column, part: int) -> DataFrame:
    """The first words of each prefix with the size classes, both as ``posts`` tells, where the hash of word and class falls into a part."""
    each = lines.select(*LINE, "open", "prefix", F.explode_outer(posts).alias("post"))
    words = each.select(*LINE, "open", F.col("post.class").alias("class"), F.posexplode_outer(F.slice("prefix", F.lit(1), F.col("post.length"))).alias("place", "word"))
    keyed = words.where("word is not null").select(*LINE, "open", "place", F.xxhash64("word", "class").alias("word"))
    return side(keyed.where(F.col("word").bitwiseAND(F.lit(PARTS - 1).cast("long")) == part), name, "open", "place", "word")


def open_pairs(lines: DataFrame, matched: DataFrame, percent: int, part: int) -> DataFrame:
    """Candidate pairs that share a posted word of one part and whose later line is not ``matched``.

    Of two lines that match, the one with fewer words (a; of equal sizes the
    earlier one) shares a word of the shorter prefix that is enough for larger partners.
    """
    rows = lines.join(matched.select("b.doc_id", "b.line_no", F.lit(False).alias("open")), ["doc_id", "line_no"], "left").withColumn("open", F.col("open").isNull())
    a, b = posted(rows, "a", smaller_posts(percent), part), posted(rows, "b", larger_posts(percent), part)
    total = F.col("a_n") + F.col("b_n")
    rest = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & before("a", "b"))
    later = F.when(before("a", "b"), F.col("b_open")).when(before("b", "a"), F.col("a_open")).otherwise(False)
    # as in sizes(), without a division for each pair; a sketch's bits are odd in number where the words are
    fits = (100 * F.col("a_n") >= percent * F.col("b_n")) & (rest * (100 + percent) >= total * percent) & (differences() * (100 + percent) <= total * (100 - percent)) & smaller & later
    met = a.hint("merge").join(b, (F.col("a_word") == F.col("b_word")) & fits)
    return met.select(F.least(place("a"), place("b")).alias("a"), F.greatest(place("a"), place("b")).alias("b"), differences().alias("gap")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets reach the similarity."""
    left = pairs.join(sets.select(F.col("at").alias("a"), F.col("words").alias("x")), "a")
    both = left.join(sets.select(F.col("at").alias("b"), F.col("words").alias("y")), "b")
    sized = both.select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("total"), F.size(F.array_intersect("x", "y")).cast("long").alias("n"))
    return sized.where(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("a", "b")


def wide_sketches(sets: DataFrame) -> DataFrame:
    """at, n and a parity sketch of 256 bits of each set."""
    part = lambda x, low, bits: F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    parity = lambda i: F.aggregate(F.filter("words", lambda x: part(x, 0, 2) == i), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(shift(F.lit(1).cast("long"), part(x, 2, 6))))
    return sets.select("at", "n", F.array(*map(parity, range(4))).alias("bits"))


def closer(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that a parity sketch of twice the size lets pass."""
    left = pairs.select("a", "b").join(sets.select(F.col("at").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("x")), "a")
    both = left.join(sets.select(F.col("at").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("y")), "b")
    gap = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(1, 4)), F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0])))
    return both.where(gap <= sizes(percent)[1]).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    """at: the places of either side, each once a side."""
    return pairs.select(F.col("a").alias("at")).distinct().unionByName(pairs.select(F.col("b").alias("at")).distinct())


def checked(docs: DataFrame, pairs: DataFrame, percent: int, name: str) -> DataFrame:
    """Of each later line b of the candidate pairs one pair that matches, or all of them, as a table of its own.

    The pair whose sketches differ least is verified first; only lines that do
    not match there have their other pairs compared.
    """
    sets = staged(words_of_lines(docs, ends(pairs)), f"{name}-sets")
    best = staged(pairs.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("best")).select("best.a", "b"), f"{name}-best")
    first = staged(verified(best, sets, percent), f"{name}-first")
    others = staged(pairs.select("a", "b").join(first.select("b"), "b", "left_anti").join(best, ["a", "b"], "left_anti"), f"{name}-others")
    wide = staged(wide_sketches(sets.join(ends(others), "at", "left_semi")), f"{name}-sketches")  # only of lines whose nearest did not match
    rest = staged(verified(closer(others, wide, percent), sets, percent), f"{name}-rest")
    deleted(sets, best, others, wide)
    return first.unionByName(rest)


def duplicate_lines(docs: DataFrame, *, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), match_doc_id and match_line_no of every line that goes, with an earlier line that it matches."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = staged(first_lines(docs, percent), "first-lines")
    heads = staged(head_pairs(lines, percent), "line-heads")
    found = checked(docs, heads, percent, "head-matches")
    matched = staged(found.select("b").distinct(), "matched-lines")
    parts = [staged(open_pairs(lines, matched, percent, i), "line-pairs") for i in range(PARTS)]  # one part's postings are on disk at a time
    pairs = staged(reduce(DataFrame.unionByName, parts).distinct(), "line-pairs")
    found = found.unionByName(checked(docs, pairs, percent, "line-matches"))
    gone = copies(docs, lines).unionByName(found).groupBy("b").agg(F.min("a").alias("a"))
    deleted(heads, matched, pairs, *parts)
    return gone.select(F.col("b.doc_id").alias("doc_id"), F.col("b.line_no").alias("line_no"), F.col("a.doc_id").alias("match_doc_id"), F.col("a.line_no").alias("match_line_no"))


def words_of_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """at, words (64-bit hashes) and n of the lines at the wanted places."""
    lines = wanted.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_set("at.line_no").alias("numbers"))
    # shuffle_hash: the same plan at every size, where a broadcast of the places would only do for small inputs, and texts need no sort
    texts = docs.join(lines.hint("shuffle_hash"), "doc_id").select("doc_id", F.split("text", "\n").alias("lines"), "numbers")
    each = texts.select("doc_id", F.explode_outer(F.transform("numbers", lambda i: F.struct(i.alias("line_no"), F.get("lines", i).alias("line")))).alias("x"))
    hashed = each.select(F.struct("doc_id", F.col("x.line_no").alias("line_no")).alias("at"), word_hashes(F.col("x.line")).alias("words"))
    return hashed.select("at", "words", F.size("words").alias("n"))


def remove_lines(docs: DataFrame, gone: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without the lines (doc_id, line_no) of ``gone``; n_chars, where present, follows a changed text."""
    key, numbers = fresh(docs, "_key"), fresh(docs, "_numbers")
    lines = gone.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(numbers))
    left = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(numbers, i))
    out = docs.join(lines, F.col("doc_id") == F.col(key), "left").withColumn(text, F.when(F.col(numbers).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(numbers).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
