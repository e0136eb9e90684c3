"""Identity and linkage (IDN operators)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def symbol_as_of(asked: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """IDN-01: holder of a symbol on a date.

    The first past holder last seen on or after the date; else the current
    holder, unless the date is not after its rename; else the latest past
    holder if there is no current one. asked: symbol, date; history: symbol,
    security_id, last_seen; current: symbol, security_id, renamed_on.
    """
    h = history.select("symbol", F.col("security_id").alias("_h"), "last_seen")
    past = asked.join(h, "symbol", "left").groupBy("symbol", "date").agg(
        F.min(F.when(F.col("last_seen") >= F.col("date"), F.struct("last_seen", "_h"))).alias("_first"), F.max(F.struct("last_seen", "_h")).alias("_last")
    )
    joined = past.join(current.select("symbol", F.col("security_id").alias("_c"), "renamed_on"), "symbol", "left")
    now = F.when(F.col("_c").isNotNull(), F.when(F.col("renamed_on").isNull() | (F.col("date") > F.col("renamed_on")), F.col("_c"))).otherwise(F.col("_last._h"))
    return joined.select("symbol", "date", F.when(F.col("_first").isNotNull(), F.col("_first._h")).otherwise(now).alias("security_id"))


def best_listing(listings: DataFrame, by: str, rank: Column, tie: str) -> DataFrame:
    """IDN-06: the listing of least rank of each group; ties keep the first."""
    return listings.groupBy(by).agg(F.min_by("ticker", F.struct(rank, F.col(tie))).alias("ticker"))


def unique_bridge(held: DataFrame, filings: DataFrame, days: int = 365) -> DataFrame:
    """IDN-07: an issuer for a ticker and period if exactly one filed under the ticker within ``days`` of the period."""
    near = held.join(filings, "ticker").where(F.abs(F.datediff("filed", "period")) <= days)
    return near.groupBy("ticker", "period").agg(F.count_distinct("issuer").alias("_n"), F.min("issuer").alias("issuer")).where("_n = 1").drop("_n")


def prefix_bridge(mapped: DataFrame, unmapped: DataFrame, n: int = 6) -> DataFrame:
    """IDN-08: an issuer by the identifier's first n characters if all mapped identifiers with them agree."""
    known = mapped.groupBy(F.substring("cusip", 1, n).alias("_p")).agg(F.count_distinct("issuer").alias("_n"), F.min("issuer").alias("issuer")).where("_n = 1")
    return unmapped.withColumn("_p", F.substring("cusip", 1, n)).join(known, "_p").select("cusip", "issuer")


#: Legal words that do not tell companies apart, and what marks a receipt's name (fixed values).
NAME_WORDS = "co corp corporation company ltd limited inc plc ag sa se nv spa ab asa oyj kk the".split()
RECEIPT = r"(?i)[-\s/]+(UNSP|UNSPON|SPON|SPONS|SP)?\s*/?\s*(ADR|ADS|GDR)\b.*$"


def name_tokens(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.regexp_replace(name, RECEIPT, "")), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda t: (t != "") & ~t.isin(NAME_WORDS))


def names_match(a: Column, b: Column) -> Column:
    """IDN-09: first words equal and each word of the shorter name a prefix of a later word of the longer, in order; one-word names must be equal."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)

    def step(at: Column, word: Column) -> Column:
        later = F.filter(F.transform(long, lambda w, i: F.when((i >= at) & w.startswith(word), i)), lambda i: i.isNotNull())
        return F.when(at < 0, at).otherwise(F.coalesce(F.array_min(later) + 1, F.lit(-1)))

    walked = F.aggregate(short, F.lit(0), step)
    return F.when(F.size(short) == 0, False).when(F.size(short) == 1, F.size(long).eqNullSafe(1) & (F.get(short, 0) == F.get(long, 0))).otherwise((F.get(a, 0) == F.get(b, 0)) & (walked >= 0))


def match_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """IDN-10: links of (id, name) rows by unique name match; candidates share the first word."""
    a = left.select(F.col("id").alias("left_id"), name_tokens(F.col("name")).alias("a")).withColumn("w", F.get("a", 0))
    b = right.select(F.col("id").alias("right_id"), name_tokens(F.col("name")).alias("b")).withColumn("w", F.get("b", 0))
    hit = a.join(b, "w").where(names_match(F.col("a"), F.col("b")))
    return hit.groupBy("left_id").agg(F.count_distinct("right_id").alias("_n"), F.min("right_id").alias("right_id")).where("_n = 1").drop("_n")


def interval_members(reports: DataFrame, terms: DataFrame, grace: int = 120) -> DataFrame:
    """IDN-12: the member serving in the district on the filing day, if there is exactly one."""
    hit = reports.join(terms, "district").where((F.col("filed") >= F.col("start")) & (F.col("filed") <= F.date_add("end", grace)))
    return hit.groupBy("doc_id").agg(F.count_distinct("member").alias("_n"), F.min("member").alias("member")).where("_n = 1").drop("_n")


#: Parts of a name that do not tell people apart (fixed values).
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "md", "phd", "hon"]


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and the letters without, from their Unicode decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


MARKED, PLAIN = _plain_letters()


def person_words(name: Column) -> Column:
    """The distinct words of a person's name, in plain lower case, without suffixes and single letters."""
    letters = F.regexp_replace(F.lower(F.translate(F.coalesce(name, F.lit("")), MARKED, PLAIN)), "[^a-z]+", " ")
    return F.array_distinct(F.filter(F.split(letters, " "), lambda w: (F.length(w) > 1) & ~w.isin(NAME_SUFFIXES)))


def member_links(reports: DataFrame, terms: DataFrame, grace: int = 120) -> DataFrame:
    """IDN-12: doc_id, member and method (district or name) of each report that one serving member can have filed.

    A house report's seat (two letters and a number, AL is 0) names the member;
    where two held it around the day, the one whose last name the filer's holds.
    Else, of the chamber's members whose last name the filer's holds, the only
    one, or the only one whose first name or nickname is among its other words.
    Without a filing day, 1 July of the year stands in. reports: doc_id, chamber,
    state, name, filed, year; terms: member, chamber, state, district, last,
    first, nickname, start, end.

    Names meet on the rarest word of the last name, so a word that many filers
    share makes no candidates where a rarer one tells.
    """
    day = F.coalesce("filed", F.make_date(F.col("year"), F.lit(7), F.lit(1)))
    seat = F.upper(F.trim(F.coalesce("state", F.lit(""))))
    pattern = r"^([A-Z]{2})(\d{1,2}|AL)$"
    number = F.regexp_extract(seat, pattern, 2)
    asked = reports.select("doc_id", "chamber", day.alias("day"), person_words(F.col("name")).alias("words"), F.when((F.col("chamber") == "house") & seat.rlike(pattern), F.regexp_extract(seat, pattern, 1)).alias("seat"), F.when(number == "AL", 0).when(number != "", number.try_cast("int")).alias("district")).where("day IS NOT NULL")
    held = terms.select("member", "chamber", "state", F.col("district").alias("_d"), person_words(F.col("last")).alias("last"), F.array_union(person_words(F.col("first")), person_words(F.col("nickname"))).alias("given"), "start", "end")
    serving = (F.col("day") >= F.col("start")) & (F.col("day") <= F.date_add("end", grace))
    inside = (F.size("last") > 0) & (F.size(F.array_except("last", "words")) == 0)
    one = lambda flag: F.when(F.count_distinct(F.when(flag, F.col("member"))) == 1, F.min(F.when(flag, F.col("member"))))

    house = held.where("chamber = 'house' AND _d IS NOT NULL").drop("chamber")
    seats = asked.where("seat IS NOT NULL").join(house, (F.col("seat") == F.col("state")) & (F.col("district") == F.col("_d"))).where(serving)
    by_seat = seats.groupBy("doc_id").agg(F.coalesce(one(F.lit(True)), one(inside)).alias("seated"))

    told = asked.select("doc_id", "chamber", "day", "words", F.explode("words").alias("word"))
    counts = told.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    spread = held.where(F.size("last") > 0).select("*", F.explode("last").alias("word")).join(counts, "word", "left")
    rare = spread.groupBy("member", "chamber", "start", "end", "last", "given").agg(F.min_by("word", F.struct(F.coalesce("_n", F.lit(0)), "word")).alias("word"))
    near = told.join(rare, ["chamber", "word"]).where(serving & inside)
    given = F.size(F.array_intersect(F.array_except("words", "last"), "given")) > 0
    people = near.groupBy("doc_id", "member").agg(F.max(given).alias("given"))
    by_name = people.groupBy("doc_id").agg(F.coalesce(one(F.lit(True)), one(F.col("given"))).alias("named"))
    out = asked.select("doc_id").join(by_seat, "doc_id", "left").join(by_name, "doc_id", "left")
    return out.select("doc_id", F.coalesce("seated", "named").alias("member"), F.when(F.col("seated").isNotNull(), "district").otherwise("name").alias("method")).where("member IS NOT NULL")


def primary_security(securities: DataFrame, bars: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """IDN-13: per issuer the stock with the highest mean dollar volume of the last days before a date."""
    window = bars.where((F.col("date") <= as_of) & (F.col("date") > F.date_sub(as_of, days)))
    activity = window.groupBy("security_id").agg(F.avg(F.col("close") * F.col("volume")).alias("dollars"))
    rank = F.row_number().over(W.partitionBy("cik").orderBy(F.desc("_r"), "security_id"))
    stocks = securities.where(F.col("security_type").isin("CS", "ADRC") & F.col("mic").isin("XNYS", "XNAS", "XASE"))
    return stocks.join(activity, "security_id").withColumn("_r", F.round("dollars", 2)).withColumn("_n", rank).where("_n = 1").select("cik", "security_id")


def split_weights(codes: DataFrame, *steps: DataFrame) -> DataFrame:
    """IDN-14: weight 1 split equally among a code's targets at each step; a code without targets passes through."""
    out = codes.select("code", F.col("code").alias("target"), F.lit(1.0).alias("weight"))
    for pairs in steps:
        counted = pairs.select(F.col("code").alias("_c"), F.col("target").alias("_t")).distinct().withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("_c")))
        joined = out.join(counted, F.col("target") == F.col("_c"), "left")
        out = joined.groupBy("code", F.coalesce("_t", "target").alias("target")).agg(F.sum(F.col("weight") / F.coalesce("_n", F.lit(1))).alias("weight"))
    return out


def group_fallback(codes: DataFrame, values: DataFrame) -> DataFrame:
    """IDN-15: the value of the code, else the mean of its three-character group, else of its two-character group."""
    out = codes.join(values.select(F.col("code"), F.col("value").alias("v0")), "code", "left")
    for n in (3, 2):
        means = values.groupBy(F.substring("code", 1, n).alias(f"_g{n}")).agg(F.avg("value").alias(f"v{n}"))
        out = out.join(means, F.substring("code", 1, n) == F.col(f"_g{n}"), "left").drop(f"_g{n}")
    return out.select("code", F.coalesce("v0", "v3", "v2").alias("value"), F.when(F.col("v0").isNotNull(), 0).when(F.col("v3").isNotNull(), 3).when(F.col("v2").isNotNull(), 2).alias("level"))


def surrogate_id(source: Column, base: int) -> Column:
    """IDN-19: base plus the digits of the source id (at most nine), else base plus 40 bits of its SHA-256."""
    digits = F.regexp_replace(source, "[^0-9]", "")
    return F.lit(base).cast("long") + F.when(F.length(digits).between(1, 9), digits.cast("long")).otherwise(F.conv(F.substring(F.sha2(source, 256), 1, 10), 16, 10).cast("long"))


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """IDN-20: what became of each listing (ticker, owner): kept, reused, renamed, delisted or added."""
    o, n = old.select("ticker", F.col("owner").alias("_o")), new.select("ticker", F.col("owner").alias("_n"))
    both = o.join(n, "ticker", "full_outer")
    gone = both.where("_n IS NULL").groupBy(F.col("_o").alias("owner")).agg(F.count(F.lit(1)).alias("gone"), F.min("ticker").alias("old_ticker"))
    came = both.where("_o IS NULL").groupBy(F.col("_n").alias("owner")).agg(F.count(F.lit(1)).alias("came"), F.min("ticker").alias("new_ticker"))
    renames = gone.where("gone = 1").join(came.where("came = 1"), "owner").select("old_ticker", "new_ticker")
    left = both.join(renames.select(F.col("old_ticker").alias("ticker"), F.col("new_ticker").alias("_to")), "ticker", "left").join(renames.select(F.col("new_ticker").alias("ticker"), F.col("old_ticker").alias("_from")), "ticker", "left")
    kind = F.when(F.col("_to").isNotNull(), "renamed").when(F.col("_from").isNotNull(), None).when(F.col("_n").isNull(), "delisted").when(F.col("_o").isNull(), "added").when(F.col("_o") == F.col("_n"), "kept").otherwise("reused")
    return left.select("ticker", kind.alias("change"), F.col("_to").alias("new_ticker")).where("change IS NOT NULL")


def search(securities: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """IDN-24: securities whose ticker contains the text, active ones, by ticker."""
    return securities.where(F.lower("ticker").contains(text.lower()) & F.col("active")).orderBy("ticker").limit(limit)


def list_securities(securities: DataFrame, text: str | None = None, kind: str | None = None, active: bool | None = None, limit: int = 50) -> DataFrame:
    """IDN-24: securities whose ticker or name contains the text in any case, of a type, active or not, by ticker."""
    found = securities
    if text:
        found = found.where(F.lower("ticker").contains(text.lower()) | F.lower("name").contains(text.lower()))
    if kind is not None:
        found = found.where(F.col("security_type") == kind.upper())
    if active is not None:
        found = found.where(F.col("active") == active)
    return found.orderBy("ticker").limit(limit)


def with_history(securities: DataFrame, history: DataFrame) -> DataFrame:
    """IDN-24: each security with its symbols in the order first seen; none: an empty array. history: security_id, symbol, first_seen, last_seen."""
    seen = history.join(securities.select("security_id").distinct(), "security_id", "left_semi")
    lists = seen.groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct("first_seen", "symbol", "last_seen"))).alias("symbols"))
    none = F.array().cast("array<struct<first_seen:date,symbol:string,last_seen:date>>")
    return securities.join(lists, "security_id", "left").withColumn("symbols", F.coalesce("symbols", none))


def attach_ids(rows: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """IDN-02: each market row with the holder of its symbol on its date; rows of unknown symbols go. Distinct (symbol, date) pairs are resolved once."""
    known = symbol_as_of(rows.select("symbol", "date").distinct(), history, current).where("security_id IS NOT NULL")
    return rows.join(known, ["symbol", "date"])


def current_else_latest(asked: DataFrame, current: DataFrame, history: DataFrame) -> DataFrame:
    """IDN-03: the security that uses a ticker now, else the one last seen under it."""
    last = history.groupBy("symbol").agg(F.max_by("security_id", F.struct("last_seen", "security_id")).alias("_l"))
    return asked.join(current.select("symbol", F.col("security_id").alias("_c")), "symbol", "left").join(last, "symbol", "left").select("symbol", F.coalesce("_c", "_l").alias("security_id"))


def first_link(rows: DataFrame, securities: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """IDN-04: link rows to securities by several identifiers in order; the first hit wins. steps: (column of rows, column of securities)."""
    out, found = rows, []
    for i, (own, other) in enumerate(steps):
        unique = securities.where(F.col(other).isNotNull()).groupBy(F.col(other).alias(f"_k{i}")).agg(F.min("security_id").alias(f"_s{i}"))
        out = out.join(unique, F.col(own) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_s{i}")
    step = F.coalesce(*(F.when(F.col(c).isNotNull(), i) for i, c in enumerate(found)))
    return out.withColumns({"security_id": F.coalesce(*found), "step": step}).drop(*found)


def unmapped(held: list[DataFrame], mapped: DataFrame, looked_up: DataFrame) -> DataFrame:
    """IDN-05: distinct held identifiers that are neither linked nor looked up."""
    every = held[0].select("cusip")
    for h in held[1:]:
        every = every.unionByName(h.select("cusip"))
    return every.distinct().join(mapped.select("cusip"), "cusip", "left_anti").join(looked_up.select("cusip"), "cusip", "left_anti")


#: Shares of an ordinary that a receipt may stand for (fixed values).
NICE_RATIOS = [0.1, 0.125, 0.2, 0.25, 1 / 3, 0.5, 1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 25, 40, 50, 100]


def inferred_ratios(pairs: DataFrame, closes: DataFrame, as_of: Column, days: int = 180, least: int = 3, within: float = 0.08) -> DataFrame:
    """IDN-11: the median ratio of two listings' closes (same day or the day before), snapped to the nearest plain ratio. pairs: receipt, ordinary."""
    recent = closes.where((F.col("date") <= as_of) & (F.col("date") > F.date_sub(as_of, days)) & (F.col("close") > 0))
    a = recent.select(F.col("security_id").alias("receipt"), "date", F.col("close").alias("x")).join(pairs, "receipt")
    b = recent.select(F.col("security_id").alias("ordinary"), F.explode(F.array(F.struct("date", F.lit(0).alias("late")), F.struct(F.date_add("date", 1).alias("date"), F.lit(1).alias("late")))).alias("d"), F.col("close").alias("y")).select("ordinary", "d.date", "d.late", "y")
    both = a.join(b, ["ordinary", "date"]).groupBy("receipt", "ordinary", "date").agg(F.min_by(F.struct("x", "y"), "late").alias("p"))
    middle = both.groupBy("receipt", "ordinary").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("p.x") / F.col("p.y"), F.lit(0.5)).alias("ratio")).where(F.col("n") >= least)
    nearest = F.array_min(F.array(*(F.struct((F.abs(F.col("ratio") - r) / r).alias("d"), F.lit(float(r)).alias("r")) for r in NICE_RATIOS)))["r"]
    return middle.withColumn("nice", nearest).select("receipt", "ordinary", "n", "ratio", F.when(F.abs(F.col("ratio") / F.col("nice") - 1) <= within, F.col("nice")).alias("nice"))


def prefix_classes(codes: DataFrame, prefixes: DataFrame, curated: DataFrame) -> DataFrame:
    """IDN-16: (group, code, how): a code that begins with a group's prefix is full, one that its prefix begins with (three characters or more) partial; curated pairs win.

    Every prefix of a code is spread out, so both directions are equi-joins.
    """
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    full = codes.select("code", F.explode(heads(F.col("code"))).alias("prefix")).join(prefixes, "prefix").select("group", "code", F.lit(1).alias("r"))
    part = prefixes.select("group", F.explode(heads(F.col("prefix"))).alias("code")).join(codes, "code").where(F.length("code") > 2).select("group", "code", F.lit(0).alias("r"))
    best = full.unionByName(part).unionByName(curated.select("group", "code", F.lit(2).alias("r"))).groupBy("group", "code").agg(F.max("r").alias("r"))
    return best.select("group", "code", F.when(F.col("r") == 2, "curated").when(F.col("r") == 1, "full").otherwise("partial").alias("how"))


def capped_assignment(candidates: DataFrame, groups: list[str], limit: int) -> DataFrame:
    """IDN-18: group by group in order, its named companies and then the largest, up to a limit; each company once.

    candidates: group, company, named, size. The groups are a short list, so
    there is one step for each; a step sees what the ones before have taken.
    """
    taken = None
    for g in groups:
        rows = candidates.where(F.col("group") == g)
        if taken is not None:
            rows = rows.join(taken.select("company"), "company", "left_anti")
        order = W.partitionBy("group").orderBy(F.desc("named"), F.desc_nulls_last("size"), "company")
        chosen = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("group", "company", "rank")
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken


def enriched(first: DataFrame, second: DataFrame) -> DataFrame:
    """IDN-21: the second list fills type and exchange; the first keeps its names. A known id under another symbol is a rename if the second list owns it, else an alias."""
    s = second.select(F.col("symbol").alias("_s"), F.col("figi").alias("_f"), F.col("kind").alias("_k"), F.col("exchange").alias("_x"), F.col("name").alias("_n"))
    by_symbol = first.join(s, F.col("symbol") == F.col("_s"), "full_outer")
    ids = first.select(F.col("figi").alias("_f"), F.col("symbol").alias("_old"), F.col("owned").alias("_owned"))
    rows = by_symbol.join(ids, "_f", "left")
    moved = F.col("symbol").isNull() & F.col("_old").isNotNull()
    what = F.when(moved, F.when(F.col("_owned"), "rename").otherwise("alias")).when(F.col("symbol").isNull(), "new").when(F.col("_s").isNull(), "kept").otherwise("filled")
    return rows.select(F.coalesce("symbol", "_s").alias("symbol"), F.coalesce("name", "_n").alias("name"), F.coalesce("kind", "_k").alias("kind"), F.coalesce("exchange", "_x").alias("exchange"), F.when(moved, F.col("_old")).alias("known_as"), what.alias("what"))


def delisted_moves(rows: DataFrame, gone: DataFrame, current: DataFrame) -> DataFrame:
    """IDN-22: bars of a symbol up to a delisting belong to the delisted entity, unless the symbol's holder is not contradicted.

    gone: symbol, figi, until; current: symbol, security_id, figi. A holder of
    another id is contradicted; then rows up to the day move to a new entity.
    """
    j = gone.join(current, "symbol", "left").select("symbol", "until", "security_id", (gone["figi"] == current["figi"]).alias("_same"))
    verdict = j.select("symbol", "until", "security_id", F.when(F.col("security_id").isNull(), "new").when(F.coalesce("_same", F.lit(True)), "delisted").otherwise("separate").alias("what"))
    moved = rows.join(verdict, "symbol")
    at = F.when((F.col("what") == "delisted") | (F.col("date") > F.col("until")), F.col("security_id").cast("string")).otherwise(F.concat(F.col("symbol"), F.lit("*")))
    return moved.select("symbol", "date", "what", at.alias("entity"))


def without_cross_listings(issuers: DataFrame, same_as: DataFrame) -> DataFrame:
    """IDN-23: issuers that stand for themselves. same_as: cik, home."""
    return issuers.join(same_as.where("home IS NOT NULL").select("cik"), "cik", "left_anti")


def find_names(names: DataFrame, text: str, limit: int) -> DataFrame:
    """IDN-25: rows whose name holds the text in any case, by name."""
    return names.where(F.lower("name").contains(text.lower())).orderBy("name").limit(limit)
