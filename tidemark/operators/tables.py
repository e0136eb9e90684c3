"""Table upkeep (SRC operators): upserts, content keys, amendments, cleaning of reported text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str, update: list[str] | None = None) -> DataFrame:
    """SRC-04: insert rows; on a key that exists replace all other columns, or those of ``update`` (none for []).

    Of several batch rows of one key the last by ``order`` counts.
    """
    last = batch.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    rest = [c for c in target.columns if c not in keys]
    changed = rest if update is None else update
    t = target.select(*keys, F.struct(*rest).alias("_t"))
    b = last.select(*keys, F.struct(*rest).alias("_b"))
    joined = t.join(b, keys, "full_outer")
    value = lambda c: F.when(F.col("_t").isNull(), F.col(f"_b.{c}")).when(F.col("_b").isNull() | F.lit(c not in changed), F.col(f"_t.{c}")).otherwise(F.col(f"_b.{c}"))
    return joined.select(*keys, *(value(c).alias(c) for c in rest))


def replace_from_date(old: DataFrame, new: DataFrame, key: str, date: str) -> DataFrame:
    """SRC-06: new rows replace every old row of their key at or after their first date."""
    first = new.groupBy(key).agg(F.min(date).alias("_first"))
    kept = old.join(first, key, "left").where(F.col("_first").isNull() | (F.col(date) < F.col("_first"))).drop("_first")
    return kept.unionByName(new)


def content_key(rows: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """SRC-07: first 32 hex characters of the SHA-256 of the fields and the occurrence number among equal rows."""
    content = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields))
    n = F.row_number().over(W.partitionBy("_content").orderBy(*order))
    return rows.withColumn("_content", content).withColumn("occurrence", n.cast("long")).withColumn("key", F.substring(F.sha2(F.concat_ws("|", "_content", "occurrence"), 256), 1, 32)).drop("_content")


def plausible(rows: DataFrame) -> DataFrame:
    """SRC-08: trades of 1990 or later, at most 31 days after the filing; a missing filing date is kept."""
    return rows.where((F.col("trans_date") >= "1990-01-01") & (F.col("filing_date").isNull() | (F.col("trans_date") <= F.date_add("filing_date", 31))))


def replay_amendments(reports: DataFrame) -> DataFrame:
    """SRC-10: positions after all reports of a filer-quarter, in (filed, accession) order.

    A replacing report drops what came before; others add to it, the last row of a key wins.
    """
    order = F.struct("filed", "accession")
    last = F.max(F.when(F.col("replaces"), order)).over(W.partitionBy("filer_cik", "period"))
    live = reports.withColumn("_order", order).withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_order") >= F.col("_last")))
    n = F.row_number().over(W.partitionBy("filer_cik", "period", "cusip", "put_call").orderBy(F.desc("_order")))
    return live.withColumn("_n", n).where("_n = 1").drop("_n", "_order", "_last")


def check_digit(cusip: Column) -> Column:
    """SRC-13: whether a nine-character identifier is well formed and its check digit right (every second value doubled, digits summed)."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda i: F.instr(F.lit(alphabet), F.substring(F.upper(cusip), i, 1)) - 1
    total = F.lit(0)
    for i in range(1, 9):
        v = value(i) * (2 if i % 2 == 0 else 1)
        total = total + F.floor(v / 10) + v % 10
    return F.upper(cusip).rlike("^[0-9A-Z]{9}$") & (cusip != "000000000") & (((10 - total % 10) % 10).cast("string") == F.substring(cusip, 9, 1))


def expand_codes(text: Column) -> Column:
    """SRC-15: "1122, 1124-5, 23*" as 1122, 1124, 1125, 23; tokens that do not begin with a digit go, zero padding stays."""
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.regexp_replace(F.trim(t), r"\*$", "")), lambda t: t.rlike(r"^[0-9]"))

    def one(t: Column) -> Column:
        low, tail = F.regexp_extract(t, r"^([0-9]+)\s*-\s*([0-9]+)$", 1), F.regexp_extract(t, r"^([0-9]+)\s*-\s*([0-9]+)$", 2)
        high = F.concat(F.substring(low, F.lit(1), F.greatest(F.length(low) - F.length(tail), F.lit(0))), tail)
        numbers = F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda n: F.lpad(n.cast("string"), F.greatest(F.length(low), F.length(n.cast("string"))), F.lit("0")))  # lpad cuts longer numbers
        return F.when((low != "") & (high.cast("long") >= low.cast("long")), numbers).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one))


def accounting_number(text: Column) -> Column:
    """SRC-17: "$1,234.50", "(12)", "+3%", "--" and "n/a" as numbers or null; parentheses are negative."""
    plain = F.regexp_replace(F.trim(text), r"[$,%+\s()]", "")
    number = plain.try_cast("double")
    return F.when(F.trim(text).rlike(r"^\(.*\)$"), -number).otherwise(number)


def amount_range(text: Column) -> Column:
    """SRC-18: "$1,001 - $15,000" as (1001, 15000); "Over $50,000,000" as (50000001, null)."""
    digits = lambda c: F.regexp_replace(c, ",", "").try_cast("long")
    pair = r"\$([0-9,]+)\s*-\s*\$([0-9,]+)"
    over = digits(F.regexp_extract(text, r"(?i)over\s+\$([0-9,]+)", 1)) + 1
    return F.struct(F.coalesce(digits(F.regexp_extract(text, pair, 1)), over).alias("low"), digits(F.regexp_extract(text, pair, 2)).alias("high"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """SRC-24, DIS-12: the newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def declared_rows(rows: DataFrame, sets: DataFrame, keys: list[str], day: str, order: list[str]) -> DataFrame:
    """EXT-05: the stored rows that a rebuild reads, by the declared kind of their data set.

    sets: provider, dataset, kind, with kind snapshot (the newest row of each key),
    reference (the rows of the newest day as a whole) or log (every row); rows of
    sets that are not declared go. ``order`` breaks ties of a day. Newest rows come
    from partial aggregates, so a key of many rows stays spread over tasks.
    """
    names = ["provider", "dataset"]
    known = rows.join(sets.select(*names, "kind"), names)
    snapshot = known.where("kind = 'snapshot'").groupBy(*names, *keys).agg(F.max_by(F.struct(*rows.columns), F.struct(day, *order)).alias("row")).select("row.*")
    reference = known.where("kind = 'reference'")
    newest = reference.groupBy(*names).agg(F.max(day).alias(day))
    return snapshot.unionByName(reference.join(newest, [*names, day]).select(*rows.columns)).unionByName(known.where("kind = 'log'").select(*rows.columns))


def periods_to_compute(available: DataFrame, derived: DataFrame, newest: int = 2) -> DataFrame:
    """SRC-22: periods not derived yet, and always the newest ones."""
    periods = available.select("period").distinct()
    top = periods.orderBy(F.desc("period")).limit(newest)
    return periods.join(derived.select("period").distinct(), "period", "left_anti").unionByName(top).distinct()


def changed(rows: DataFrame, loaded: DataFrame, key: str, content: list[str]) -> DataFrame:
    """SRC-25: keys whose content hash is not the one loaded last."""
    hashed = rows.select(key, F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in content)), 256).alias("hash"))
    return hashed.join(loaded, [key, "hash"], "left_anti")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """SRC-05: overwrite only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_tsv(spark, path: str, schema: str) -> DataFrame:
    """SRC-02: tab-separated text without quoting; values that do not parse are null."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).option("mode", "PERMISSIVE").csv(path)


def wide(series: DataFrame, keys: list, form: str = "%.6g") -> DataFrame:
    """SRC-03: one row per date, one column per key, values as text (six significant digits unless told)."""
    return series.groupBy("date").pivot("key", keys).agg(F.first(F.when(F.col("value").isNotNull(), F.format_string(form, "value")), ignorenulls=True))


def scan(spark, path: str, keys: list[str], schema: str | None = None, where: Column | None = None) -> DataFrame:
    """SRC-01: a predicate scan of a Parquet table with a natural key; the last row of a repeated key counts."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    rows = rows if where is None else rows.where(where)
    value = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*value)).alias("_v")).select(*keys, "_v.*")


def position_sums(rows: DataFrame, change: str = "2023-01-03") -> DataFrame:
    """SRC-09: rows summed per accession, identifier and kind; values filed before the change are thousands; identifiers have nine characters."""
    value = F.col("value") * F.when(F.col("filed") < F.lit(change).cast("date"), 1000).otherwise(1)
    kept = rows.where(F.length("cusip") == 9)
    return kept.groupBy("accession", "cusip", "put_call").agg(F.sum("shares").alias("shares"), F.sum(value).alias("value"), F.min_by("name", "line").alias("name"))


def filers_of_size(reports: DataFrame, watched: DataFrame, least: float) -> DataFrame:
    """SRC-11: rows of the filers and periods whose replacing report reaches ``least`` in all, or that are watched; amendments follow their original."""
    totals = reports.where("replaces").groupBy("filer_cik", "period").agg(F.sum("value").alias("_t")).where(F.col("_t") >= least).select("filer_cik", "period")
    seen = reports.select("filer_cik", "period").distinct().join(watched, "filer_cik", "left_semi")
    return reports.join(totals.unionByName(seen).distinct(), ["filer_cik", "period"], "left_semi")


def latest_lots(lots: DataFrame) -> DataFrame:
    """SRC-12: per fund and period the lots of the latest filing, summed per identifier."""
    newest = F.max("filed").over(W.partitionBy("fund", "period"))
    return lots.withColumn("_f", newest).where("filed = _f").groupBy("fund", "period", "filed", "identifier").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"))


def first_of(*names: str) -> Column:
    """The first of several candidate columns that is not empty."""
    return F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names))


def groups_long(rows: DataFrame, keys: list[str], groups: dict[str, dict[str, list[str]]]) -> DataFrame:
    """SRC-14: one row per group from wide rows; each field is the first filled one of its candidate columns."""
    cells = [F.struct(F.lit(g).alias("group"), *(first_of(*names).alias(f) for f, names in fields.items())) for g, fields in groups.items()]
    return rows.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")


def use_cells(matrix: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """SRC-16: a use matrix as (commodity, buyer, value) without zero and blank cells, with the kind of both codes."""
    kind = lambda c: F.when(c.rlike("^F"), "final").when(c.rlike("^V"), "value_added").when(c.rlike("^T"), "total").otherwise("commodity")
    long = matrix.unpivot([row], columns, "buyer", "value").where("value IS NOT NULL AND value <> 0")
    return long.select(F.col(row).alias("commodity"), "buyer", "value", kind(F.col(row)).alias("row_kind"), kind(F.col("buyer")).alias("buyer_kind"))


def retention(log: DataFrame, today: Column, keep: int = 3, days: int = 31) -> DataFrame:
    """SRC-19: rows that may go: old errors, and old snapshots beyond the newest ``keep`` of their item; and whether their body is still referenced."""
    order = W.partitionBy("provider", "item", "error").orderBy(F.desc("day"), F.desc("id"))
    ranked = log.withColumn("_n", F.row_number().over(order)).withColumn("_old", F.datediff(today, "day") > days)
    goes = F.col("_old") & (F.col("error") | (F.col("_n") > keep))
    marked = ranked.withColumn("goes", goes)
    kept = marked.where("NOT goes").select("body").distinct().withColumn("_kept", F.lit(True))
    return marked.where("goes").join(kept, "body", "left").select("id", "provider", "item", "day", "error", (F.col("_kept").isNull()).alias("body_goes"))


def freshness(log: DataFrame, expected: DataFrame, today: Column, stragglers: int = 1, share: float = 0.1) -> DataFrame:
    """SRC-20: per provider items, failing items, last success, age and status. expected: provider, days."""
    items = log.groupBy("provider", "item").agg(F.max(F.when(~F.col("error"), F.col("day"))).alias("ok"), F.max(F.when(F.col("error"), F.col("day"))).alias("bad"))
    failing = F.col("bad").isNotNull() & (F.col("ok").isNull() | (F.col("bad") > F.col("ok")))
    out = items.groupBy("provider").agg(F.count(F.lit(1)).alias("items"), F.sum(failing.cast("long")).alias("failing"), F.max("ok").alias("last_success"))
    out = out.join(expected, "provider", "full_outer").withColumns({"items": F.coalesce("items", F.lit(0)), "failing": F.coalesce("failing", F.lit(0)), "age": F.datediff(today, "last_success")})
    status = F.when(F.col("failing") > F.greatest(F.lit(float(stragglers)), share * F.col("items")), "failing").when(F.col("days").isNull(), "unmonitored").when(F.col("age").isNull() | (F.col("age") >= F.col("days")), "stale").otherwise("ok")
    return out.select("provider", "items", "failing", "last_success", "age", status.alias("status"))


def stale_entities(entities: DataFrame, periods: DataFrame, filings: DataFrame, today: Column) -> DataFrame:
    """SRC-21: entities whose newest period end is missing or over 200 days old (430 without a quarterly report in the last 730 days)."""
    newest = periods.groupBy("cik").agg(F.max("period_end").alias("newest"))
    quarterly = filings.where((F.col("form") == "10-Q") & (F.datediff(today, "filed").between(0, 730))).select("cik", F.lit(True).alias("_q")).distinct()
    rows = entities.join(newest, "cik", "left").join(quarterly, "cik", "left")
    limit = F.when(F.col("_q"), 200).otherwise(430)
    return rows.where(F.col("newest").isNull() | (F.datediff(today, "newest") > limit)).select("cik", "newest")


def final_over_candidates(final: DataFrame, candidates: DataFrame, year: Column) -> DataFrame:
    """SRC-23: the final events, and candidates of later years alone."""
    last = final.agg(F.max(year).alias("_y"))  # one row
    later = candidates.crossJoin(last).where(F.col("_y").isNull() | (year > F.col("_y"))).drop("_y")
    return final.withColumn("kind", F.lit("final")).unionByName(later.withColumn("kind", F.lit("candidate")))


def members(filings: DataFrame, since: Column, forms: list[str]) -> DataFrame:
    """SRC-26: entities with a periodic form since a day, amendments folded; named by their latest filing."""
    form = F.regexp_replace("form", "/A$", "")
    return filings.where((F.col("filed") >= since) & form.isin(forms)).groupBy("cik").agg(F.max_by("accession", F.struct("filed", "accession")).alias("latest"), F.count(F.lit(1)).alias("filings"))


def ranked_union(files: list[DataFrame], keys: list[str], missing: float = -99.99) -> DataFrame:
    """SRC-27: each key's value from the first file that has it; the missing mark is no value."""
    rows = [f.where((F.col("value") != missing) & F.col("value").isNotNull()).select(*keys, "value", F.lit(i).alias("file")) for i, f in enumerate(files)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(*keys).agg(F.min(F.struct("file", "value")).alias("_v")).select(*keys, "_v.value", "_v.file")


def thin_partitions(filings: DataFrame, facts: DataFrame, read: DataFrame, today: Column, least: int = 50, days: int = 730) -> DataFrame:
    """SRC-28: recent periodic filings with fewer than ``least`` facts (none counts as 0) that were not read again."""
    counted = facts.groupBy("accession").agg(F.count(F.lit(1)).alias("n"))
    recent = filings.where(F.datediff(today, "filed").between(0, days))
    return recent.join(counted, "accession", "left").withColumn("facts", F.coalesce("n", F.lit(0))).where(F.col("facts") < least).join(read, "accession", "left_anti").select("accession", "facts")


def without_orphans(rows: DataFrame, config: DataFrame, key: str, content: str) -> DataFrame:
    """SRC-29: rows whose key is configured and whose content is still the configured one."""
    return rows.join(config, [key, content], "left_semi")
