"""Event sources of the timeline (TML-01) beside those of ``macro``: short interest, institutional holders, presidential documents and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _event(date: Column, kind: str, title: Column, entity: Column, ref: Column) -> list[Column]:
    return [date.alias("date"), F.lit(kind).alias("kind"), title.alias("title"), entity.cast("long").alias("entity"), F.lit(None).cast("double").alias("amount"), ref.alias("ref")]


def _percent(change: Column) -> Column:
    """A change as a signed whole percentage."""
    whole = F.round(change * 100).cast("long")
    return F.concat(F.when(whole >= 0, "+").otherwise(""), whole.cast("string"), F.lit("%"))


def short_interest_events(positions: DataFrame, securities: DataFrame, public: Column, least: float = 0.25) -> DataFrame:
    """TML-01: changes of short interest of ``least`` or more between settlements, on the day they are published.

    positions: security_id, settlement_date, position; securities: security_id,
    cik. ``public`` is a column of positions. A change from none or from an
    unknown position is no event.
    """
    by = W.partitionBy("security_id").orderBy("settlement_date")
    rows = positions.withColumn("_b", F.lag("position").over(by)).withColumn("_d", public)
    rows = rows.withColumn("_c", F.when(F.col("_b") != 0, F.col("position") / F.col("_b") - 1)).where(F.abs("_c") >= least)
    title = F.concat(F.lit("Short interest "), _percent(F.col("_c")), F.lit(" to "), F.col("position").cast("string"), F.lit(" shares"))
    ref = F.concat_ws(":", F.lit("short_interest"), F.col("security_id").cast("string"), F.col("settlement_date").cast("string"))
    return rows.join(securities.select("security_id", "cik"), "security_id").select(*_event(F.col("_d"), "short_interest", title, F.col("cik"), ref))


def holder_events(positions: DataFrame, cusips: DataFrame, days: int = 45) -> DataFrame:
    """TML-01: each quarter's institutional holders of a company against its quarter before, on the filing deadline.

    positions: filer_cik, period, filed, cusip, put_call, shares; cusips: cusip,
    cik. Options and reports filed after the deadline are left out. Holders are
    counted after one row a filer, so a stock that everybody holds is summed in
    parts.
    """
    held = positions.where((F.col("put_call") == "") & (F.col("filed") <= F.date_add("period", days))).join(cusips, "cusip")
    filers = held.groupBy("cik", "period", "filer_cik").agg(F.sum("shares").alias("s"))
    quarters = filers.groupBy("cik", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
    by = W.partitionBy("cik").orderBy("period")
    rows = quarters.withColumns({"_n": F.lag("n").over(by), "_s": F.lag("s").over(by)})
    more = F.col("n") - F.col("_n")
    change = F.when(more.isNotNull(), F.concat(F.lit(" ("), F.when(more >= 0, "+").otherwise(""), more.cast("string"), F.lit(")")))
    shares = F.when(F.col("_s") != 0, F.concat(F.lit(", shares held "), _percent(F.col("s") / F.col("_s") - 1)))
    title = F.concat(F.lit("13F: "), F.col("n").cast("string"), F.lit(" holders"), F.coalesce(change, F.lit("")), F.coalesce(shares, F.lit("")))
    ref = F.concat_ws(":", F.lit("institutional_positions"), F.col("cik").cast("string"), F.col("period").cast("string"))
    return rows.select(*_event(F.date_add("period", days), "13f", title, F.col("cik"), ref))


def presidential_events(documents: DataFrame, titled: Column | None = None, found: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """TML-01: presidential documents on the day they were signed; undated ones are left out.

    documents: number, signed, type, title. For a theme, ``titled`` is a test of
    the title and ``found`` the matches of a text search (number, score), of
    which scores of ``least`` and more count; either test lets a document in.
    """
    rows = documents.where("signed IS NOT NULL")
    if titled is not None or found is not None:
        hit = F.lit(False) if titled is None else F.coalesce(titled, F.lit(False))
        if found is not None:
            rows = rows.join(found.where(F.col("score") >= least).select("number", F.lit(True).alias("_f")), "number", "left")
            hit = hit | F.coalesce("_f", F.lit(False))
        rows = rows.where(hit)
    title = F.substring(F.concat_ws(": ", F.regexp_replace("type", "_", " "), F.coalesce("title", F.lit(""))), 1, 300)
    return rows.select(*_event(F.col("signed"), "presidential", title, F.lit(None), F.concat(F.lit("presidential_documents:"), F.col("number").cast("string"))))


def release_events(dates: DataFrame, series: DataFrame, wanted: list[str] | None = None, shown: int = 6) -> DataFrame:
    """TML-01: economic releases on their day with the first ``shown`` of the series they update; releases of daily series are no events.

    dates: release, date; series: release, series_id, daily. ``wanted`` names a
    theme's series: only releases that update one, and only those are shown.
    """
    of = series.groupBy("release").agg(F.max(F.coalesce("daily", F.lit(False))).alias("_d"), F.array_sort(F.collect_set("series_id")).alias("_s"))  # the catalogue: some hundred series a release at most
    if wanted is not None:
        of = of.withColumn("_s", F.array_intersect("_s", F.array(*map(F.lit, wanted)).cast("array<string>")))
    rows = dates.select("release", "date").distinct().join(of, "release", "left").where(~F.coalesce("_d", F.lit(False)))
    if wanted is not None:
        rows = rows.where(F.size("_s") > 0)
    names = F.array_join(F.slice("_s", 1, shown), ", ")
    title = F.concat(F.col("release").cast("string"), F.when(F.size("_s") > 0, F.concat(F.lit(" ("), names, F.lit(")"))).otherwise(""))
    return rows.select(*_event(F.col("date"), "release", title, F.lit(None), F.concat(F.lit("economic_releases:"), F.col("release").cast("string"))))
