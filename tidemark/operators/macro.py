"""Macro and gauges (MAC operators), country panels partitioned by key, and the timeline (TML)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import disclosures, indicators, series


def credit_impulse(quarters: DataFrame) -> DataFrame:
    """MAC-01: change of credit growth over four quarters as % of output. quarters: key, date, level, ratio (level as % of output)."""
    by = W.partitionBy("key").orderBy("date")
    both = quarters.where("level IS NOT NULL AND ratio IS NOT NULL AND ratio <> 0")
    l4, l8 = F.lag("level", 4).over(by), F.lag("level", 8).over(by)
    near = F.datediff("date", F.lag("date", 8).over(by)) <= 750
    impulse = ((F.col("level") - l4) - (l4 - l8)) / (F.col("level") / (F.col("ratio") / 100)) * 100
    return both.select("key", "date", F.when(near, impulse).alias("impulse"))


def episodes(rows: DataFrame, condition: Column) -> DataFrame:
    """MAC-09: the first row of each run where the condition holds, per key."""
    by = W.partitionBy("key").orderBy("date")
    now = F.coalesce(condition, F.lit(False))
    return rows.withColumn("_c", now).withColumn("_b", F.lag("_c", 1, False).over(by)).where("_c AND NOT _b").drop("_c", "_b")


def condition_rates(rows: DataFrame, condition: Column, outcome: str) -> DataFrame:
    """MAC-08: per key the outcome's rate inside a condition, its base rate and their ratio."""
    o = F.col(outcome).cast("double")
    out = rows.where(F.col(outcome).isNotNull()).groupBy("key").agg(F.avg(F.when(condition, o)).alias("inside"), F.avg(o).alias("base"), F.count(F.when(condition, 1)).alias("n"))
    return out.withColumn("ratio", F.try_divide("inside", "base"))


def event_within(rows: DataFrame, event: str, months: int) -> DataFrame:
    """MAC-05: whether the event begins within (date, date + months]; null if the key's rows end before. One row per key and month."""
    by = W.partitionBy("key").orderBy("date")
    starts = rows.withColumn("_s", (F.col(event) & ~F.coalesce(F.lag(event).over(by), F.col(event))).cast("int"))
    ahead = W.partitionBy("key").orderBy("date").rowsBetween(1, months)
    hit = F.max("_s").over(ahead)
    return starts.withColumn("within", F.when(hit == 1, True).when(F.count("_s").over(ahead) == months, False)).drop("_s")


def pivot_panel(rows: DataFrame, variables: list[str]) -> DataFrame:
    """MAC-10: long (key, variable, year, value) rows to one row per key and year."""
    return rows.groupBy("key", "year").pivot("variable", variables).agg(F.first("value"))


TIMELINE = ["date", "kind", "title", "entity", "amount", "ref"]


def timeline(sources: list[DataFrame], start, end, per_source: int, parts: int = 64) -> DataFrame:
    """TML-01: events of all sources in a window, the newest ``per_source`` of each, newest first, ties by kind downwards.

    The newest of each of ``parts`` parts of a kind come first, so the task that
    orders a kind gets parts times per_source rows, however many there are.
    """
    every = reduce(DataFrame.unionByName, [s.select(*TIMELINE) for s in sources]).where((F.col("date") >= start) & (F.col("date") <= end))
    n = lambda *keys: F.row_number().over(W.partitionBy("kind", *keys).orderBy(F.desc("date"), "ref", "title"))
    some = every.withColumn("_p", F.pmod(F.xxhash64("ref", "date"), F.lit(parts))).withColumn("_n", n("_p")).where(F.col("_n") <= per_source).drop("_p")
    return some.withColumn("_n", n()).where(F.col("_n") <= per_source).drop("_n").orderBy(F.desc("date"), F.desc("kind"), "ref")


def _fields(rows: DataFrame, key: list[str], fields: dict[str, Column]) -> DataFrame:
    """One row per field: key parts and field name joined by ':'."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.cast("double").alias("value")) for n, c in fields.items()))).alias("x")
    out = rows.select("*", cells).where("x.value IS NOT NULL")
    return out.select("*", F.concat_ws(":", *(F.col(k).cast("string") for k in key), F.col("x.field")).alias("series_key"), F.col("x.value").alias("series_value"))


def cot_series(positions: DataFrame) -> DataFrame:
    """TSR-11: the fields of a market and trader group, known three days after the report."""
    net = F.col("long_side") - F.col("short_side")
    frame = W.partitionBy("market", "trader").orderBy("report_date").rowsBetween(-155, 0)
    low, high = F.min("_net").over(frame), F.max("_net").over(frame)
    index = F.when(F.count("_net").over(frame) >= 52, F.when(low == high, 50.0).otherwise(100 * (F.col("_net") - low) / (high - low)))
    rows = positions.withColumn("_net", net).withColumn("_index", index)
    share = F.when(F.col("open_interest") != 0, 100 * net / F.col("open_interest"))
    out = _fields(rows, ["market", "trader"], {"net": net, "long": F.col("long_side"), "short": F.col("short_side"), "oi": F.col("open_interest"), "net_pct_oi": share, "index": F.col("_index")})
    return series.lagged(out, F.col("series_key"), F.col("report_date"), F.col("series_value"), F.date_add("report_date", 3))


def short_interest_series(rows: DataFrame) -> DataFrame:
    """TSR-12: position and days to cover, known eight weekdays after the settlement."""
    cover = F.when(F.col("daily_volume") != 0, F.col("position") / F.col("daily_volume"))
    out = _fields(rows, ["security_id"], {"position": F.col("position"), "days_to_cover": cover})
    return series.lagged(out, F.col("series_key"), F.col("settlement_date"), F.col("series_value"), series.weekdays_after(F.col("settlement_date"), 8))


def policy_series(obligations: DataFrame, reports: DataFrame, bills: DataFrame) -> DataFrame:
    """TSR-13: obligations by code prefix, lobbying reports by client, bills by area, each with its own lag."""
    gov = disclosures.obligations_by_prefix(obligations, 3)
    gov = series.lagged(gov, F.concat(F.lit("gov:"), "prefix"), F.col("month"), F.col("amount"), F.date_add(F.last_day("month"), 90))
    quarter = F.make_date("year", F.col("quarter") * 3, F.lit(1))
    lobby = disclosures.current_reports(reports).groupBy("client", quarter.alias("date")).agg(F.count(F.lit(1)).alias("n"))
    lobby = series.lagged(lobby, F.concat(F.lit("lobby:"), F.col("client").cast("string"), F.lit(":count")), F.col("date"), F.col("n"), F.date_add(F.last_day("date"), 45))
    months = disclosures.bills_per_month(bills)
    law = series.lagged(months, F.concat_ws(":", F.lit("bills"), "area", "step"), F.col("month"), F.col("n"), F.add_months("month", 1))
    return gov.unionByName(lobby).unionByName(law)


def news_series(rows: DataFrame) -> DataFrame:
    """TSR-14: articles per million of the day's total, and their count, known the day after."""
    out = _fields(rows, ["topic"], {"share": F.when(F.col("total") != 0, F.col("articles") * 1e6 / F.col("total")), "count": F.col("articles")})
    return series.lagged(out, F.col("series_key"), F.col("date"), F.col("series_value"), F.date_add("date", 1))


def aliased_series(observations: DataFrame, aliases: dict[str, tuple[str, int]]) -> DataFrame:
    """TSR-18: observations under their alias, known the alias's number of days later."""
    table = observations.sparkSession.createDataFrame([(a, i, n) for a, (i, n) in aliases.items()], "alias string, series_id string, lag int")  # one row an alias
    rows = observations.join(table, "series_id")
    return series.lagged(rows, F.col("alias"), F.col("date"), F.col("value"), F.date_add("date", F.col("lag")))


def yearly_impulse(levels: DataFrame) -> DataFrame:
    """MAC-02: second difference of the level over two years as percent of the year's output. levels: key, year, level, output."""
    before = lambda n: levels.select("key", (F.col("year") + n).alias("year"), F.col("level").alias(f"l{n}"))
    rows = levels.join(before(1), ["key", "year"]).join(before(2), ["key", "year"])
    return rows.select("key", "year", F.when(F.col("output") != 0, ((F.col("level") - F.col("l1")) - (F.col("l1") - F.col("l2"))) / F.col("output") * 100).alias("impulse"))


def gauge(readings: DataFrame, back: int = 21, relative: list[str] = (), n: int = 756, least: int = 252) -> DataFrame:
    """MAC-03: each reading's value, its change over ``back`` rows (relative for the named ones) and its rank in the window. readings: key, date, value."""
    by = W.partitionBy("key").orderBy("date")
    before = F.lag("value", back).over(by)
    change = F.when(F.col("key").isin(list(relative)), F.when(before != 0, F.col("value") / before - 1)).otherwise(F.col("value") - before)
    return readings.withColumns({"change": change, "rank": indicators.trailing_rank(n, least)})


def gauge_flags(gauges: DataFrame, meetings: DataFrame, fall: float = -0.05, top: float = 0.9, days: int = 7) -> DataFrame:
    """MAC-04: names of the rules that hold on a row: a fall, a rank at the top, and a meeting within ``days``. meetings: date.

    The next meeting comes from one window over rows and meetings together.
    """
    rows = gauges.select("key", "date", "change", "rank", F.lit(None).cast("date").alias("meets"))
    keys = gauges.select("key").distinct().crossJoin(meetings.select("date"))
    both = rows.withColumn("asked", F.lit(1)).unionByName(keys.select("key", "date", F.lit(None).cast("double").alias("change"), F.lit(None).cast("double").alias("rank"), F.col("date").alias("meets"), F.lit(0).alias("asked")))
    ahead = F.first("meets", ignorenulls=True).over(W.partitionBy("key").orderBy("date", F.desc("asked")).rowsBetween(0, W.unboundedFollowing))
    told = both.withColumn("next_meeting", ahead).where("asked = 1")
    flag = lambda c, name: F.when(c, F.lit(name))
    flags = F.array_compact(F.array(flag(F.col("change") <= fall, "fall"), flag(F.col("rank") >= top, "top"), flag(F.datediff("next_meeting", "date") <= days, "meeting")))
    return told.select("key", "date", "next_meeting", F.array_join(flags, ",").alias("flags"))


def drawdown_outcome(index: DataFrame, ahead: int, threshold: float = 0.3, least: int = 2) -> DataFrame:
    """MAC-06: whether the index falls by ``threshold`` or more below its level within the next rows; null if they are not covered. index: key, date, value."""
    frame = W.partitionBy("key").orderBy("date").rowsBetween(1, ahead)
    low, n = F.min("value").over(frame), F.count("value").over(frame)
    covered = F.lead("date", ahead).over(W.partitionBy("key").orderBy("date")).isNotNull()
    hit = low <= F.col("value") * (1 - threshold)
    return index.select("key", "date", F.when(F.col("value").isNotNull() & (n >= least), F.when(hit, True).when(covered, False)).alias("fell"))


def country_panel(rows: DataFrame, ahead: int, threshold: float, least: int) -> DataFrame:
    """MAC-07: per country and date the debt's rank so far, the credit impulse and whether the level falls within the next rows. rows: key, date, level, ratio."""
    ranked = indicators.expanding_rank(rows, least, "ratio")
    impulse = credit_impulse(rows)
    fell = drawdown_outcome(rows.select("key", "date", F.col("level").alias("value")), ahead, threshold, least=1)
    return ranked.join(impulse, ["key", "date"], "left").join(fell, ["key", "date"], "left")


def _event(date, kind, title, entity, amount, ref) -> list[Column]:
    return [c.alias(n) for c, n in zip((date, kind, title, entity, amount, ref), TIMELINE, strict=True)]


def company_events(trades: DataFrame, congress: DataFrame, filings: DataFrame, least: float) -> DataFrame:
    """TML-02: insider trades of at least an amount, congress trades, event filings and reports in the timeline's columns."""
    c, text = F.col, lambda n: F.col(n).cast("string")
    insiders = trades.where(c("shares") * c("price") >= least).select(*_event(c("filing_date"), F.lit("insider"), F.concat_ws(" ", "trans_code", c("shares").cast("long").cast("string")), c("issuer_cik"), F.round(c("shares") * c("price"), 2), text("id")))
    members = congress.select(*_event(c("filed"), F.lit("congress"), c("trans_type"), c("ticker"), c("amount_min").cast("double"), text("id")))
    kind = F.when(c("form").startswith("8-K"), "event").otherwise("report")
    title = F.concat(c("form"), F.when(c("items") != "", F.concat(F.lit(" "), c("items"))).otherwise(""))
    papers = filings.select(*_event(c("filed"), kind, title, c("cik"), F.lit(None).cast("double"), text("accession")))
    return insiders.unionByName(members).unionByName(papers)


def policy_events(bills: DataFrame, reports: DataFrame, obligations: DataFrame) -> DataFrame:
    """TML-03: bills, current lobbying reports and contracts with their yearly change in the timeline's columns."""
    c, text, none = F.col, lambda n: F.col(n).cast("string"), F.lit(None).cast("double")
    step = lambda name: bills.where(c(name).isNotNull()).select(*_event(c(name), F.lit("bill"), F.concat(F.lit(f"{name}: "), "area"), c("subject"), none, text("id")))
    lobby = disclosures.current_reports(reports).select(*_event(c("posted"), F.lit("lobbying"), F.concat(F.lit("registrant "), text("registrant")), c("client"), F.round("amount", 2), text("id")))
    months = disclosures.obligations_by_prefix(obligations, 3)
    before = months.select("prefix", F.add_months("month", 12).alias("month"), c("amount").alias("_b"))
    spent = months.join(before, ["prefix", "month"]).select(*_event(F.date_add(F.last_day("month"), 90), F.lit("contracts"), F.concat(F.lit("code "), "prefix"), c("prefix").cast("long"), F.round(c("amount") - c("_b"), 2), F.concat_ws(":", "prefix", text("month"))))
    return step("introduced").unionByName(step("enacted")).unionByName(lobby).unionByName(spent)


def dossier(entities: DataFrame, key: str, sections: dict[str, DataFrame]) -> DataFrame:
    """TML-04, TML-05: one row per entity with the columns of every section; an entity that a section lacks has nulls there."""
    out = entities
    for rows in sections.values():
        out = out.join(rows, key, "left")
    return out


def now_and_ago(rows: DataFrame, key: str, as_of: Column, days: int) -> DataFrame:
    """TML-05: a series' latest value by a day and that of ``days`` before."""
    known = rows.where(F.col("value").isNotNull() & (F.col("date") <= as_of))
    early = F.col("date") <= F.date_sub(as_of, days)
    return known.groupBy(key).agg(F.max_by("value", "date").alias("now"), F.max_by(F.when(early, F.col("value")), F.when(early, F.col("date"))).alias("ago"))


EventSource = Callable[[dict[str, DataFrame]], DataFrame]


def registered_events(sources: Mapping[str, EventSource], tables: dict[str, DataFrame], kinds: list[str], start: Column, end: Column) -> DataFrame:
    """EXT-02: events of the named kinds in a window. A source makes the timeline's columns from a dict of tables; the caller holds the mapping of sources."""
    return reduce(DataFrame.unionByName, [sources[k](tables).select(*TIMELINE) for k in kinds]).where(F.col("date").between(start, end))
