"""Disclosures (DIS operators): insiders, managers and event studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cluster_buys(trades: DataFrame, as_of, days: int = 30, least: int = 3) -> DataFrame:
    """DIS-01: issuers with purchases by ``least`` insiders or more in (as_of - days, as_of], planned trades left out."""
    window = trades.where((F.col("trans_code") == "P") & ~F.col("plan_10b5_1") & (F.col("trans_date") <= as_of) & (F.col("trans_date") > F.date_sub(as_of, days)))
    out = window.groupBy("issuer_cik").agg(
        F.count_distinct("owner_cik").alias("insiders"), F.count(F.lit(1)).alias("purchases"), F.sum("shares").alias("shares"), F.sum(F.col("shares") * F.col("price")).alias("value"), F.min("trans_date").alias("first"), F.max("trans_date").alias("last")
    )
    return out.where(F.col("insiders") >= least)


def cluster_events(trades: DataFrame, days: int = 30, least: int = 3) -> DataFrame:
    """DIS-02: per issuer the filings at which ``least`` insiders have bought within ``days``; none until ``days`` after the last event.

    The count of distinct buyers is a window over time; the rest period is a
    fold over an issuer's sorted candidates.
    """
    buys = trades.where((F.col("trans_code") == "P") & ~F.col("plan_10b5_1"))
    day = F.datediff("trans_date", F.lit("1970-01-01").cast("date"))
    pairs = buys.select("issuer_cik", "owner_cik", "filing_date", "trans_date", day.alias("_d"))
    recent = F.size(F.collect_set("owner_cik").over(W.partitionBy("issuer_cik").orderBy("_d").rangeBetween(-days, 0)))
    hits = pairs.withColumn("_n", recent).where(F.col("_n") >= least).groupBy("issuer_cik").agg(F.array_sort(F.collect_set("filing_date")).alias("_f"))
    start = F.array().cast("array<date>")

    def step(kept, d):
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (d >= F.date_add(last, days)), F.array_append(kept, d)).otherwise(kept)

    events = hits.select("issuer_cik", F.when(F.size("_f") > 0, F.aggregate("_f", start, lambda k, d: F.when(F.size(k) == 0, F.array(d)).otherwise(step(k, d)))).alias("_e"))
    return events.select("issuer_cik", F.explode("_e").alias("event_date"))


def with_previous(positions: DataFrame) -> DataFrame:
    """Each filer's reported periods with the one reported before."""
    periods = positions.select("filer_cik", "period").distinct()
    return periods.withColumn("previous", F.lag("period").over(W.partitionBy("filer_cik").orderBy("period")))


def manager_changes(positions: DataFrame) -> DataFrame:
    """DIS-07, DIS-04: each position against the period reported before: new, added, reduced, sold or unchanged."""
    keys = ["filer_cik", "cusip", "put_call"]
    periods = with_previous(positions).where("previous IS NOT NULL")
    now = positions.join(periods, ["filer_cik", "period"]).select(*keys, "period", "shares", "value")
    before = positions.select(*keys, F.col("period").alias("previous"), F.col("shares").alias("shares_before")).join(periods, ["filer_cik", "previous"]).select(*keys, "period", "shares_before")
    out = now.join(before, [*keys, "period"], "full_outer")
    s, b = F.col("shares"), F.col("shares_before")
    return out.withColumn("change", F.when(b.isNull(), "new").when(s.isNull(), "sold").when(s > b, "added").when(s < b, "reduced").otherwise("unchanged"))


def manager_quarters(positions: DataFrame) -> DataFrame:
    """DIS-08: positions, value and turnover (share of the previous period's positions that are gone) per filer-period."""
    changes = manager_changes(positions)
    gone = changes.groupBy("filer_cik", "period").agg(F.sum((F.col("change") == "sold").cast("long")).alias("gone"), F.count("shares_before").alias("previous_positions"))
    held = positions.groupBy("filer_cik", "period").agg(F.count(F.lit(1)).alias("positions"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return held.join(gone, ["filer_cik", "period"], "left").select("filer_cik", "period", "positions", "value", "previous_positions", F.try_divide("gone", "previous_positions").alias("turnover"))


def best_ideas(positions: DataFrame, top: int = 10, factor: float = 1.5) -> DataFrame:
    """DIS-09: of a filer's ten largest holdings those that are new or grew by half or more."""
    plain = positions.where("put_call = ''")
    rank = F.rank().over(W.partitionBy("filer_cik", "period").orderBy(F.desc("value"), "cusip"))
    periods = with_previous(plain)
    ranked = plain.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(periods, ["filer_cik", "period"])
    before = plain.select("filer_cik", F.col("period").alias("previous"), "cusip", F.col("shares").alias("_b"))
    joined = ranked.join(before, ["filer_cik", "previous", "cusip"], "left")
    return joined.where(F.col("_b").isNull() | (F.col("shares") >= factor * F.col("_b"))).select("filer_cik", "period", "cusip", "rank")


def event_study(events: DataFrame, closes: DataFrame, horizons: list[int], benchmark: int = 0, within: int = 10) -> DataFrame:
    """DIS-06: excess return over the benchmark after the first trading day within ten days of each event, per horizon."""
    bars = closes.select("security_id", "date", "close", F.row_number().over(W.partitionBy("security_id").orderBy("date")).alias("_i"))
    ahead = [F.struct(F.lit(h).alias("h"), F.lead(F.struct("date", "close"), h).over(W.partitionBy("security_id").orderBy("date")).alias("to")) for h in horizons]
    bars = bars.withColumn("_to", F.array(*ahead))
    # events and bars in one window: an event's entry is the first bar of a later day
    both = bars.select("security_id", "date", F.lit(0).alias("k"), F.struct("date", "close", "_to").alias("bar")).unionByName(events.select("security_id", F.col("event_date").alias("date"), F.lit(1).alias("k")), allowMissingColumns=True)
    entry = both.withColumn("bar", F.first("bar", ignorenulls=True).over(W.partitionBy("security_id").orderBy("date", "k").rowsBetween(1, W.unboundedFollowing))).where("k = 1")
    at = entry.where(F.col("bar.date") <= F.date_add("date", within)).select("security_id", F.col("bar.date").alias("d0"), F.col("bar.close").alias("c0"), F.explode("bar._to").alias("x"))
    moved = at.where("x.to IS NOT NULL").select("d0", "c0", "x.h", F.col("x.to.date").alias("d1"), F.col("x.to.close").alias("c1"))
    bench = closes.where(F.col("security_id") == benchmark).select("date", F.col("close").alias("b"))
    both = moved.join(bench.select(F.col("date").alias("d0"), F.col("b").alias("b0")), "d0").join(bench.select(F.col("date").alias("d1"), F.col("b").alias("b1")), "d1")
    excess = both.withColumn("x", F.col("c1") / F.col("c0") - F.col("b1") / F.col("b0"))
    out = excess.groupBy("h").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.avg((F.col("x") > 0).cast("double")).alias("hit_rate"), F.stddev_samp("x").alias("_s"))
    return out.select("h", "n", "mean", "median", "hit_rate", F.when(F.col("_s") > 0, F.col("mean") / F.col("_s") * F.sqrt("n")).alias("t"))


def calendar_study(events: DataFrame, closes: DataFrame, horizons: list[int], benchmark: int = 0, within: int = 10) -> DataFrame:
    """DIS-06 on the benchmark's calendar: entry on its first day after the event (at most ``within`` days later), exits so many of its days on.

    An event counts at a horizon only where the security has a close on both days;
    every lookup is an equal join on the security and a day. Means of excess and plain returns per horizon.
    """
    days = W.orderBy("date")  # one row a trading day: thousands
    bench = closes.where(F.col("security_id") == benchmark).groupBy("date").agg(F.max("close").alias("b"))
    calendar = bench.select("date", "b", F.row_number().over(days).alias("i"), F.lag("date").over(days).alias("before"))
    first = F.greatest(F.col("before"), F.date_sub("date", within))  # skips the null before the first day
    entries = calendar.select(F.explode(F.sequence(first, F.date_sub("date", 1))).alias("event_date"), F.col("date").alias("d0"), F.col("b").alias("b0"), "i")
    own = closes.where("close IS NOT NULL").select("security_id", "date", "close")
    held = events.join(entries, "event_date").join(own.select("security_id", F.col("date").alias("d0"), F.col("close").alias("c0")), ["security_id", "d0"])
    ahead = held.select("security_id", "c0", "b0", "i", F.explode(F.array(*map(F.lit, horizons))).alias("h")).withColumn("i", F.col("i") + F.col("h"))
    exits = ahead.join(calendar.select("i", F.col("date").alias("d1"), F.col("b").alias("b1")), "i").join(own.select("security_id", F.col("date").alias("d1"), F.col("close").alias("c1")), ["security_id", "d1"])
    moved = exits.select("h", (F.col("c1") / F.col("c0") - 1).alias("r"), (F.col("c1") / F.col("c0") - F.col("b1") / F.col("b0")).alias("x"))
    out = moved.groupBy("h").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.avg((F.col("x") > 0).cast("double")).alias("hit_rate"), F.stddev_samp("x").alias("_s"), F.avg("r").alias("mean_return"))
    return out.withColumn("t", F.when(F.col("_s") > 0, F.col("mean") / F.col("_s") * F.sqrt("n"))).drop("_s")


def unpriced(events: DataFrame, closes: DataFrame) -> DataFrame:
    """DIS-06: securities of events without any bar, with the number of their events."""
    return events.join(closes.select("security_id").distinct(), "security_id", "left_anti").groupBy("security_id").agg(F.count(F.lit(1)).alias("events"))


def classify_buys(trades: DataFrame) -> DataFrame:
    """STS-19: purchases as routine (same month in each of three years before), new (none in 3 x 365 days) or opportunistic."""
    buys = trades.where("trans_code = 'P'").select("id", "issuer_cik", "owner_cik", "trans_date")
    months = buys.groupBy("issuer_cik", "owner_cik", F.month("trans_date").alias("m")).agg(F.collect_set(F.year("trans_date")).alias("years"))
    day = F.datediff("trans_date", F.lit("1970-01-01").cast("date"))
    prior = F.count(F.lit(1)).over(W.partitionBy("issuer_cik", "owner_cik").orderBy("_d").rangeBetween(-3 * 365, -1))
    rows = buys.withColumn("_d", day).withColumn("_p", prior).withColumn("m", F.month("trans_date")).join(months, ["issuer_cik", "owner_cik", "m"])
    year = F.year("trans_date")
    routine = F.array_contains("years", year - 1) & F.array_contains("years", year - 2) & F.array_contains("years", year - 3)
    return rows.select("id", F.when(routine, "routine").when(F.col("_p") == 0, "new").otherwise("opportunistic").alias("kind"))


def current_reports(reports: DataFrame) -> DataFrame:
    """DIS-12: the report posted last of each registrant, client and quarter; ties by id."""
    order = W.partitionBy("registrant", "client", "year", "quarter").orderBy(F.desc("posted"), F.desc("id"))
    return reports.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def spend_by_issue(reports: DataFrame, issues: DataFrame) -> DataFrame:
    """DIS-13: a report's amount split evenly over its issues, summed by issue and quarter."""
    counted = issues.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("id")))
    return current_reports(reports).join(counted, "id").groupBy("code", "year", "quarter").agg(F.sum(F.col("amount") / F.col("_n")).alias("amount"), F.count(F.lit(1)).alias("reports"))


def obligations_by_prefix(obligations: DataFrame, n: int) -> DataFrame:
    """DIS-14: monthly sums over codes that share their first n characters."""
    return obligations.groupBy(F.substring("naics", 1, n).alias("prefix"), "month").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


def bills_per_month(bills: DataFrame) -> DataFrame:
    """DIS-15: bills introduced and enacted per area and month."""
    steps = F.explode(F.array(F.struct(F.lit("introduced").alias("step"), F.col("introduced").alias("d")), F.struct(F.lit("enacted").alias("step"), F.col("enacted").alias("d")))).alias("x")
    return bills.select("area", steps).where("x.d IS NOT NULL").groupBy("area", "x.step", F.trunc("x.d", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def congress_purchases(trades: DataFrame, least: float = 0, member: int | None = None) -> DataFrame:
    """DIS-03: one event per ticker and filing day of purchases of at least an amount."""
    rows = trades.where((F.col("trans_type") == "purchase") & (F.col("amount_min") >= least))
    rows = rows if member is None else rows.where(F.col("member") == member)
    return rows.groupBy("ticker", "filed").agg(F.count(F.lit(1)).alias("trades"))


def filing_events(filings: DataFrame, listings: DataFrame, item: str = "", form: str = "") -> DataFrame:
    """DIS-05: one event per listed issuer and day of filings whose form, and one of whose items, begins so. listings: cik, security_id."""
    rows = filings.where(F.col("form").startswith(form) & (F.exists(F.split("items", ","), lambda x: x.startswith(item)) if item else F.lit(True)))
    return rows.select("cik", "filed").distinct().join(listings.select("cik", "security_id"), "cik")


def holders(positions: DataFrame, cusips: DataFrame, limit: int) -> DataFrame:
    """DIS-10: the largest holders of each security at the latest period of any of its identifiers, options left out. cusips: security_id, cusip."""
    rows = positions.where("put_call = ''").join(cusips, "cusip")
    newest = rows.groupBy("security_id").agg(F.max("period").alias("period"))
    held = rows.join(newest, ["security_id", "period"]).groupBy("security_id", "period", "filer_cik").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"))
    return held.withColumn("rank", F.row_number().over(W.partitionBy("security_id").orderBy(F.desc("value"), "filer_cik"))).where(F.col("rank") <= limit)


def popularity(trades: DataFrame, since, until) -> DataFrame:
    """DIS-11: per ticker the distinct members, purchases, sales and the sum of least amounts."""
    rows = trades.where((F.col("filed") > since) & (F.col("filed") <= until))
    times = lambda t: F.sum((F.col("trans_type") == t).cast("long"))
    return rows.groupBy("ticker").agg(F.count_distinct("member").alias("members"), times("purchase").alias("purchases"), times("sale").alias("sales"), F.sum("amount_min").alias("least_amount"))


def party_trades(trades: DataFrame, seats: DataFrame, party: int, committee: int) -> DataFrame:
    """DIS-11: trades of a party's members who sit on a committee. seats: committee, member."""
    return trades.where(F.col("party") == party).join(seats.where(F.col("committee") == committee), "member", "left_semi")


def release_calendar(releases: DataFrame, series: DataFrame, start, days: int, daily: bool = False, often: int = 20) -> DataFrame:
    """DIS-16: releases scheduled in (start, start + days] with the series each updates; ones with ``often`` dates or more there count as daily."""
    window = releases.where((F.col("date") > start) & (F.col("date") <= F.date_add(start, days)))
    counts = window.groupBy("release").agg(F.count(F.lit(1)).alias("_n"))
    kept = window.join(counts, "release")
    kept = kept if daily else kept.where(F.col("_n") < often)
    names = series.groupBy("release").agg(F.array_join(F.array_sort(F.collect_set("series_id")), ",").alias("series"))  # a release has a bounded list
    return kept.join(names, "release", "left").select("release", "date", "series")


def fund_members(lots: DataFrame, securities: DataFrame, as_of) -> DataFrame:
    """DIS-17: each fund's holdings in the latest period filed by a day, with their security and weight."""
    known = lots.where(F.col("filed") <= as_of)
    newest = known.groupBy("fund").agg(F.max(F.struct("period", "filed")).alias("_p"))
    rows = known.join(newest, "fund").where((F.col("period") == F.col("_p.period")) & (F.col("filed") == F.col("_p.filed")))
    held = rows.groupBy("fund", "period", "identifier").agg(F.sum("value").alias("value"))
    weight = F.col("value") / F.sum("value").over(W.partitionBy("fund"))
    return held.withColumn("weight", weight).join(securities.select(F.col("security_id").alias("identifier"), "ticker"), "identifier", "left")


def cot_summary(positions: DataFrame) -> DataFrame:
    """DIS-18: each market and group at its latest report: net, weekly change, share of open interest and net's place in its range."""
    order = W.partitionBy("market", "trader").orderBy("report_date")
    rows = positions.withColumn("net", F.col("long_side") - F.col("short_side"))
    frame = order.rowsBetween(-155, 0)
    low, high = F.min("net").over(frame), F.max("net").over(frame)
    rows = rows.withColumns({"change": F.col("net") - F.lag("net").over(order), "share": F.try_divide(100.0 * F.col("net"), F.col("open_interest").cast("double")), "index": F.when(high > low, 100.0 * (F.col("net") - low) / (high - low)).otherwise(50.0), "_n": F.row_number().over(W.partitionBy("market", "trader").orderBy(F.desc("report_date")))})
    return rows.where("_n = 1").select("market", "trader", "report_date", "net", "change", "share", "index")


def short_jumps(rows: DataFrame, least: float = 0.25) -> DataFrame:
    """DIS-19: settlements whose position changed by ``least`` or more, dated by publication."""
    before = F.lag("position").over(W.partitionBy("security_id").orderBy("settlement_date"))
    change = F.when(before != 0, F.col("position") / before - 1)
    return rows.withColumn("change", change).where(F.abs("change") >= least).select("security_id", "settlement_date", "change")


def holder_change(positions: DataFrame) -> DataFrame:
    """DIS-20: distinct holders and shares of each identifier per period, and their change from the period before."""
    rows = positions.where("put_call = ''").groupBy("cusip", "period").agg(F.count_distinct("filer_cik").alias("holders"), F.sum("shares").alias("shares"))
    order = W.partitionBy("cusip").orderBy("period")
    follows = F.lag("period").over(order) == F.last_day(F.add_months("period", -3))
    change = lambda c: F.when(follows, F.col(c) - F.lag(c).over(order))
    return rows.withColumns({"holders_change": change("holders"), "shares_change": change("shares")})


def insider_trades(trades: DataFrame, code: str | None, limit: int) -> DataFrame:
    """DIS-21: each issuer's newest trades, of one code if given."""
    rows = trades if code is None else trades.where(F.col("trans_code") == code)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("issuer_cik").orderBy(F.desc("trans_date"), F.desc("id")))).where(F.col("rank") <= limit)
