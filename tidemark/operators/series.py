"""Point-in-time series (TSR operators): steps, vintages, combinations and sampling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.windows import product
from tidemark.operators import indicators


def combine(series: DataFrame, benchmark: int = 0) -> DataFrame:
    """TSR-03: ratio to and difference from the benchmark series on each date; null if either is null or the divisor 0."""
    other = series.where(F.col("key") == benchmark).select("date", F.col("value").alias("_o"))
    joined = series.where(F.col("key") != benchmark).join(other, "date")
    return joined.select("key", "date", F.when(F.col("_o") != 0, F.col("value") / F.col("_o")).alias("ratio"), (F.col("value") - F.col("_o")).alias("difference"))


def step(known: DataFrame, days: DataFrame) -> DataFrame:
    """TSR-04: for each series and day the latest value with known_on <= day.

    Values and days run through one window, so there is no range join. known: key, known_on, value.
    """
    grid = known.select("key").distinct().crossJoin(days.select("date"))  # one row for each series and day is the result
    events = known.where("value is not null").select("key", F.col("known_on").alias("date"), "value", F.lit(0).alias("asked"))
    both = events.unionByName(grid.select("key", "date", F.lit(None).cast("double").alias("value"), F.lit(1).alias("asked")))
    latest = F.last("value", ignorenulls=True).over(W.partitionBy("key").orderBy("date", "asked").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("value", latest).where("asked = 1").select("key", "date", "value")


def newest_known(vintages: DataFrame, days: DataFrame) -> DataFrame:
    """series_id, day, date, value: on each day the newest observation that has a value as published by then.

    A vintage holds from its realtime_start to the next one of its observation;
    a null vintage withdraws. An observation stops to matter once a newer one
    has its last vintage, so spans are short; they meet the days by month.
    """
    order = W.partitionBy("series_id", "date").orderBy("realtime_start")
    spans = vintages.withColumns({"until": F.lead("realtime_start").over(order), "final": F.lead("realtime_start").over(order).isNull() & F.col("value").isNotNull()})
    settled = spans.groupBy("series_id", "date").agg(F.min(F.when(F.col("final"), F.col("realtime_start"))).alias("settled"))
    newer = F.min("settled").over(W.partitionBy("series_id").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1))
    spans = spans.where("value is not null").join(settled.select("series_id", "date", newer.alias("covered")), ["series_id", "date"])
    last = days.agg(F.max("date").alias("last"))
    ends = spans.crossJoin(F.broadcast(last)).withColumn("until", F.least("until", "covered", F.date_add("last", 1))).where("realtime_start < until")  # last: one row
    months = F.sequence(F.trunc("realtime_start", "month"), F.trunc(F.date_sub("until", 1), "month"), F.expr("interval 1 month"))
    met = ends.withColumn("month", F.explode(months)).join(days.select(F.col("date").alias("day"), F.trunc("date", "month").alias("month")), "month").where("day >= realtime_start and day < until")
    return met.groupBy("series_id", "day").agg(F.max(F.struct("date", "value")).alias("b")).select("series_id", "day", "b.date", "b.value")


def as_known(vintages: DataFrame, days: DataFrame) -> DataFrame:
    """TSR-06: the newest observation's value on each day; null if it is dated after the day."""
    return newest_known(vintages, days).select("series_id", "day", F.when(F.col("date") <= F.col("day"), F.col("value")).alias("value"))


def known_growth(vintages: DataFrame, days: DataFrame, back: int) -> DataFrame:
    """TSR-07: log growth of the newest known observation over the one ``back`` days earlier, both in their vintages of the day."""
    now = newest_known(vintages, days).select("series_id", "day", F.date_sub("date", back).alias("date"), F.col("value").alias("now"))
    asked = now.select("series_id", "date", F.col("day").alias("at"), F.lit(1).alias("asked"), "now", F.lit(None).cast("double").alias("value"), F.lit(False).alias("void"))
    told = vintages.select("series_id", "date", F.col("realtime_start").alias("at"), F.lit(0).alias("asked"), F.lit(None).cast("double").alias("now"), "value", F.col("value").isNull().alias("void"))
    upto = W.partitionBy("series_id", "date").orderBy("at", "asked").rowsBetween(W.unboundedPreceding, 0)
    vintage = F.last(F.when(F.col("asked") == 0, F.struct("value")), ignorenulls=True).over(upto)
    rows = asked.unionByName(told).withColumn("before", vintage["value"]).where("asked = 1")
    return rows.select("series_id", F.col("at").alias("day"), F.when((F.col("now") > 0) & (F.col("before") > 0), F.log(F.col("now") / F.col("before"))).alias("growth"))


def conditional_availability(date: Column, since: str, days: int = 31) -> Column:
    """TSR-10: from ``since`` on, known ``days`` after the month's end; before, on 30 June of the next year."""
    return F.when(date >= F.lit(since).cast("date"), F.date_add(F.last_day(date), days)).otherwise(F.make_date(F.year(date) + 1, F.lit(6), F.lit(30)))


def exact(series: DataFrame, days: DataFrame, shift: int = 0) -> DataFrame:
    """TSR-16, TSR-17: the value of exactly that day, or of the day ``shift`` rows of the calendar before; nothing is carried."""
    source = F.lag("date", shift).over(W.orderBy("date")) if shift else F.col("date")
    asked = days.select("date", source.alias("source"))  # a calendar: one row a day
    return series.select("key", F.col("date").alias("source"), "value").join(asked, "source").select("key", "date", "value")


def deflate(prices: DataFrame, index: DataFrame) -> DataFrame:
    """TSR-22: price over the latest index value on or before its day. prices: key, date, value; index: date, value."""
    rows = prices.select("key", "date", "value", F.lit(None).cast("double").alias("index"), F.lit(1).alias("asked"))
    keys = prices.select("key").distinct().crossJoin(index.where("value is not null").select("date", F.col("value").alias("index")))  # one index series a key
    both = rows.unionByName(keys.select("key", "date", F.lit(None).cast("double").alias("value"), "index", F.lit(0).alias("asked")))
    latest = F.last("index", ignorenulls=True).over(W.partitionBy("key").orderBy("date", "asked").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("base", latest).where("asked = 1").select("key", "date", F.when(F.col("base") != 0, F.col("value") / F.col("base")).alias("value"))


def observations(series: DataFrame, start: str, end: str) -> DataFrame:
    """TSR-23: the observations dated in [start, end]."""
    return series.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def lagged(rows: DataFrame, key: Column, date: Column, value: Column, known_on: Column) -> DataFrame:
    """TSR-08, TSR-11..15, TSR-18: any table as public-dated observations (key, date, known_on, value)."""
    return rows.select(key.cast("string").alias("key"), date.alias("date"), known_on.alias("known_on"), value.cast("double").alias("value"))


Loader = Callable[[DataFrame], DataFrame]
Transform = Callable[..., Column | Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class Registry:
    """EXT-01, EXT-03: what specs may name. It never changes: registering makes another one, so no user alters a query of somebody else.

    A source makes (ident, known_on, value) from its table. A transform makes a
    column from the window, or a function of (key, date, value) rows; beside it
    stands the default window, None for one that must be given, NO_WINDOW for a
    transform without.
    """

    sources: Mapping[str, Loader] = field(default_factory=lambda: MappingProxyType({}))
    transforms: Mapping[str, tuple[Transform, int | None]] = field(default_factory=lambda: MappingProxyType({}))

    def with_source(self, name: str, loader: Loader) -> Registry:
        return Registry(MappingProxyType({**self.sources, name: loader}), self.transforms)

    def with_transform(self, name: str, make: Transform, window: int | None = None) -> Registry:
        return Registry(self.sources, MappingProxyType({**self.transforms, name: (make, window)}))


NO_WINDOW = 0


def _recursive(column: str, **fixed: int) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: indicators.recursive(rows, **fixed).select("key", "date", F.col(column).alias("value"))


def _framed(make: Callable[..., DataFrame], column: str, *window: int) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: make(rows, *window).select("key", "date", F.col(column).alias("value"))


#: The transforms that every registry begins with.
STANDARD = (
    Registry()
    .with_transform("sma", indicators.sma)
    .with_transform("ema", lambda n: _recursive("ema", ema_n=n))
    .with_transform("rsi", lambda n: _recursive("rsi", rsi_n=n), 14)
    .with_transform("macd", lambda: _recursive("macd"), NO_WINDOW)
    .with_transform("ret", indicators.ret, 1)
    .with_transform("diff", indicators.diff, 1)
    .with_transform("stdev", indicators.stdev, 20)
    .with_transform("vol", lambda n: _framed(indicators.vol, "vol", n), 21)
    .with_transform("z", indicators.zscore, 252)
    .with_transform("high", indicators.high)
    .with_transform("low", indicators.low)
    .with_transform("dd", indicators.drawdown, 252)
    .with_transform("yoy", lambda: _framed(indicators.yoy, "yoy"), NO_WINDOW)
)


@dataclass(frozen=True)
class Spec:
    """TSR-01: one or two terms (source, id), the sign between them, and the transforms with their windows."""

    text: str
    terms: tuple[tuple[str, str], ...]
    operator: str | None = None
    transforms: tuple[tuple[str, int], ...] = ()


def parsed(text: str, registry: Registry) -> Spec:
    """TSR-01: ``source:id``, or two of them around one / or -, then ``|name[:N]`` transforms; spaces around the parts do not count.

    A sign counts only where a known source follows it, so ids may hold both.
    """
    head, *chain = (x.strip() for x in text.split("|"))
    known = "|".join(map(re.escape, sorted(registry.sources, key=len, reverse=True)))
    parts = re.split(rf"\s*([/-])\s*(?=(?:{known}):)", head) if known else [head]
    if len(parts) > 3:
        raise ValueError(f"{text!r}: at most one / or - between two series")
    terms = []
    for part in parts[::2]:
        name, _, ident = (x.strip() for x in part.partition(":"))
        if name not in registry.sources or not ident:
            raise ValueError(f"{text!r}: a series is one of {sorted(registry.sources)}, a colon and an id")
        terms.append((name, ident))
    steps = []
    for step_ in chain:
        name, _, n = (x.strip() for x in step_.partition(":"))
        if name not in registry.transforms:
            raise ValueError(f"{text!r}: no transform {name!r}")
        window = registry.transforms[name][1]
        if n and (window == NO_WINDOW or not n.isdigit() or int(n) < 1):
            raise ValueError(f"{text!r}: bad window {n!r}")
        if not n and window is None:
            raise ValueError(f"{text!r}: {name} needs a window")
        steps.append((name, int(n) if n else window))
    return Spec(text, tuple(terms), parts[1] if len(parts) == 3 else None, tuple(steps))


def transformed(rows: DataFrame, steps: Iterable[tuple[str, int]], registry: Registry) -> DataFrame:
    """(key, date, value) after each transform."""
    for name, window in steps:
        make = registry.transforms[name][0]
        made = make() if window == NO_WINDOW else make(window)
        rows = rows.withColumn("value", made) if isinstance(made, Column) else made(rows)
    return rows


def build(specs: Iterable[str | Spec], tables: dict[str, DataFrame], days: DataFrame, registry: Registry, start: str | None = None, end: str | None = None) -> DataFrame:
    """TSR-02: key (the spec's text), date, value of every spec over the calendar, in one job.

    Each term is loaded once and carried forward; specs with the same transforms
    run them together, over the whole history, before the cut to [start, end].
    ``tables`` has the input of each source.
    """
    found = {s.text: s for s in (s if isinstance(s, Spec) else parsed(s, registry) for s in specs)}
    terms = sorted({t for s in found.values() for t in s.terms})
    loaded = []
    for source in sorted({s for s, _ in terms}):
        wanted = [i for s, i in terms if s == source]
        rows = registry.sources[source](tables[source]).where(F.col("ident").isin(wanted))
        loaded.append(rows.select(F.concat(F.lit(f"{source}:"), "ident").alias("key"), "known_on", "value"))
    grid = step(reduce(DataFrame.unionByName, loaded), days)
    chains = sorted({s.transforms for s in found.values()})
    name = lambda t: ":".join(t)
    plan = [(s.text, name(s.terms[0]), name(s.terms[1]) if s.operator else None, s.operator, chains.index(s.transforms)) for s in found.values()]
    table = days.sparkSession.createDataFrame(plan, "spec string, a string, b string, op string, chain int")  # one row a spec
    rows = grid.select(F.col("key").alias("a"), "date", F.col("value").alias("x")).join(table, "a").join(grid.select(F.col("key").alias("b"), "date", F.col("value").alias("y")), ["b", "date"], "left")
    value = F.when(F.col("op") == "/", F.when(F.col("y") != 0, F.col("x") / F.col("y"))).when(F.col("op") == "-", F.col("x") - F.col("y")).otherwise(F.col("x"))
    out = rows.select(F.col("spec").alias("key"), "date", value.alias("value"), "chain")
    done = [transformed(out.where(F.col("chain") == i).drop("chain"), chain, registry).select("key", "date", "value") for i, chain in enumerate(chains)]
    out = reduce(DataFrame.unionByName, done)
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def latest_revision(vintages: DataFrame) -> DataFrame:
    """The value of the latest vintage of each observation."""
    return vintages.groupBy("series_id", "date").agg(F.max_by("value", "realtime_start").alias("value"))


def weekdays_after(day, n: int):
    """TSR-09: the n-th weekday after a date, in closed form."""
    d = F.weekday(day)  # Monday 0
    start = F.when(d >= 5, F.date_sub(day, (d - 4).cast("int"))).otherwise(day)
    d = F.least(d, F.lit(4))
    return F.date_add(start, (F.lit(n) + 2 * F.floor((d + n) / 5)).cast("int"))


def month_ends(days: DataFrame) -> DataFrame:
    """TSR-19: last trading day of each calendar month."""
    return days.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))


def monthly_returns(returns: DataFrame) -> DataFrame:
    """TSR-21: daily returns compounded within the month."""
    return returns.where("value is not null").groupBy("key", F.trunc("date", "month").alias("month")).agg((product(1 + F.col("value")) - 1).alias("value"))


def averages(series: DataFrame) -> DataFrame:
    """TSR-20: monthly means, and quarter means where all three months exist."""
    months = series.where("value is not null").groupBy("key", F.trunc("date", "month").alias("month")).agg(F.avg("value").alias("value"))
    quarters = months.groupBy("key", F.trunc("month", "quarter").alias("quarter")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).where("n = 3")
    return quarters.select("key", "quarter", "value")
