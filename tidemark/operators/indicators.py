"""Technical indicators of (key, date, value) series (IND and STA operators). All are causal."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import recurrence
from tidemark.functions.ranks import expanding_counts
from tidemark.functions.windows import change, full

#: Rows after which the gains of the one-sided filter count as settled, if rounding keeps them moving.
SETTLED = 100_000


def _by() -> WindowSpec:
    return W.partitionBy("key").orderBy("date")


def _value() -> Column:
    return F.col("value")


def sma(n: int, value: Column | None = None) -> Column:
    value = _value() if value is None else value
    return full(value, _by(), n, F.avg)


def ret(n: int = 1, value: Column | None = None) -> Column:
    value = _value() if value is None else value
    return change(value, _by(), n)


def diff(n: int = 1, value: Column | None = None) -> Column:
    value = _value() if value is None else value
    return value - F.lag(value, n).over(_by())


def stdev(n: int, value: Column | None = None) -> Column:
    value = _value() if value is None else value
    return full(value, _by(), n, F.stddev_samp)


def zscore(n: int, value: Column | None = None) -> Column:
    value = _value() if value is None else value
    spread = stdev(n, value)
    return F.when(spread != 0, (value - sma(n, value)) / spread)


def high(n: int, value: Column | None = None) -> Column:
    value = _value() if value is None else value
    return full(value, _by(), n, F.max)


def low(n: int, value: Column | None = None) -> Column:
    value = _value() if value is None else value
    return full(value, _by(), n, F.min)


def drawdown(n: int = 252, value: Column | None = None) -> Column:
    value = _value() if value is None else value
    return value / high(n, value) - 1


def vol(series: DataFrame, n: int = 21) -> DataFrame:
    """Standard deviation of daily returns times the square root of 252."""
    return series.withColumn("_r", ret()).withColumn("vol", stdev(n, F.col("_r")) * math.sqrt(252)).drop("_r")


def realised_vol(series: DataFrame, n: int = 21) -> DataFrame:
    """Standard deviation of n log returns times the square root of 252; null if a price is missing or not positive."""
    before = F.lag("value").over(_by())
    logs = F.when((_value() > 0) & (before > 0), F.log(_value() / before))
    return series.withColumn("_r", logs).withColumn("realised_vol", stdev(n, F.col("_r")) * math.sqrt(252)).drop("_r")


def yoy(series: DataFrame) -> DataFrame:
    """Change against the value on the latest date 365 days before or earlier; a null there is not skipped."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    before = F.last("value").over(W.partitionBy("key").orderBy("_day").rangeBetween(W.unboundedPreceding, -365))
    return series.withColumn("_day", day).withColumn("_b", before).withColumn("yoy", F.when(F.col("_b") != 0, _value() / F.col("_b") - 1)).drop("_day", "_b")


def log_growth(series: DataFrame, n: int = 12, k: int = 3) -> DataFrame:
    """Log growth over n rows of positive values, and its change over k rows."""
    before = F.lag("value", n).over(_by())
    out = series.withColumn("growth", F.when((_value() > 0) & (before > 0), F.log(_value() / before)))
    return out.withColumn("acceleration", F.col("growth") - F.lag("growth", k).over(_by()))


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the n values that end at each row; nan where one is missing or too few exist."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).mean(1)
    return out


def _first_full(windows: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block the first row number at which each window is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in recurrence.segments(batches):
            x, place = recurrence.numbers(part.column("value")), part.column("place").to_numpy()
            found = [place[full] for full in (~np.isnan(_means(x, n)) for n in windows)]
            firsts = pa.array([[int(f[0]) if len(f) else None for f in found]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("key").slice(0, 1), firsts], names=["key", "firsts"])

    return run


def _filter_maps(windows: list[int], rsi_n: int) -> recurrence.Maps:
    """An ema of each window, then the mean gain and the mean loss, each a recurrence of one number.

    An ema begins with the first full mean and keeps its state over a missing
    value, which resets gain and loss: they begin anew with n changes.
    """

    def maps(x: np.ndarray, place: np.ndarray, extra: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(windows) + 2
        a, c, ready = np.zeros((len(x), k)), np.zeros((len(x), k)), np.zeros((len(x), k), dtype=bool)
        firsts, there = extra["seeds"][0].as_py(), ~np.isnan(x)
        for j, (n, first) in enumerate(zip(windows, firsts, strict=True)):
            if first is None:
                continue
            alpha, after = 2 / (n + 1), place > first
            a[:, j] = np.where(after, np.where(there, 1 - alpha, 1.0), 0.0)
            c[:, j] = np.where(after, np.where(there, alpha * np.nan_to_num(x), 0.0), 0.0)
            c[place == first, j] = _means(x, n)[place == first]
            ready[:, j] = there & (place >= first)
        step = np.diff(x, prepend=np.nan)
        for j, side in ((k - 2, np.where(step > 0, step, step * 0)), (k - 1, np.where(step < 0, -step, step * 0))):
            seed = _means(side, rsi_n)
            full = ~np.isnan(seed)
            goes_on = full & np.concatenate([[False], full[:-1]])
            a[:, j] = np.where(goes_on, (rsi_n - 1) / rsi_n, 0.0)
            c[:, j] = np.where(goes_on, np.nan_to_num(side) / rsi_n, np.nan_to_num(seed))
            ready[:, j] = full
        return a[:, :, None, None], c[:, :, None], ready

    return maps


def recursive(series: DataFrame, ema_n: int = 12, slow_n: int = 26, rsi_n: int = 14, block: int = recurrence.BLOCK) -> DataFrame:
    """IND-02..04: ema, macd and rsi of every series, by a blocked scan: a long series is spread over many tasks.

    An ema keeps its state over nulls; a null resets the rsi.
    """
    windows = [ema_n, 12, slow_n]
    rows = recurrence.blocks(series, max(*windows, rsi_n) + 2, block)
    kind = rows.schema["key"].dataType.simpleString()
    firsts = recurrence.dealt(rows).mapInArrow(_first_full(windows), f"key {kind}, firsts array<bigint>")
    seeds = firsts.groupBy(F.col("key").alias("_k")).agg(F.array(*(F.min(F.col("firsts")[i]) for i in range(3))).alias("seeds"))
    known = rows.join(seeds, F.col("key").eqNullSafe(F.col("_k"))).drop("_k")
    out = recurrence.scan(known, _filter_maps(windows, rsi_n), 5, 1, ["seeds"], block)
    s = [F.when(F.col("ready")[i], F.col("state")[i]) for i in range(5)]
    rsi = F.when(s[4] > 0, 100 - 100 / (1 + s[3] / s[4])).when(s[4].isNotNull(), 100.0)
    return out.select("key", "date", "value", s[0].alias("ema"), (s[1] - s[2]).alias("macd"), rsi.alias("rsi"))


def trailing_rank(n: int = 756, least: int = 252, value: Column | None = None) -> Column:
    """Share of the non-null values of the window that are at or below the current one."""
    value = _value() if value is None else value
    frame = _by().rowsBetween(1 - n, 0)
    inside = F.collect_list(value).over(frame)
    return F.when(value.isNotNull() & (F.count(value).over(frame) >= least), F.size(F.filter(inside, lambda x: x <= value)) / F.size(inside))


def expanding_rank(rows: DataFrame, least: int = 20, value: str = "value", key: str = "key", date: str = "date") -> DataFrame:
    """STA-02: ``rows`` with ``rank``, the share of the key's values so far that are at or below the row's, once ``least`` exist.

    A key has one row a day. The counts come from dominance counting, not from
    the list of what came before.
    """
    counts = expanding_counts(rows, key, date, value).select(F.col(key).alias("_k"), F.col(date).alias("_d"), F.when(F.col("seen") >= least, F.col("below") / F.col("seen")).alias("rank"))
    return rows.join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col(date) == F.col("_d")), "left").drop("_k", "_d")


def basket_log_level(rows: DataFrame, members: DataFrame) -> DataFrame:
    """IND-13: mean log price of each basket and day, null where a member has none. rows: key, date, value; members: basket, key."""
    sizes = members.groupBy("basket").agg(F.count_distinct("key").alias("_n"))
    prices = rows.where("value > 0").join(members, "key").groupBy("basket", "date").agg(F.avg(F.log("value")).alias("level"), F.count(F.lit(1)).alias("_k"))
    return prices.join(sizes, "basket").select("basket", "date", F.when(F.col("_k") == F.col("_n"), F.col("level")).alias("level"))


def one_sided_gap(series: DataFrame, smoothing: float = 1600.0, least: int = 15, block: int = recurrence.BLOCK) -> DataFrame:
    """STA-05: value less the last point of the HP trend fitted on the values up to it, from ``least`` values on.

    That last point is the filtered level of a trend whose second differences
    have variance 1 / smoothing, so one pass of a two-state filter gives it for
    every prefix. The filter's gains depend on the row number alone, so the pass
    is a blocked scan of 2 x 2 maps.
    """

    gains, (a, b, c) = [], (1.0, 0.0, 1.0)  # covariance of the last two trend points
    while len(gains) < 2 or gains[-1] != gains[-2]:  # the gains settle; all later rows have the last ones
        a, b, c = 4 * a - 4 * b + c + 1 / smoothing, 2 * a - b, a
        gains.append((a / (a + 1), b / (a + 1)))
        a, b, c = a / (a + 1), b / (a + 1), c - b * b / (a + 1)
        if len(gains) >= SETTLED:
            break
    table = np.array(gains)

    def maps(x: np.ndarray, place: np.ndarray, extra: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x)
        g, h = table[np.clip(place - 2, 0, len(table) - 1)].T
        m = np.stack([np.stack([2 * (1 - g), g - 1], 1), np.stack([1 - 2 * h, h], 1)], 1)
        v = np.stack([g * x, h * x], 1)
        early = place < 2  # the first two values are the first two states
        m[early] = 0.0
        v[early] = np.stack([x, np.concatenate([[0.0], x[:-1]])], 1)[early]
        return m[:, None], v[:, None], np.ones((n, 1), dtype=bool)

    rows = recurrence.blocks(series.where("value IS NOT NULL"), 2, block)
    out = recurrence.scan(rows, maps, 1, 2, size=block)
    return out.select("key", "date", F.when(F.col("place") + 1 >= least, F.col("value") - F.col("state")[0]).alias("gap"))


def range_index(n: int = 156, least: int = 52, value: Column | None = None) -> Column:
    """100 x (value - least) / (most - least) over the window, 50 when flat."""
    value = _value() if value is None else value
    frame = _by().rowsBetween(1 - n, 0)
    low_, high_ = F.min(value).over(frame), F.max(value).over(frame)
    return F.when(F.count(value).over(frame) >= least, F.when(high_ == low_, F.when(value.isNotNull(), 50.0)).otherwise(100 * (value - low_) / (high_ - low_)))


def deviation(n: int, least: int = 20, value: Column | None = None) -> Column:
    """Value less the mean of the n rows before it."""
    value = _value() if value is None else value
    frame = _by().rowsBetween(-n, -1)
    return F.when(F.count(value).over(frame) >= least, value - F.avg(value).over(frame))


def decile(by: list[str], order: list[Column]) -> Column:
    """Zero-based rank times 10 divided by the group's size, whole part."""
    group = W.partitionBy(*by)
    return F.floor((F.row_number().over(group.orderBy(*order)) - 1) * 10 / F.count(F.lit(1)).over(group)).cast("long")
