"""Structured Streaming forms of the incremental jobs (STR operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet event files."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def daily_activity(events: DataFrame, late: str = "2 days") -> DataFrame:
    """STR-06: events, users and value per type and day; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "users", "value")


def bursts(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """STR-06: sessions of a user's events with less than ``gap`` between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """STR-02: each key once, whichever feed brings it first."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def buyers(events: DataFrame, late: str = "2 days", days: int = 30) -> DataFrame:
    """STR-03: distinct users of each type in rolling windows that move by a day; a type's users are few, so the set is kept."""
    sets = events.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), "event_type").agg(F.collect_set("user_id").alias("users"))
    return sets.select("event_type", F.col("w.end").alias("until"), F.size("users").cast("long").alias("users"))


def newly_flagged(events: DataFrame, threshold: float) -> DataFrame:
    """STR-04: a row whenever a user's value reaches the threshold after being below it; a batch is taken in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flagged = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        now = rows["value"] >= threshold
        out = rows[now & ~now.shift(1, fill_value=flagged)]
        state.update((bool(now.iloc[-1]),))
        yield out[["user_id", "ts", "value"]]

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, value double", "flagged boolean", "append", GroupStateTimeout.NoTimeout)


def known_values(vintages: DataFrame) -> DataFrame:
    """STR-05: the newest vintage of each observation, updated as vintages arrive."""
    return vintages.groupBy("series_id", "date").agg(F.max_by("value", "realtime_start").alias("value"), F.max("realtime_start").alias("realtime_start"))


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there; its result is a Parquet table, with one folder a batch.

    In complete mode each batch is the whole result, so only the last counts. A
    batch that is run again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number if mode == 'append' else 0}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def upsert(stream: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """STR-01: micro-batches as an append-only log, read as the newest row of each key; a replayed batch changes nothing."""
    log = drain(stream, path)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, "v.*")


def backfill(stored: DataFrame, master: DataFrame, gained: DataFrame) -> DataFrame:
    """STR-07: stored rows of symbols that have just gained an id, replayed under that id and added to the master's rows."""
    replayed = stored.join(gained, "symbol").select(*master.columns)
    return master.join(replayed.select("security_id", "date"), ["security_id", "date"], "left_anti").unionByName(replayed)
