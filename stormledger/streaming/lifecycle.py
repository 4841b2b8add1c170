"""Lifecycle and day ledgers kept by Structured Streaming as keyed state.

The state of a key is one row in the state store: first and last observation, the runs it was seen in and how often it was
delivered. A run that is delivered again (the same run under another file) is one more delivery and no new observation.
Rows may come late by up to the watermark's delay; later ones are dropped, and runs older than that leave the state. A
timer in event time marks a key as quiet when the watermark has passed its last observation by `quiet`, or drops its state.

State and results are in the folder that the caller names. A stopped stream goes on from there: a micro-batch that had not
ended runs again and overwrites its own results. merge() folds the results of ended batches into one table.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "first_us long, last_us long, observations long, run_count long, version long, runs array<string>, run_us array<long>, quiet boolean"
RESULT = "first_us long, last_us long, observations long, run_count long, version long, quiet boolean"


class Lifecycle(StatefulProcessor):
    """Rows (ts, run, delivery) of a key into its state; a row of results for each key that a batch or a timer changes."""

    def __init__(self, keys: list[str], quiet_ms: int, closes: bool):
        self.keys, self.quiet_ms, self.closes = keys, quiet_ms, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", STATE)

    def row(self, key: tuple, state: tuple) -> pd.DataFrame:
        first, last, observations, run_count, version, _, _, quiet = state
        return pd.DataFrame([(*key, first, last, observations, run_count, version, quiet)], columns=[*self.keys, "first_us", "last_us", "observations", "run_count", "version", "quiet"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.kept.get() if self.kept.exists() else None
        first, last, observations, run_count, version, runs, run_us, _ = old if old else (None, None, 0, 0, 0, [], [], False)
        seen = dict(zip(runs or [], run_us or []))
        deliveries: set = set()
        for part in rows:
            us = part["us"]
            low, high = int(us.min()), int(us.max())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
            deliveries.update(part["delivery"])
            for run, at in zip(part["run"], us):
                if run not in seen:
                    observations += 1
                seen[run] = max(int(at), seen.get(run, int(at)))
        gone = timerValues.getCurrentWatermarkInMs() * 1000
        seen = {run: at for run, at in seen.items() if at >= gone}  # an older one can't come again: it would be dropped as late
        state = (first, last, observations, run_count + len(deliveries), version + 1, list(seen), list(seen.values()), False)
        self.kept.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last // 1000 + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.row(key, state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, observations, run_count, version, runs, run_us, _ = self.kept.get()
        state = (first, last, observations, run_count, version + 1, runs, run_us, True)
        if self.closes:
            self.kept.clear()
        else:
            self.kept.update(state)
        yield self.row(key, state)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """The state store that keyed state needs, for the streams started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def keep(rows: DataFrame, keys: list[str], folder: str, late: str = "21 days", quiet_days: float = 7, closes: bool = False) -> None:
    """Takes what is there of the stream rows (keys, ts, run, delivery) into the state and results of folder, then stops.

    closes: a quiet key's state goes, as that of a day that is over; else it stays, and the key comes back when it is seen again.
    A row with a null key, ts or run is no observation.
    """
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    good = rows.where(" and ".join(f"`{c}` is not null" for c in (*keys, "ts", "run")))
    chosen = good.select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("run").cast("string").alias("run"), F.col("delivery").cast("string").alias("delivery"))
    kept = chosen.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(Lifecycle(keys, int(quiet_days * 86_400_000), closes), f"{schema}, {RESULT}", "update", "eventTime")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    with rocks(rows.sparkSession):
        kept.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def _newest(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """The batch up to which results are merged (-1: none), and the batches after it."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()

    def numbers(name: str) -> list[int]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = path.getFileSystem(hadoop)
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    upto = max(numbers("merged"), default=-1)
    return upto, sorted(n for n in numbers("batches") if n > upto)


def current(spark: SparkSession, keys: list[str], folder: str) -> DataFrame | None:
    """The newest results of each key: keys, first_seen, last_seen, observations, run_count and quiet; None before any batch has ended."""
    upto, batches = _newest(spark, folder)
    paths = [f"{folder}/merged/upto={upto}"] * (upto >= 0) + [f"{folder}/batches/batch={n}" for n in batches]
    if not paths:
        return None
    at = lambda c: F.timestamp_micros(f"x.{c}_us").alias(f"{c}_seen")
    newest = spark.read.parquet(*paths).groupBy(*keys).agg(F.max_by(F.struct("first_us", "last_us", "observations", "run_count", "version", "quiet"), "version").alias("x"))
    return newest.select(*keys, at("first"), at("last"), "x.observations", "x.run_count", "x.quiet", "x.version")


def merge(spark: SparkSession, keys: list[str], folder: str) -> int:
    """Folds the results of all ended batches into one table and removes them; how many there were. Not while the stream runs."""
    upto, batches = _newest(spark, folder)
    if not batches:
        return 0
    rows = current(spark, keys, folder)
    us = lambda c: F.unix_micros(f"{c}_seen").alias(f"{c}_us")
    rows.select(*keys, us("first"), us("last"), "observations", "run_count", "version", "quiet").write.mode("overwrite").parquet(f"{folder}/merged/upto={batches[-1]}")
    hadoop = spark._jsc.hadoopConfiguration()
    for name in [f"batches/batch={n}" for n in batches] + [f"merged/upto={upto}"] * (upto >= 0):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(hadoop).delete(path, True)
    return len(batches)


def landed(spark: SparkSession, folder: str, pattern: str, files: int = 8) -> DataFrame:
    """The event files of a folder with a name like pattern as a stream, `files` a micro-batch, with `delivery`, the file a row is from."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("delivery", F.col("_metadata.file_path"))


def lifecycle(spark: SparkSession, source: str, pattern: str, key: Column, run: Column, folder: str, late: str = "90 days", closes: bool = False) -> DataFrame | None:
    """current() results of a folder's event files by key (a column, named), with all that have landed taken in."""
    rows = landed(spark, source, pattern).withColumn("run", run).withColumn("__key", key)
    keep(rows.withColumnRenamed("__key", "key"), ["key"], folder, late=late, closes=closes)
    return current(spark, ["key"], folder)
