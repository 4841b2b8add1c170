import datetime as dt

import pytest
from pyspark.sql import functions as F

from stormledger.streaming import lifecycle

DAY = dt.datetime(2026, 9, 1)
COLUMNS = "key string, ts timestamp, run string"


def land(spark, folder, name, *rows):
    """rows: (key, day, run)."""
    data = [(k, None if d is None else DAY + dt.timedelta(days=d), r) for k, d, r in rows]
    spark.createDataFrame(data, COLUMNS).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def take(spark, source, folder, **more):
    schema = spark.read.option("recursiveFileLookup", "true").parquet(source).schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source).withColumn("delivery", F.col("_metadata.file_path"))
    lifecycle.keep(rows, ["key"], folder, **more)
    return rows_of(spark, folder)


def rows_of(spark, folder):
    return {r.key: (r.first_seen, r.last_seen, r.observations, r.run_count) for r in lifecycle.current(spark, ["key"], folder).collect()}


FILES = {
    "a": [("x", 10, "r1"), ("x", 10.5, "r2"), ("y", 10, "r1"), (None, 10, "r1"), ("z", None, "r1")],
    "b": [("x", 12, "r3"), ("y", 12, "r3")],
    "again": [("x", 12, "r3"), ("y", 12, "r3")],  # a run that is delivered twice
    "late": [("x", 9, "r0"), ("w", 9.5, "r0")],
    "c": [("x", 13, "r4")],
}


def test_a_stream_that_stops_and_goes_on_gives_the_result_of_one_run(spark, tmp_path):
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    for name, rows in FILES.items():
        land(spark, one, name, *rows)
    whole = take(spark, one, f"{tmp_path}/kept-one")
    for name, rows in FILES.items():
        land(spark, two, name, *rows)
        got = take(spark, two, f"{tmp_path}/kept-two")  # a new query each time, from the state that the last one left
        if name == "again":
            assert got["x"][2:] == (3, 3) and got["y"][2:] == (2, 3)
            assert lifecycle.merge(spark, ["key"], f"{tmp_path}/kept-two") > 0 and rows_of(spark, f"{tmp_path}/kept-two") == got
            assert lifecycle.merge(spark, ["key"], f"{tmp_path}/kept-two") == 0
    assert got == whole
    day = lambda d: DAY + dt.timedelta(days=d)
    assert whole == {"x": (day(9), day(13), 5, 5), "y": (day(10), day(12), 2, 3), "w": (day(9.5), day(9.5), 1, 1)}


def test_watermark_and_timer(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/kept"
    more = {"late": "2 days", "quiet_days": 3}
    land(spark, source, "a", ("x", 0, "r0"), ("y", 0, "r0"))
    take(spark, source, folder, **more)
    land(spark, source, "b", ("y", 10, "r10"))
    take(spark, source, folder, **more)  # the watermark is at day 8 behind this
    quiet = {r.key: r.quiet for r in lifecycle.current(spark, ["key"], folder).collect()}
    assert quiet == {"x": True, "y": False}
    land(spark, source, "c", ("x", 5, "too late"), ("y", 9, "r9"))
    got = take(spark, source, folder, **more)
    assert got["x"][2] == 1 and got["y"][2] == 3
    land(spark, source, "d", ("x", 11, "r11"))
    take(spark, source, folder, **more)
    back = {r.key: (r.quiet, r.observations) for r in lifecycle.current(spark, ["key"], folder).collect()}
    assert back["x"] == (False, 2)


def test_a_closed_day_leaves_no_state(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/kept"
    land(spark, source, "a", ("x", 0, "r0"))
    land(spark, source, "b", ("y", 20, "r20"))
    take(spark, source, folder, late="1 day", quiet_days=1, closes=True)
    assert {r.key: r.quiet for r in lifecycle.current(spark, ["key"], folder).collect()} == {"x": True, "y": False}
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{folder}/state")
    assert state.count() == 1


def test_nothing_landed(spark, tmp_path):
    assert lifecycle.current(spark, ["key"], f"{tmp_path}/none") is None and lifecycle.merge(spark, ["key"], f"{tmp_path}/none") == 0


def test_the_provider_is_put_back(spark):
    before = spark.conf.get(lifecycle.PROVIDER)
    with pytest.raises(ZeroDivisionError), lifecycle.rocks(spark):
        assert spark.conf.get(lifecycle.PROVIDER) == lifecycle.ROCKS
        1 / 0
    assert spark.conf.get(lifecycle.PROVIDER) == before
