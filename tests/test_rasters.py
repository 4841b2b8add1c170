import json
import os

import numpy as np
import pytest

from stormledger.sources import rasters
from stormledger.sources.rasters import Layout, read_grid, write_grid


def cells(spark, rows=10, cols=20):
    data = [(r, c, float(r * 100 + c) if (r + c) % 3 else None) for r in range(rows) for c in range(cols)] + [(-1, 0, 1.0), (0, cols, 1.0), (2, 0, -5.0)]
    return spark.createDataFrame(data, "row int, col int, value double")


WANT = {(r, c): r * 100.0 + c for r in range(10) for c in range(20) if (r + c) % 3}


@pytest.mark.parametrize("more", [{}, {"flipped": True}, {"transposed": True}, {"roll": 7}, {"flipped": True, "transposed": True, "roll": 13, "dtype": "float32"}])
def test_round_trip_whatever_the_stored_order(spark, tmp_path, more):
    layout = Layout(rows=10, cols=20, step=18.0, south=-81.0, west=-171.0, tile=4, **more)
    write_grid(cells(spark), f"file://{tmp_path}/g", layout)
    got = read_grid(spark, f"{tmp_path}/g").collect()
    assert {(r.row, r.col): r.value for r in got} == WANT and len(got) == len(WANT)
    assert all(r.lat == -81 + 18 * r.row and r.lon == -171 + 18 * r.col for r in got)
    raw = np.load(f"{tmp_path}/g/tile-0-0.npy")
    if more == {"flipped": True}:
        assert raw[0, 1] == 901.0  # the first stored row is the northernmost
    if more == {"transposed": True}:
        assert raw[1, 0] == 1.0
    if more == {"roll": 7}:
        assert raw[0, 0] == 7.0


def test_a_box_opens_only_its_windows(spark, tmp_path):
    layout = Layout(rows=10, cols=20, step=1.0, south=0.0, west=0.0, tile=4, roll=6)
    write_grid(cells(spark), f"{tmp_path}/g", layout)
    box = read_grid(spark, f"{tmp_path}/g").where("lat >= 4 and lat <= 6.5 and lon > 10 and lon < 12.5")
    assert {(r.row, r.col) for r in box.collect()} == {(r, c) for r, c in WANT if 4 <= r <= 6 and 11 <= c <= 12}
    assert read_grid(spark, f"{tmp_path}/g").rdd.getNumPartitions() == 15 and box.rdd.getNumPartitions() == 1
    assert read_grid(spark, f"{tmp_path}/g").where("lat > 50").collect() == []
    for name in os.listdir(f"{tmp_path}/g"):  # the other tiles aren't even opened
        if name.startswith("tile") and name != "tile-1-1.npy":
            open(f"{tmp_path}/g/{name}", "w").write("broken")
    assert box.count() > 0


def test_fill_values_and_rasters_that_are_there(spark, tmp_path):
    layout = Layout(rows=2, cols=2, step=1.0, south=0.0, west=0.0, tile=2, fill=0.0)
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, float("nan")), (1, 1, 3.0)], "row int, col int, value double")
    write_grid(df, f"{tmp_path}/g", layout)
    assert [(r.row, r.col, r.value) for r in read_grid(spark, f"{tmp_path}/g").collect()] == [(1, 1, 3.0)]
    with pytest.raises(Exception, match="holds a raster"):
        write_grid(df, f"{tmp_path}/g", layout, overwrite=False)
    write_grid(df.where("false"), f"{tmp_path}/g", layout)
    assert read_grid(spark, f"{tmp_path}/g").collect() == [] and json.load(open(f"{tmp_path}/g/layout.json"))["rows"] == 2
    with pytest.raises(ValueError):
        rasters.local("hdfs://host/g")


def test_shares_of_classes(spark, tmp_path):
    layout = Layout(rows=2, cols=2, step=1.0, south=0.0, west=0.0, tile=1)
    for name, data in (("a", [(0, 0, 40.0), (0, 1, 100.0)]), ("b", [(0, 0, 60.0), (1, 1, 10.0)])):
        write_grid(spark.createDataFrame(data, "row int, col int, value double"), f"{tmp_path}/{name}", layout)
    got = rasters.class_share([(read_grid(spark, f"{tmp_path}/a"), 1.0), (read_grid(spark, f"{tmp_path}/b"), 0.5)]).collect()
    assert {(r.row, r.col): r.value for r in got} == {(0, 0): 70.0, (0, 1): 100.0, (1, 1): 5.0}
