"""Rasters as a Spark data source: a window (one tile of the raster) is a partition, and filters on places leave out windows.

A raster is a folder that driver and executors share: layout.json and a file in numpy's format for each tile that has a
cell. The layout says how stored arrays lie: `transposed` (columns first), `flipped` (the first row is the northernmost) and `roll` (how many columns
the first stored one lies east of `west`, as in rasters from 0 to 360). Rows are the valid cells (row, col, lat, lon, value), row 0 in the south and
col 0 in the west whatever the stored order; cells of the fill value, and ones that are no number, have no row.

    write_grid(cells, folder, Layout(rows=360, cols=720, step=0.5, south=-89.75, west=-179.75))
    read_grid(spark, folder).where("lat between -5 and 10 and lon between 10 and 40")   # opens only these windows
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

CELLS = "row int, col int, lat double, lon double, value double"


@dataclass(frozen=True)
class Layout:
    """rows x cols cells of `step` degrees, the centre of the south-western one at (south, west); tiles of tile x tile; fill: the value that stands for none."""

    rows: int
    cols: int
    step: float
    south: float
    west: float
    tile: int = 64
    fill: float = -9999.0
    dtype: str = "float64"
    transposed: bool = False
    flipped: bool = False
    roll: int = 0


def local(path: str) -> str:
    """A path as Python opens it: the folder must be mounted on every machine."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"rasters need a mounted folder, not {url.scheme}:")
    return unquote(url.path) if url.scheme else path


def stored_tile(folder: str, i: int, j: int) -> str:
    return os.path.join(folder, f"tile-{i}-{j}.npy")


class Window(InputPartition):
    def __init__(self, i: int, j: int):
        super().__init__((i, j))


class GridReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        with open(os.path.join(folder, "layout.json")) as f:
            self.layout = Layout(**json.load(f))
        self.bounds = {c: [-math.inf, math.inf] for c in ("lat", "lon", "row", "col")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            if name in self.bounds and isinstance(value, (int, float)):
                low, high = self.bounds[name]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = max(low, value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = min(high, value)
                self.bounds[name] = [low, high]
            yield f  # Spark tests the rows of the windows that are left

    def places(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """row and col, in the raster's own order, of a stored tile's cells (rows x columns of the tile)."""
        x = self.layout
        r = np.arange(i * x.tile, min((i + 1) * x.tile, x.rows))
        c = np.arange(j * x.tile, min((j + 1) * x.tile, x.cols))
        return (x.rows - 1 - r if x.flipped else r), (c + x.roll) % x.cols

    def partitions(self) -> list[InputPartition]:
        x, out = self.layout, []
        for i in range(-(-x.rows // x.tile)):
            for j in range(-(-x.cols // x.tile)):
                row, col = self.places(i, j)
                values = {"row": row, "col": col, "lat": x.south + row * x.step, "lon": x.west + col * x.step}
                if all(((v >= low) & (v <= high)).any() for v, (low, high) in ((values[c], self.bounds[c]) for c in values)) and os.path.exists(stored_tile(self.folder, i, j)):
                    out.append(Window(i, j))
        return out or [Window(-1, -1)]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        i, j = partition.value
        if i < 0:
            return
        x = self.layout
        cells = np.load(stored_tile(self.folder, i, j), allow_pickle=False)
        cells = cells.T if x.transposed else cells
        row, col = self.places(i, j)
        a, b = np.nonzero((cells != x.fill) & np.isfinite(cells))
        row, col = row[a].astype(np.int32), col[b].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(x.south + row * x.step), pa.array(x.west + col * x.step), pa.array(cells[a, b].astype(float))], names=["row", "col", "lat", "lon", "value"])


class GridWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, layout: Layout):
        self.folder, self.layout = folder, layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Rows (row, col, value, i, j) come tile by tile; a tile's file appears whole, so a task that runs again does no harm."""
        now, cells = None, None
        for batch in iterator:
            row, col, value, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("row", "col", "value", "i", "j"))
            for at in range(len(row)):
                key = (int(i[at]), int(j[at]))
                if key != now:
                    self.save(now, cells)
                    now, cells = key, self.empty(*key)
                cells[row[at] - key[0] * self.layout.tile, col[at] - key[1] * self.layout.tile] = value[at]
        self.save(now, cells)
        return WriterCommitMessage()

    def empty(self, i: int, j: int) -> np.ndarray:
        x = self.layout
        return np.full((min(x.tile, x.rows - i * x.tile), min(x.tile, x.cols - j * x.tile)), x.fill, x.dtype)

    def save(self, key: tuple | None, cells: np.ndarray | None) -> None:
        if key is not None:
            path = stored_tile(self.folder, *key)
            part = f"{path}.{os.uname().nodename}-{os.getpid()}.part"
            with open(part, "wb") as f:
                np.save(f, cells.T if self.layout.transposed else cells, allow_pickle=False)
            os.replace(part, path)

    def commit(self, messages) -> None:
        with open(os.path.join(self.folder, "layout.json"), "w") as f:
            json.dump(asdict(self.layout), f)

    def abort(self, messages) -> None:
        pass  # without a layout the folder is no raster


class GridTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridtiles"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> GridReader:
        return GridReader(local(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> GridWriter:
        folder = local(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        for name in os.listdir(folder):
            if name.startswith("tile-") or name == "layout.json":
                if not overwrite:
                    raise ValueError(f"{folder} holds a raster")
                os.remove(os.path.join(folder, name))
        return GridWriter(folder, Layout(**json.loads(self.options["layout"])))


def write_grid(cells: DataFrame, folder: str, layout: Layout, overwrite: bool = True) -> None:
    """cells (row, col, value) as a raster; of a cell with several rows the greatest value stays, a null value and a place outside have no cell."""
    cells.sparkSession.dataSource.register(GridTiles)
    inside = F.col("row").between(0, layout.rows - 1) & F.col("col").between(0, layout.cols - 1) & F.col("value").isNotNull()
    one = cells.where(inside).groupBy("row", "col").agg(F.max(F.col("value").cast("double")).alias("value"))
    row = F.lit(layout.rows - 1) - F.col("row") if layout.flipped else F.col("row")
    placed = one.select(row.cast("int").alias("row"), F.pmod(F.col("col") - layout.roll, F.lit(layout.cols)).cast("int").alias("col"), "value")
    tiles = placed.withColumn("i", F.floor(F.col("row") / layout.tile).cast("int")).withColumn("j", F.floor(F.col("col") / layout.tile).cast("int"))
    sorted_ = tiles.repartition("i", "j").sortWithinPartitions("i", "j")  # a tile is one task's
    sorted_.write.format("gridtiles").mode("overwrite" if overwrite else "append").option("layout", json.dumps(asdict(layout))).save(folder)


def read_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid cells of a raster; filters on lat, lon, row and col leave out windows."""
    spark.dataSource.register(GridTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("gridtiles").load(folder)


def class_share(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """row, col, lat, lon and value, the weighted sum of several rasters' cells; a cell that one of them lacks counts as none of that class."""
    rows = [df.select("row", "col", "lat", "lon", (F.col("value") * w).alias("value")) for df, w in parts]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("row", "col").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.sum("value").alias("value"))
