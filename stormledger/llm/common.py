"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fold of a labelled row: the remainder of crc32(doc_id as text) by FOLDS; HELD_OUT is never learned from.
FOLDS, HELD_OUT = 3, 1


#: Tables written in this process that release() removes.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that written() left in the shared folder, once the results that read them are stored; their number."""
    hadoop = spark._jsc.hadoopConfiguration()
    n = len(WRITTEN)
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def rank_in_crc(col: str):
    """A fixed pseudo-random order of rows by key, to bound a sample of labelled rows."""
    return F.xxhash64(F.col(col), F.lit("sample"))


def give_back() -> None:
    """Hands freed memory back to the system at a task's end: a worker lives on, and what it once needed would add up over stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def with_fields(fields, ddl: str) -> StructType:
    """A schema: these fields, whatever their names, then those of ddl."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def renamed(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with names for all but the needed columns that no operator uses, and the names to give back."""
    names = {c: f"__{k}" for k, c in enumerate(docs.columns) if c not in needed}
    return docs.withColumnsRenamed(names), {new: old for old, new in names.items()}


def crc32_u32(ids) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


#: A table is broadcast only if its counted size is below this; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, arrays: tuple[str, ...] = (), row_bytes: int = 48, element_bytes: int = 16, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table), marked for broadcast if its rows and the elements of its `arrays`, counted here, are below limit."""
    elements = sum((F.coalesce(F.sum(F.size(a)), F.lit(0)) for a in arrays), F.lit(0))
    n, m = df.agg(F.count("*"), elements).first()
    return F.broadcast(df) if n * row_bytes + m * element_bytes <= limit else df
