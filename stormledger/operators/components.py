"""Cutting the lineage of what rounds build up, and dealing out rows that are much work each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stormledger.sources.storage import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df in the folder of spark.checkpoint.dir, which driver and executors share."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame, path: str, over: str | None = None) -> DataFrame:
    """df as a table at path in the shared folder, read again; over: a table of an earlier round that nothing reads any more, which goes.

    Spark takes a checkpoint to be as large as the plan behind it was reckoned, a product for each join: over rounds of joins
    that number's digits double each time, until planning takes all time and memory. A table is as large as its files.
    """
    spark = df.sparkSession
    df.write.parquet(path)
    if over:
        old = spark._jvm.org.apache.hadoop.fs.Path(over)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as the session shuffles to, dealt by keys if any: rows of few bytes that are much work would else be left to a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
