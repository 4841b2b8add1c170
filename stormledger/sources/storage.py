"""Snapshots, product documents and scans of landed files, through Spark's readers and writers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of its own only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def documents(spark: SparkSession, folder: str, schema: str, glob: str = "*.json") -> DataFrame:
    """path, name, doc (by schema) and `fault` of each file of a folder, in order of path; missing or broken ones have a null doc, so a default can stand for it.

    fault: empty, broken (no JSON) or no_object (a JSON value of another kind).
    """
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.trim("value").alias("value"))
    kind = F.when(F.col("value") == "", "empty").when(F.try_parse_json("value").isNull(), "broken").when(~F.col("value").startswith("{"), "no_object")
    files = files.withColumn("fault", kind)
    return files.select("path", "name", F.when(F.col("fault").isNull(), F.from_json("value", schema)).alias("doc"), "fault").orderBy("path")


def only_one(files: DataFrame, suffix: str) -> DataFrame:
    """The row of the one file whose name ends with suffix; an error unless there is exactly one."""
    found = files.where(F.col("name").endswith(suffix))
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no file' if not n else 'more than one file'} ends with {suffix}")
    return found


def require_objects(files: DataFrame) -> DataFrame:
    """files, or an error if one of them is no JSON object."""
    bad = files.where(F.col("fault").isNotNull()).select("name", "fault").first()
    if bad:
        raise ValueError(f"{bad.name} is {bad.fault}")
    return files


def safe_name(key: Column) -> Column:
    """A file name for a key: other characters than letters, digits, points, hyphens and underscores become one underscore, 160 at most."""
    return F.substring(F.regexp_replace(F.coalesce(key, F.lit("event")), "[^A-Za-z0-9_.-]+", "_"), 1, 160)


def write_snapshot(rows: DataFrame, folder: str, generated_at: str) -> None:
    """rows as the latest snapshot, and in the archive under generated_at; an entry of that name is replaced, others stay."""
    dated = rows.withColumn("generated_at", F.lit(generated_at))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generated_at").parquet(f"{folder}/archive")
    dated.write.mode("overwrite").parquet(f"{folder}/latest")


def write_products(rows: DataFrame, key: str, doc: str, folder: str) -> None:
    """A document a key, as text under its safe name; keys written before and absent now are stale and go."""
    named = rows.select(safe_name(F.col(key)).alias("name"), F.col(doc).alias("value"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("name").text(folder)


def stabilised(old: DataFrame, new: DataFrame, key: str, volatile: str = "generated_at") -> DataFrame:
    """key, doc and `kept`: the old text of a product whose new one differs in its top-level `volatile` field alone, else the new one.

    Documents are JSON objects; fields are compared as sorted maps of their JSON texts.
    """

    def fields(doc: Column) -> Column:
        names = F.array_sort(F.array_remove(F.json_object_keys(doc), volatile))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.get(F.map_values(F.map_filter(F.from_json(doc, "map<string,string>"), lambda k, v: k == n)), F.lit(0)).alias("value")))

    both = new.select(key, F.col("doc").alias("new")).join(old.select(key, F.col("doc").alias("old")), key, "left")
    kept = F.coalesce(fields(F.col("old")) == fields(F.col("new")), F.lit(False))
    return both.select(key, F.when(kept, F.col("old")).otherwise(F.col("new")).alias("doc"), kept.alias("kept"))


def allowed_host(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a link's host is one of hosts or below one."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith(f".{h}")
    return out


def country_code(*codes: Column) -> Column:
    """The first of a country's codes that is known (not -99 nor empty), if it has three characters."""
    first = F.coalesce(*[F.when(~F.trim(c).isin("", "-99"), F.trim(c)) for c in codes])
    return F.when(F.length(first) == 3, F.upper(first))


def rates(rows: DataFrame, code: str, value: str, order: str) -> DataFrame:
    """code and value of rows with a three-letter code and a finite value not below zero, the last one in order."""
    v = F.col(value).try_cast("double")
    good = rows.select(F.upper(F.trim(code)).alias("code"), v.alias("value"), F.col(order).alias("at")).where("code rlike '^[A-Z]{3}$' and value >= 0 and value < double('infinity')")
    return good.groupBy("code").agg(F.max_by("value", "at").alias("value"))


def lookup(views: list[DataFrame], key: str) -> DataFrame:
    """The row of each key in the first of views that has one, with `view`, its number."""
    every = views[0].withColumn("view", F.lit(0))
    for k, v in enumerate(views[1:], 1):
        every = every.unionByName(v.withColumn("view", F.lit(k)), allowMissingColumns=True)
    rest = [c for c in every.columns if c != key]
    best = every.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("view")).alias("x"))
    return best.select(key, "x.*")


def feature_collection(features: DataFrame, group: str, lon: str, lat: str, *properties: str, order: str) -> DataFrame:
    """group and `geojson`, a FeatureCollection of its points in order; a group is one document, so it is as large as a document may be."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    lists = features.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), feature.alias("f")))).alias("x"))
    return lists.select(group, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("x", lambda x: x["f"]).alias("features"))).alias("geojson"))


def manifest_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and fault (missing, unlisted, changed) by a manifest (path, sha256) of files (path, content)."""
    have = files.select("path", F.sha2("content", 256).alias("have"))
    both = have.join(manifest.select("path", F.col("sha256").alias("want")), "path", "full_outer")
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed")
    return both.select("path", fault.alias("fault")).where("fault is not null")
