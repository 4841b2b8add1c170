"""The typed hazard event view over the `events` table, and a generated population grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hazard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, origin, source_id, type, lat, lon, ts, day, alert, burned_area_ha, user_id of each event."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    k = F.get_json_object("props", "$.k").try_cast("double")
    kind = F.create_map(*[F.lit(x) for pair in (("view", "Wildfire"), ("click", "Flood"), ("purchase", "Storm"), ("error", "Drought"), ("signup", "Heat")) for x in pair])[F.col("event_type")]
    return e.select(
        n.alias("event_id"),
        F.concat(F.lit("ev-"), n.cast("string")).alias("id"),
        F.when(n % 3 == 0, "gdacs").when(n % 3 == 1, "eonet").otherwise("cems").alias("origin"),
        n.cast("string").alias("source_id"),
        kind.alias("type"),
        ((F.round(F.col("value") * 100).cast("long") * 13 % 4000) / 100.0 - 20.0).cast("double").alias("lat"),
        ((n * n % 6007) / 100.0).cast("double").alias("lon"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("day"),
        F.when(k < 60, "Green").when(k < 85, "Orange").when(k >= 85, "Red").alias("alert"),
        F.when(kind == "Wildfire", F.col("value") * 100).alias("burned_area_ha"),
        "user_id",
        "value",
    )


#: The same view in DuckDB.
HAZARD = """WITH hazard AS (
  SELECT event_id, 'ev-' || event_id AS id, CASE event_id % 3 WHEN 0 THEN 'gdacs' WHEN 1 THEN 'eonet' ELSE 'cems' END AS origin, CAST(event_id AS VARCHAR) AS source_id,
    CASE event_type WHEN 'view' THEN 'Wildfire' WHEN 'click' THEN 'Flood' WHEN 'purchase' THEN 'Storm' WHEN 'error' THEN 'Drought' WHEN 'signup' THEN 'Heat' END AS type,
    CAST((CAST(round(value * 100) AS BIGINT) * 13 % 4000) / 100.0 - 20.0 AS DOUBLE) AS lat, CAST((event_id * event_id % 6007) / 100.0 AS DOUBLE) AS lon,
    ts, CAST(ts AS DATE) AS day, CASE WHEN k < 60 THEN 'Green' WHEN k < 85 THEN 'Orange' WHEN k >= 85 THEN 'Red' END AS alert,
    CASE WHEN event_type = 'view' THEN value * 100 END AS burned_area_ha, user_id, value
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))
"""


def population_grid(spark: SparkSession) -> DataFrame:
    """Cells of 0.5 degrees over the view's area: row, col, centre and people."""
    cells = spark.range(0, 88 * 124).select((F.col("id") / 124).cast("int").alias("row"), (F.col("id") % 124).cast("int").alias("col"))
    return cells.select("row", "col", (F.col("row") * 0.5 - 21.75).alias("lat_c"), (F.col("col") * 0.5 - 0.75).alias("lon_c"), ((F.col("row") * 31 + F.col("col") * 17) % 97).cast("long").alias("people"))


GRID = """grid AS (SELECT row, col, row * 0.5 - 21.75 AS lat_c, col * 0.5 - 0.75 AS lon_c, CAST((row * 31 + col * 17) % 97 AS BIGINT) AS people
  FROM (SELECT unnest(range(88)) AS row), (SELECT unnest(range(124)) AS col))
"""
