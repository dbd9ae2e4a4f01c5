"""The driver's tables seen as the library's: points, spheres, curves, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, zone, kind (0 or 1), x, y, z and normals nx, ny, nz from the first six components."""
    e = F.col("embedding")
    axes = [(F.get(e, F.lit(i)).cast("double") * 100).alias(k) for i, k in enumerate("xyz")]
    normals = [F.get(e, F.lit(i + 3)).cast("double").alias(f"n{k}") for i, k in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("zone"), (F.col("vec_id") % 2).cast("int").alias("kind"), *axes, *normals)


def of_kind(pts: DataFrame, kind: int) -> DataFrame:
    return pts.filter(F.col("kind") == kind).drop("kind")


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", "zone", "x", "y", "z", (1 + F.col("id") % 7).cast("double").alias("r"))


#: The same views in SQL.
PTS_SQL = """
pts AS (SELECT vec_id AS id, label AS zone, CAST(vec_id % 2 AS INT) AS kind,
  CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z,
  CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz FROM embeddings),
sph AS (SELECT id, zone, x, y, z, CAST(1 + id % 7 AS DOUBLE) AS r FROM pts),
k0 AS (SELECT * FROM pts WHERE kind = 0), k1 AS (SELECT * FROM pts WHERE kind = 1),
vol AS (SELECT zone, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume FROM pts GROUP BY zone)
"""
D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
