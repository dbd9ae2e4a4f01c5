"""Voxel tables (z, y, x, value): slabs, crops, labels by distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import affine
from ..staging import staged
from .spatial import nearest


def slab(voxels: DataFrame, z: int, half: int, how: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """keys, y, x, value over the slices z - half to z + half: mean, min or max."""
    fn = {"mean": F.avg, "min": F.min, "max": F.max}[how]
    return voxels.filter(F.col("z").between(z - half, z + half)).groupBy(*keys, "y", "x").agg(fn("value").alias("value"))


def crop(image: DataFrame, y0: int, x0: int, size: int, fill: float = 0.0) -> DataFrame:
    """size x size window around (y0, x0), padded with fill."""
    spark, half = image.sparkSession, size // 2
    grid = spark.range(size * size).select((F.floor(F.col("id") / size) + y0 - half).cast("int").alias("y"), (F.col("id") % size + x0 - half).cast("int").alias("x"))
    return grid.join(image.select("y", "x", "value"), ["y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def central_slice(voxels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Slice n // 2 of each volume."""
    mid = voxels.groupBy(*keys).agg(F.floor((F.max("z") + 1) / 2).cast("int").alias("z")) if keys else voxels.agg(F.floor((F.max("z") + 1) / 2).cast("int").alias("z"))
    return voxels.join(mid, [*keys, "z"])


def contrast(image: DataFrame, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """Values scaled to 0..1 between two percentiles."""
    p = image.agg(F.percentile("value", F.lit(low / 100)).alias("_l"), F.percentile("value", F.lit(high / 100)).alias("_h"))
    v = (F.col("value") - F.col("_l")) / (F.col("_h") - F.col("_l"))
    return image.crossJoin(p).withColumn("value", F.when(F.col("_h") > F.col("_l"), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).drop("_l", "_h")  # one row


def labelled(voxels: DataFrame, references: DataFrame, reach: float) -> DataFrame:
    """voxels (id, x, y, z) with label: that of the reference (x, y, z, label, priority) within reach by (priority, distance, label), else 0.

    Priorities are few: each is one search for the nearest reference, over
    the voxels that no lesser one has reached.
    """
    todo, best = voxels.select("id", "x", "y", "z"), None
    for (level,) in sorted(references.select("priority").distinct().collect(), key=lambda p: (p[0] is not None, p[0])):  # few
        own = references.filter(F.col("priority").eqNullSafe(F.lit(level))).select("x", "y", "z", "label")
        got = staged(nearest(todo, own, right_id="label", max_distance=reach).select(F.col("a_id").alias("id"), F.col("b_label").alias("label")), "labels")
        best = got if best is None else best.unionByName(got)
        todo = staged(todo.join(got.select("id").hint("merge"), "id", "left_anti"), "unlabelled")
    if best is None:
        return voxels.withColumn("label", F.lit(0))
    return voxels.join(best, "id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def resampled(voxels: DataFrame, matrix: list[list[float]], shape: tuple[int, int, int], fill: float = 0.0) -> DataFrame:
    """z, y, x, value on a grid of `shape` (z, y, x): the trilinear value of the volume where the 4 x 4 matrix takes each grid point (x, y, z).

    Corners outside the volume count as fill. A grid point meets its eight
    corners in one equi-join.
    """
    spark, (nz, ny, nx) = voxels.sparkSession, shape
    grid = spark.range(nz * ny * nx).select(
        F.floor(F.col("id") / (ny * nx)).cast("int").alias("z"), F.floor(F.col("id") % (ny * nx) / nx).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x")
    )
    to = affine(matrix)
    at = grid.select("z", "y", "x", *[c.alias(f"t{k}") for k, c in zip("xyz", to, strict=True)])
    ends = {k: [(F.floor(f"t{k}").cast("int"), 1 - (F.col(f"t{k}") - F.floor(f"t{k}"))), ((F.floor(f"t{k}") + 1).cast("int"), F.col(f"t{k}") - F.floor(f"t{k}"))] for k in "xyz"}
    corners = F.array(*[F.struct(a.alias("cx"), b.alias("cy"), c.alias("cz"), (u * v * w).alias("w")) for a, u in ends["x"] for b, v in ends["y"] for c, w in ends["z"]])
    each = at.select("z", "y", "x", F.explode(corners).alias("c")).select("z", "y", "x", "c.cx", "c.cy", "c.cz", "c.w").filter("w > 0")
    source = voxels.select(F.col("x").cast("int").alias("cx"), F.col("y").cast("int").alias("cy"), F.col("z").cast("int").alias("cz"), "value")
    return each.join(source, ["cx", "cy", "cz"], "left").groupBy("z", "y", "x").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(float(fill)))).alias("value"))
