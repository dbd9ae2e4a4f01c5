"""Tables for zones: rows, totals, exports, vesicles at their zone, pose results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import with_unit
from ..functions.numeric import col, distance_class, finite, pop_std
from ..operators import curves, spatial
from ..operators.clusters import NOISE


def zone_rows(zones: DataFrame, particles: DataFrame, keys: Sequence[str], distances: Sequence[str] = (), packing: DataFrame | None = None, area: str = "post_area") -> DataFrame:
    """One row for each zone: counts of particles, densities, mean distances, clusters and packing.

    zones: keys and the area. particles: keys, synaptic_designation, cluster
    and the distances; a designation other than synaptic, or none, is
    extrasynaptic. Densities are NULL without a positive area, means NULL
    without particles, counts 0. packing: keys, packing.
    """
    k = list(keys)
    per = particles.groupBy(*k).agg(
        F.count(F.lit(1)).alias("aunp_count"), F.count_if(F.col("synaptic_designation") == "synaptic").alias("synaptic_aunp_count"),
        *[F.avg(finite(c)).alias(f"{c}_mean") for c in distances], F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("aunp_cluster_count"),
    )
    out = zones.join(per, k, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    density = lambda c: F.when(F.col(area) > 0, zero(c) / F.col(area))
    out = out.select(
        *zones.columns, *[zero(c).alias(c) for c in ("aunp_count", "synaptic_aunp_count", "aunp_cluster_count")], (zero("aunp_count") - zero("synaptic_aunp_count")).alias("extrasynaptic_aunp_count"),
        density("aunp_count").alias("aunp_density"), density("synaptic_aunp_count").alias("synaptic_aunp_density"), *[F.col(f"{c}_mean") for c in distances],
    )
    if packing is not None:
        p = packing.groupBy(*k).agg(F.max("packing").alias("packing_density_max"), F.avg("packing").alias("packing_density_avg"), F.min("packing").alias("packing_density_min"))
        out = out.join(p, k, "left")
    return out


def zone_export(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zone rows in order of the keys, with units in the names of their numbers."""
    numbers = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")}
    return rows.orderBy(*keys).select(*[F.col(f"`{c}`").alias(with_unit(c) if c in numbers and c not in keys else c) for c in rows.columns])


def zone_totals(zones: DataFrame, by: Sequence[str], areas: Sequence[str] = ("pre_area", "post_area"), span: str = "span") -> DataFrame:
    """by, zones, mean and sum of each area, greatest span (0 if there is none); a zone without an area raises."""
    checked = zones
    for c in areas:
        checked = checked.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a zone has no {c}"))).otherwise(F.col(c)))
    agg = [F.count(F.lit(1)).alias("zones")]
    for c in areas:
        agg += [F.avg(c).alias(f"{c}_mean"), F.sum(c).alias(f"{c}_total")]
    return checked.groupBy(*by).agg(*agg, F.coalesce(F.max(span), F.lit(0.0)).alias("max_span"))


def membrane_volumes(volumes: DataFrame, by: Sequence[str], name: str = "membrane", value: str = "volume_um3") -> DataFrame:
    """by, mean and count of the presynaptic and the postsynaptic membranes' volumes, told by the start of their names; 0 without any."""
    out = []
    for side in ("presynaptic", "postsynaptic"):
        v = F.when(F.col(name).startswith(f"{side}_membrane"), F.col(value))
        out += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"avg_{side}_volume_um3"), F.count(v).alias(f"{side}_count")]
    return volumes.groupBy(*by).agg(*out)


def closest_zone(vesicles: DataFrame, points: DataFrame, zones: DataFrame, keys: Sequence[str], zone: str = "zone", id_col: str = "id") -> DataFrame:
    """keys, id, zone, distance: the zone nearest to each vesicle's centre, then the least distance from the vesicle's points to that zone.

    vesicles: keys, id, x, y, z (centres); points: keys, id, x, y, z; zones:
    keys, zone, id, x, y, z. Ties go to the first zone by name. A vesicle
    whose keys have no zone gets unknown and no distance; one without points
    of its own is measured from its centre.
    """
    k = list(keys)
    tagged = zones.select(*k, F.struct(F.col(zone), F.col(id_col)).alias("zid"), zone, "x", "y", "z")
    near = spatial.nearest(vesicles.select(*k, id_col, "x", "y", "z"), tagged, k, id_col, "zid", [zone]).select(*k, F.col(f"a_{id_col}").alias(id_col), F.col(f"b_{zone}").alias(zone))
    own = points.select(*k, id_col, "x", "y", "z").unionByName(vesicles.join(points.select(*k, id_col).distinct(), [*k, id_col], "left_anti").select(*k, id_col, "x", "y", "z"))
    n = own.join(near, [*k, id_col]).withColumn("pid", F.struct(F.col(id_col), F.col("x"), F.col("y"), F.col("z")))
    d = spatial.nearest(n.select(*k, zone, "pid", "x", "y", "z"), zones.select(*k, zone, F.col(id_col).alias("zid"), "x", "y", "z"), [*k, zone], "pid", "zid")
    d = d.groupBy(*k, F.col(f"a_pid.{id_col}").alias(id_col)).agg(F.min("d").alias("distance"))
    out = vesicles.select(*k, id_col).join(near, [*k, id_col], "left").join(d, [*k, id_col], "left")
    return out.withColumn(zone, F.coalesce(F.col(zone).cast("string"), F.lit("unknown")))


def vesicle_document(vesicles: DataFrame, points: DataFrame, by: Sequence[str], id_col: str = "id") -> DataFrame:
    """One document for each of by: n, mean and population deviation of diameters and distances (0 without vesicles), and the vesicles with their points, in order of id."""
    k = list(by)
    p = points.groupBy(*k, id_col).agg(F.sort_array(F.collect_list(F.struct("x", "y", "z"))).alias("points"))  # one vesicle's points
    rest = [c for c in vesicles.columns if c not in k]
    one = vesicles.join(p, [*k, id_col], "left").groupBy(*k)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return one.agg(
        F.count(id_col).alias("n"), *[zero(f(c)).alias(f"{c}_{n}") for c in ("diameter", "distance") for n, f in (("mean", lambda c: F.avg(finite(c))), ("sd", pop_std))],
        F.sort_array(F.collect_list(F.when(F.col(id_col).isNotNull(), F.struct(id_col, *[c for c in rest if c != id_col], "points")))).alias("vesicles"),
    )


def truthy(c: str | Column) -> Column:
    """True for true and for the texts true, 1 and yes; else false."""
    x = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(x.isin("true", "1", "yes"), F.lit(False))


def proximity_role(distance_class_: str, is_fusing: str, is_close: str, distance: str, cutoff: float) -> Column:
    """fusing, close or NULL: by the class if it says so, else by the flags, else by the distance."""
    c = F.lower(F.trim(F.col(distance_class_)))
    by_flag = F.when(truthy(is_fusing), "fusing").when(truthy(is_close), "close")
    by_distance = F.when(finite(distance) <= F.lit(float(cutoff)), "close")
    known = F.when(c.isin("fusing", "fusion"), "fusing").when(c == "close", "close")
    return F.when(c == "far", F.lit(None).cast("string")).otherwise(F.coalesce(known, by_flag, by_distance))


def stamped(df: DataFrame, **values: object) -> DataFrame:
    """df with constant columns that it lacks; existing ones stay."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({k: F.lit(v) for k, v in values.items() if k.lower() not in have})


def middle_element(values: str | Column) -> Column:
    """Element n div 2 of the sorted list; NULL if it is empty."""
    a = F.array_sort(F.filter(col(values), lambda x: x.isNotNull()))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def zone_of_index(picks: DataFrame, centres: DataFrame, keys: Sequence[str], index: str = "cleft", zone: str = "zone") -> DataFrame:
    """keys, index, zone: the zone whose centre is nearest to the mean of the index's picks, ties to the first zone by name.

    centres: keys, zone, and the pre and post centroid px, py, pz, qx, qy, qz;
    the centre is their mean, or the one that is there. Where keys have no
    centre, index i gets no zone.
    """
    k = list(keys)
    mean = picks.groupBy(*k, index).agg(*[F.avg(c).alias(c) for c in "xyz"])
    both = lambda c: F.coalesce((F.col(f"p{c}") + F.col(f"q{c}")) / 2, F.col(f"p{c}"), F.col(f"q{c}")).alias(c)
    near = spatial.nearest(mean, centres.select(*k, zone, *[both(c) for c in "xyz"]), k, index, zone)
    return mean.select(*k, index).join(near.select(*k, F.col(f"a_{index}").alias(index), F.col(f"b_{zone}").alias(zone)), [*k, index], "left")


def zone_by_position(indices: DataFrame, zones: DataFrame, keys: Sequence[str], index: str = "cleft", zone: str = "zone") -> DataFrame:
    """keys, index, zone: the i-th index with the i-th zone, both in order; what one side has more is left out."""
    w = lambda c: Window.partitionBy(*keys).orderBy(c)
    a = indices.select(*keys, index).distinct().withColumn("_n", F.row_number().over(w(index)))
    b = zones.select(*keys, zone).distinct().withColumn("_n", F.row_number().over(w(zone)))
    return a.join(b, [*keys, "_n"]).drop("_n")


def in_slice(points: DataFrame, by: Sequence[str], z: float, half: float, axis: str = "z") -> DataFrame:
    """by, n, any_inside, mean_inside: whether any point, and whether the mean, lies within half of the slice."""
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(axis) - z) <= half).alias("any_inside"), (F.abs(F.avg(axis) - z) <= half).alias("mean_inside"))


def pose_tables(points: DataFrame, valid: DataFrame, solutions: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """keys, solution, id, state of every point: paired, unpaired (in a valid pair, but not taken) or filtered_out (in no valid pair).

    valid: keys, a, b; solutions: keys, solution, a, b. A point that is no end
    of a valid pair is filtered out in every solution.
    """
    k = list(keys)
    ends = lambda df, *more: df.select(*k, *more, F.explode(F.array("a", "b")).alias(id_col)).distinct()
    n = solutions.select(*k, "solution").distinct()
    rows = points.select(*k, id_col).join(n, k)
    taken = ends(solutions, "solution").withColumn("_t", F.lit(True))
    able = ends(valid).withColumn("_v", F.lit(True))
    out = rows.join(taken, [*k, "solution", id_col], "left").join(able, [*k, id_col], "left")
    state = F.when(F.col("_t"), "paired").when(F.col("_v"), "unpaired").otherwise("filtered_out")
    return out.select(*k, "solution", id_col, state.alias("state"))


def pose_stats(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, solution, counts of each state, and the share of points that are paired."""
    agg = [F.count_if(F.col("state") == s).alias(s) for s in ("paired", "unpaired", "filtered_out")]
    out = states.groupBy(*keys, "solution").agg(F.count(F.lit(1)).alias("n"), *agg)
    return out.withColumn("efficiency", F.col("paired") / F.col("n"))


def zone_curves(curve: DataFrame, keys: Sequence[str], values: Sequence[str], least: int = 1) -> DataFrame:
    """Long zone table: keys, r, name, value, for zones with `least` radii and more; missing values stay out."""
    enough = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), finite(c).alias("value")) for c in values])).alias("_p")
    return curve.join(enough, list(keys), "left_semi").select(*keys, "r", pairs).select(*keys, "r", "_p.name", "_p.value").filter("value is not null")


def pooled_curves(long: DataFrame, by: Sequence[str], zone: Sequence[str]) -> DataFrame:
    """by, name, r and the bands over the zones whose curve has every radius of its name."""
    whole = curves.complete_only(long, [*by, *zone, "name"], ["name"])
    bands = curves.mean_bands(whole, [*by, "name", "r"], "value")
    return bands.join(curves.percentile_band(whole, [*by, "name", "r"], "value").select(*by, "name", "r", "median", "lo", "hi"), [*by, "name", "r"])


def sample_note(vesicles: DataFrame, by: Sequence[str], distance: str = "distance") -> DataFrame:
    """by, n, fusing, close: how many vesicles a table stands on."""
    c = distance_class(distance)
    return vesicles.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(c == "fusing").alias("fusing"), F.count_if(c == "close").alias("close"))
