"""Spatial joins as equi-joins on grid cells.

All functions take two tables with columns x, y, z (and the key columns that
must agree, such as tomogram and zone). The result has the keys, the other
columns with the prefixes a_ and b_, and the distance d. Rows with a null
coordinate meet nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import distance, finite
from ..staging import drop_staged, staged

#: Pairs within keys up to which a nearest-neighbour search joins on the keys alone.
DIRECT_PAIRS = 20_000_000


def sided(df: DataFrame, prefix: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *[F.col(f"`{c}`").alias(prefix + c) for c in df.columns if c not in keys])


def _cells(prefix: str, r: float, axes: str) -> list[Column]:
    return [F.floor(F.col(prefix + k) / F.lit(float(r))).alias(f"_c{k}") for k in axes]


def within(left: DataFrame, right: DataFrame, r: float, keys: Sequence[str] = (), axes: str = "xyz", halves: bool = False) -> DataFrame:
    """Pairs at most r apart: right in cells of side r, left copied to the 3^n cells around its own.

    With halves, for a table with itself by its id, left goes to its own cell
    and to those after it alone: every two rows meet once, in one order or the
    other, and no row meets itself.

    Spark takes a row and its copies for one row, and a staged table for as
    large as its file, so it would broadcast far more than its limit: the
    join is by sorting, whatever the sizes seem to be.
    """
    a, b = sided(left, "a_", keys), sided(right, "b_", keys).select("*", *_cells("b_", r, axes))
    b = b.select(*[F.col(c) for c in b.columns])
    around = a
    for k in axes:
        cell = F.floor(F.col(f"a_{k}") / F.lit(float(r)))
        around = around.withColumn(f"_c{k}", F.explode(F.array(*[cell + i for i in (-1, 0, 1)])))
    on = [*keys, *[f"_c{k}" for k in axes]]
    d = distance("a_", "b_", axes)
    if halves:
        own = F.struct(*[F.floor(F.col(f"a_{k}") / F.lit(float(r))) for k in axes])
        at = F.struct(*[F.col(f"_c{k}") for k in axes])
        around = around.filter(own <= at).withColumn("_own", own == at)
        met = around.hint("merge").join(b, on).filter(~F.col("_own") | (F.col("a_id") < F.col("b_id")))
        return met.withColumn("d", d).filter(F.col("d") <= F.lit(float(r))).drop("_own", *[f"_c{k}" for k in axes])
    return around.hint("merge").join(b, on).withColumn("d", d).filter(F.col("d") <= F.lit(float(r))).drop(*[f"_c{k}" for k in axes])


def pairs_within_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], axes: str = "xyz", dealt: bool = False) -> DataFrame:
    """All pairs that agree in the keys.

    If dealt, both sides of a key are cut into blocks and each two blocks meet
    in one task, so few keys with many rows still make many tasks, and none
    holds a whole key. Each side is copied as often as the other has blocks.
    """
    a, b = sided(left, "a_", keys), sided(right, "b_", keys)
    if dealt:
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = math.ceil(math.sqrt(parts))
        on = [*keys, "_i", "_j"]
        own = lambda df: F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(blocks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        a, b = a.withColumn("_i", own(a)).withColumn("_j", every), b.withColumn("_j", own(b)).withColumn("_i", every)
        a, b = (df.repartition(parts, *on) for df in (a, b))  # small rows, many pairs
        met = a.hint("merge").join(b.select(*[F.col(c) for c in b.columns]), on).drop("_i", "_j")
    else:
        met = a.join(b, list(keys)) if keys else a.crossJoin(b)
    return met.withColumn("d", distance("a_", "b_", axes)).filter(F.col("d").isNotNull())


def _best(pairs: DataFrame, keys: Sequence[str], left_id: str, right_id: str, payload: Sequence[str]) -> DataFrame:
    columns = list(dict.fromkeys([right_id, *payload]))
    picked = F.min(F.struct("d", F.col(f"b_{right_id}").alias("_id"), F.struct(*[F.col(f"b_{c}").alias(c) for c in columns]).alias("p"))).alias("_m")
    out = pairs.groupBy(*keys, f"a_{left_id}").agg(picked)
    return out.select(*keys, F.col(f"a_{left_id}"), *[F.col(f"_m.p.{c}").alias(f"b_{c}") for c in columns], F.col("_m.d").alias("d"))


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = (), left_id: str = "id", right_id: str = "id", payload: Sequence[str] = (),
    max_distance: float | None = None, axes: str = "xyz", exclude_self: bool = False, cell: float | None = None,
) -> DataFrame:
    """keys, a_<id>, b_<id>, payload and d: the nearest right row of each left row, ties to the least right id.

    Left rows without a right row (in reach) are absent; left-join to keep
    them. The number of pairs within the keys is counted: few are joined on
    the keys alone, or by one grid join with max_distance; many are searched
    with cells that double, up to max_distance, until each left row has a
    neighbour within the searched radius. A coordinate that is NaN or infinite is null,
    whichever way is taken, and its row meets nothing.
    """
    left, right = ([df.withColumns({k: finite(k) for k in axes}) for df in (left, right)])
    other = F.col(f"a_{left_id}") != F.col(f"b_{right_id}")
    keep = (lambda p: p.filter(other)) if exclude_self else (lambda p: p)
    if max_distance is not None and max_distance <= 0:
        return _best(keep(within(left, right, max_distance, keys, axes)), keys, left_id, right_id, payload)
    if cell is None:
        n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        m = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
        both = n.join(m, list(keys)) if keys else n.crossJoin(m)  # one row each without keys
        if (both.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) <= DIRECT_PAIRS:
            few = pairs_within_keys(left, right, keys, axes) if max_distance is None else within(left, right, max_distance, keys, axes)
            return _best(keep(few), keys, left_id, right_id, payload)
    spans = right.agg(*[(F.max(k) - F.min(k)).alias(k) for k in axes], *[F.min(k).alias(f"l{k}") for k in axes], *[F.max(k).alias(f"h{k}") for k in axes], F.count(F.lit(1)).alias("n")).first()
    if not spans["n"]:
        return _best(keep(pairs_within_keys(left, right, keys, axes)), keys, left_id, right_id, payload)
    edges = left.agg(*[F.min(k).alias(f"l{k}") for k in axes], *[F.max(k).alias(f"h{k}") for k in axes]).first()
    either = lambda a, b: a if b is None else b if a is None else None
    high = {k: either(spans[f"h{k}"], edges[f"h{k}"]) if None in (spans[f"h{k}"], edges[f"h{k}"]) else max(spans[f"h{k}"], edges[f"h{k}"]) for k in axes}
    low = {k: either(spans[f"l{k}"], edges[f"l{k}"]) if None in (spans[f"l{k}"], edges[f"l{k}"]) else min(spans[f"l{k}"], edges[f"l{k}"]) for k in axes}
    if any(v is None for v in high.values()):  # an axis without any value: nothing meets
        return _best(within(left.limit(0), right, 1.0, keys, axes), keys, left_id, right_id, payload)
    reach = sum((high[k] - low[k]) ** 2 for k in axes) ** 0.5
    volume = 1.0
    for k in axes:
        volume *= max(spans[k] or 0.0, reach / 1000, 1e-9)  # a flat cloud does not start with tiny cells
    r = cell or max(1e-9, (volume / spans["n"]) ** (1 / len(axes)))
    if max_distance is not None:
        reach = max_distance
        r = min(r, reach)
    todo, done = left, None
    while True:
        found = staged(_best(keep(within(todo, right, r, keys, axes)), keys, left_id, right_id, payload), "nearest")
        done = found if done is None else done.unionByName(found)
        if r >= reach:
            return done
        on = [*keys, left_id]
        before = todo
        todo = staged(todo.join(found.withColumnRenamed(f"a_{left_id}", left_id).select(*on).hint("merge"), on, "left_anti"), "searching")
        if before is not left:
            drop_staged(before)
        if not todo.limit(1).count():
            return done
        r = 2 * r if max_distance is None else min(2 * r, reach)


def pair_band(points: DataFrame, low: float | None, high: float | None, keys: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """Pairs a < b by id with low < d < high; a bound of None is open."""
    pairs = within(points, points, high, keys) if high is not None else pairs_within_keys(points, points, keys)
    ok = F.col(f"a_{id_col}") < F.col(f"b_{id_col}")
    if low is not None:
        ok = ok & (F.col("d") > F.lit(float(low)))
    if high is not None:
        ok = ok & (F.col("d") < F.lit(float(high)))
    return pairs.filter(ok)


def in_open_band(c: str, low: float, high: float) -> Column:
    return (F.col(c) > low) & (F.col(c) < high)


def overlap_survivors(spheres: DataFrame, max_radius: float, keys: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """Spheres (x, y, z, r) that no larger sphere overlaps; among equals the lesser id counts as larger.

    A sphere that is itself dropped still drops others, so the result does
    not depend on order. max_radius bounds r: the cells' side is twice that.
    """
    pairs = within(spheres, spheres, 2 * max_radius, keys)
    larger = (F.col("b_r") > F.col("a_r")) | ((F.col("b_r") == F.col("a_r")) & (F.col(f"b_{id_col}") < F.col(f"a_{id_col}")))
    hit = pairs.filter(larger & (F.col("d") < F.col("a_r") + F.col("b_r"))).select(*keys, F.col(f"a_{id_col}").alias(id_col)).distinct()
    return spheres.join(hit, [*keys, id_col], "left_anti")


def clashes(points: DataFrame, radius: float, keys: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """Pairs closer than radius, strictly."""
    return pair_band(points, None, radius, keys, id_col)


def contact_sites(surface: DataFrame, cloud: DataFrame, r: float, keys: Sequence[str], owner: str) -> DataFrame:
    """Mean surface point within r of any cloud point of each owner, counted once for each cloud point."""
    p = within(cloud, surface, r, keys)
    return p.groupBy(*keys, F.col(f"a_{owner}").alias(owner)).agg(
        F.avg("b_x").alias("x"), F.avg("b_y").alias("y"), F.avg("b_z").alias("z"), F.count(F.lit(1)).alias("n")
    )


def contact_gate(pre: DataFrame, post: DataFrame, low: float, high: float, keys: Sequence[str], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Active vertices of both sides, each with facing (outer if its normal opposes its neighbour's, else inner).

    Pre vertices whose nearest post vertex is low to high away are active;
    post vertices whose nearest active pre vertex is. Columns nx, ny, nz are
    the normals. Both bounds belong to the band.
    """

    def gate(these: DataFrame, those: DataFrame) -> DataFrame:
        near = nearest(these, those, keys, id_col, id_col, ["nx", "ny", "nz"], max_distance=high)
        hit = near.filter(F.col("d") >= low).withColumnRenamed(f"a_{id_col}", id_col)
        dot = F.col("nx") * F.col("b_nx") + F.col("ny") * F.col("b_ny") + F.col("nz") * F.col("b_nz")
        joined = these.join(hit, [*keys, id_col])
        return joined.withColumn("facing", F.when(dot < 0, "outer").otherwise("inner")).select(*these.columns, "facing", F.col("d").alias("gap"))

    active_pre = gate(pre, post)
    return active_pre, gate(post, active_pre.select(*pre.columns))


def faces_inside(faces: DataFrame, active: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Faces (v0, v1, v2) all of whose vertices are active."""
    out = faces
    for v in ("v0", "v1", "v2"):
        out = out.join(active.select(*keys, F.col(id_col).alias(v)).distinct(), [*keys, v], "left_semi")
    return out.select(*faces.columns)


def betweenness(points: DataFrame, pre: DataFrame, post: DataFrame, keys: Sequence[str], limit: float = 50.0, id_col: str = "id") -> DataFrame:
    """Points whose vectors to the nearest pre and post points oppose, with the lesser distance within the limit."""
    a = nearest(points, pre, keys, id_col, id_col, ["x", "y", "z"]).toDF(*keys, id_col, "_i", "px", "py", "pz", "dp")
    b = nearest(points, post, keys, id_col, id_col, ["x", "y", "z"]).toDF(*keys, id_col, "_j", "qx", "qy", "qz", "dq")
    on = [*keys, id_col]
    dot = sum(((F.col(f"p{k}") - F.col(k)) * (F.col(f"q{k}") - F.col(k)) for k in "xyz"), F.lit(0.0))
    return points.join(a, on).join(b, on).filter((dot < 0) & (F.least("dp", "dq") <= limit)).select(*points.columns)


def inside_hull(points: DataFrame, facets: DataFrame, keys: Sequence[str], id_col: str = "id", slack: float = 1e-6) -> DataFrame:
    """Points under all facets (nx, ny, nz, c) of their key's hull: n . p + c <= slack.

    A key's facets are one array row, so a point meets one row; a point with a
    null coordinate is in no hull, nor is one whose key has no facets.
    """
    held = facets.groupBy(*keys).agg(F.collect_list(F.struct("nx", "ny", "nz", "c")).alias("_facets"))
    under = F.forall("_facets", lambda f: f["nx"] * F.col("x") + f["ny"] * F.col("y") + f["nz"] * F.col("z") + f["c"] <= F.lit(float(slack)))
    return points.join(held, list(keys)).filter(under).select(*points.columns)


def cylinder_counts(vertices: DataFrame, particles: DataFrame, radius: float, keys: Sequence[str], length: float = 50.0, samples: int = 100, id_col: str = "id", per_receptor: float = 1.0, cross_section: float = 1.0) -> DataFrame:
    """Distinct particles within radius of a line from each vertex along its mean normal, with density and packing.

    The normal is the mean over vertices within the radius. Lines are sampled
    at equal steps from 0 to length. A line goes once to each cell around its
    samples, whatever their number, and a particle there is held against the
    sample nearest to it. A particle that is nowhere counts nowhere; a vertex
    without a normal has none.
    """
    near = within(vertices, vertices, radius, keys)
    normal = near.groupBy(*keys, F.col(f"a_{id_col}").alias(id_col), F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.col("a_z").alias("z")).agg(*[F.avg(f"b_n{k}").alias(f"m{k}") for k in "xyz"])
    size = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    step, r = length / (samples - 1), F.lit(float(radius))
    lines = normal.withColumn("_s", size).filter("_s > 0 AND _s < double('Infinity')")
    on = lambda k, i: F.col(k) + i * F.lit(step) * F.col(f"m{k}") / F.col("_s")
    cell = lambda i: F.struct(*[F.floor(on(k, i) / r).alias(k) for k in "xyz"])
    moves = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    beside = lambda c: F.array(*[F.struct(*[(c[k] + F.lit(m)).alias(k) for k, m in zip("xyz", d, strict=True)]) for d in moves])
    walked = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), cell))
    around = lines.withColumn("_c", F.explode(F.array_distinct(F.flatten(F.transform(walked, beside)))))
    around = around.select(*keys, id_col, *"xyz", *[f"m{k}" for k in "xyz"], "_s", *[F.col(f"_c.{k}").alias(f"_c{k}") for k in "xyz"])
    there = particles.select(*keys, F.col(id_col).alias("_b"), *[finite(k).alias(f"p{k}") for k in "xyz"]).dropna(subset=["px", "py", "pz"])
    there = there.select("*", *[F.floor(F.col(f"p{k}") / r).alias(f"_c{k}") for k in "xyz"])
    met = around.join(there, [*keys, "_cx", "_cy", "_cz"])
    along = sum(((F.col(f"p{k}") - F.col(k)) * F.col(f"m{k}") for k in "xyz"), F.lit(0.0)) / F.col("_s") / F.lit(step)
    met = met.withColumn("_i", F.least(F.greatest(F.round(along), F.lit(0.0)), F.lit(float(samples - 1))))
    gap = F.sqrt(sum(((on(k, F.col("_i")) - F.col(f"p{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    # a line meets a particle in the particle's one cell, so only repeated ids need their distinct pairs held
    repeated = any(df.groupBy(*keys, c).count().filter("count > 1").limit(1).count() for df, c in ((vertices, id_col), (there, "_b")))
    hits = met.filter(gap <= r).groupBy(*keys, id_col).agg((F.countDistinct("_b") if repeated else F.count("_b")).alias("n"))
    disc = 3.141592653589793 * radius * radius
    out = vertices.select(*keys, id_col).join(hits, [*keys, id_col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("density", F.col("n") / disc).withColumn("packing", F.col("n") / per_receptor * cross_section / disc)
