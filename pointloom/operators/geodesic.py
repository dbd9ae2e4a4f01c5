"""Paths along a triangle mesh, and curves of points on it by ring.

A mesh is vertices (keys, id, x, y, z) and faces (keys, v0, v1, v2). A
distance is the length of the shortest path over edges: never under that over
the surface, and the nearer to it the finer the mesh. Rows with a null
coordinate, id or key belong to no mesh.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..staging import drop_staged, staged
from .fields import cell_number


def lattice_mesh(points: DataFrame, side: float, keys: Sequence[str], plane: Sequence[str] = ("x", "y")) -> tuple[DataFrame, DataFrame]:
    """A coarse mesh of a sheet of points that a plane can show: vertices, with n, and faces.

    The plane is cut into squares of a side; a vertex is the mean of the
    points of a square, faces join vertices of adjacent squares. All points
    count, and no task sees more than four squares of a face. For a sheet
    that lies otherwise, give the coordinates of its principal frame as plane.
    """
    k = list(keys)
    at = points.withColumns({c: finite(c) for c in "xyz"}).filter(" AND ".join(f"{c} IS NOT NULL" for c in [*k, *"xyz"]))
    cell = [F.floor(F.col(c) / F.lit(float(side))).cast("int").alias(n) for c, n in zip(plane, ("_i", "_j"), strict=True)]
    means = at.select(*k, *"xyz", *cell).groupBy(*k, "_i", "_j").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))
    vertices = staged(means.withColumn("id", cell_number(("_i", "_j"))), "vertices")
    squares = F.array(*[F.struct((F.col("_i") - a).alias("i"), (F.col("_j") - b).alias("j"), F.lit(2 * a + b).alias("c")) for a in (0, 1) for b in (0, 1)])
    corner = vertices.select(*k, "id", F.explode(squares).alias("s")).groupBy(*k, "s.i", "s.j").agg(*[F.max(F.when(F.col("s.c") == c, F.col("id"))).alias(f"c{c}") for c in range(4)])
    two = F.array(F.array("c0", "c2", "c3"), F.array("c0", "c3", "c1"))
    one = F.array(F.array_compact(F.array("c0", "c2", "c3", "c1")))
    whole = corner.withColumn("_n", sum((F.col(f"c{c}").isNotNull().cast("int") for c in range(4)), F.lit(0))).filter("_n >= 3")
    faces = whole.select(*k, F.explode(F.when(F.col("_n") == 4, two).otherwise(one)).alias("f"))
    return vertices.select(*k, "id", *"xyz", "n"), faces.select(*k, *[F.col("f")[i].alias(f"v{i}") for i in range(3)])


def mesh_edges(vertices: DataFrame, faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, a, b, length: each edge once in either direction."""
    k = list(keys)
    ends = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"), ("v1", "v0"), ("v2", "v1"), ("v0", "v2"))])
    edges = faces.select(*k, F.explode(ends).alias("e")).select(*k, "e.a", "e.b").filter("a <> b").distinct()
    side = lambda n: vertices.select(*k, F.col("id").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    met = edges.join(side("a"), [*k, "a"]).join(side("b"), [*k, "b"])
    return met.select(*k, "a", "b", F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0))).alias("length"))


def vertex_areas(vertices: DataFrame, faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, id, area: a third of the faces around each vertex; a vertex without faces has none."""
    k, met = list(keys), faces
    for i in range(3):
        met = met.join(vertices.select(*k, F.col("id").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]), [*k, f"v{i}"])
    u, w = ({c: F.col(f"{c}{i}") - F.col(f"{c}0") for c in "xyz"} for i in (1, 2))
    cross = [u[p] * w[q] - u[q] * w[p] for p, q in (("y", "z"), ("z", "x"), ("x", "y"))]
    third = F.sqrt(sum((c * c for c in cross), F.lit(0.0))) / 6.0
    return met.select(*k, F.explode(F.array("v0", "v1", "v2")).alias("id"), third.alias("area")).groupBy(*k, "id").agg(F.sum("area").alias("area"))


def geodesics(edges: DataFrame, sources: DataFrame, reach: float, keys: Sequence[str]) -> DataFrame:
    """keys, source, vertex, d: vertices at most `reach` along edges from each source (keys, source), itself included.

    In a round the vertices that came nearer in the one before pass their
    distance on over their edges; one join and one grouping a round, each
    round a staged table. Work is bounded by the discs of the sources, not by
    the mesh. Repeated sources count once.
    """
    k = list(keys)
    edges = staged(edges.select(*k, F.col("a").alias("vertex"), "b", "length").filter(F.col("length") <= F.lit(float(reach))), "edges")
    first = sources.select(*k, "source").filter(" AND ".join(f"{c} IS NOT NULL" for c in [*k, "source"])).distinct()
    known = staged(first.select(*k, "source", F.col("source").alias("vertex"), F.lit(0.0).alias("d"), F.lit(0).alias("round")), "paths")
    at = 0
    while known.filter(F.col("round") == at).limit(1).count():
        at += 1
        passed = known.filter(F.col("round") == at - 1).join(edges, [*k, "vertex"])
        longer = passed.select(*k, "source", F.col("b").alias("vertex"), (F.col("d") + F.col("length")).alias("d"), F.lit(at).alias("round")).filter(F.col("d") <= F.lit(float(reach)))
        best = known.unionByName(longer).groupBy(*k, "source", "vertex").agg(F.min(F.struct("d", "round")).alias("_m"))
        new = staged(best.select(*k, "source", "vertex", "_m.d", "_m.round"), "paths")
        drop_staged(known)
        known = new
    drop_staged(edges)
    return known.drop("round")


#: Tasks that sum one ring of a key, and rings that a task holds before it puts out their sums.
DEALT, HELD = 8, 2000


def _bin(step: float):
    return (F.floor(F.col("d") / F.lit(float(step))) + 1).cast("int").alias("bin")


def ring_curves(paths: DataFrame, areas: DataFrame, points: DataFrame, labels: DataFrame, step: float, r_max: float, keys: Sequence[str]) -> DataFrame:
    """keys, rep, bin, r, n, area, o, g for every replicate of labels and each ring from r - step to r.

    points: keys, id, vertex; labels: keys, rep, id, is_first, each replicate
    of a key over the same points. n counts targets (not first) in the rings
    of all starts (first), area sums those rings: o = n / area is Ripley's O,
    the mean density of targets at that distance, g = o over the targets'
    density on the whole mesh. paths must hold the discs of all points'
    vertices up to r_max. An empty ring has neither o nor g; a replicate
    without starts has no rows.

    Starts and targets of a vertex are counted for all replicates in one
    array; what a path joins are two such arrays, so neither the number of
    points on a vertex nor that of replicates multiplies the rows.
    """
    k, last = list(keys), int(r_max / step + 0.5)
    near = staged(paths.withColumn("bin", _bin(step)).filter(F.col("bin") <= last), "rings")
    tally = labels.join(points.select(*k, "id", "vertex"), [*k, "id"]).groupBy(*k, "vertex", "rep").agg(F.count_if("is_first").cast("int").alias("s"), F.count_if(~F.col("is_first")).cast("int").alias("t"))
    in_order = F.array_sort(F.collect_list(F.struct("rep", "s", "t")))
    held = staged(tally.groupBy(*k, "vertex").agg(in_order.alias("_l")).select(*k, "vertex", F.col("_l.rep").alias("reps"), F.col("_l.s").alias("s"), F.col("_l.t").alias("t")), "tallies")
    starts = held.select(*k, F.col("vertex").alias("source"), "reps", "s")
    pairs = near.join(held.select(*k, "vertex", "t"), [*k, "vertex"]).join(starts, [*k, "source"]).select(*k, "bin", "source", "reps", "s", "t", F.lit(0.0).alias("area"))
    rings = near.join(areas.withColumnRenamed("id", "vertex"), [*k, "vertex"]).groupBy(*k, "source", "bin").agg(F.sum("area").alias("area"))
    rings = rings.join(starts, [*k, "source"]).select(*k, "bin", "source", "reps", "s", F.transform("s", lambda v: v * 0).alias("t"), "area")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sums: dict[tuple, list] = {}
        fields = None

        def table() -> pa.RecordBatch:
            out = []
            for group, (reps, n, area) in held_sums.items():
                out.append(pd.DataFrame({**dict(zip((*k, "bin"), group, strict=True)), "rep": reps, "n": n, "area": area}))
            held_sums.clear()
            return pa.RecordBatch.from_pandas(pd.concat(out), pa.schema([*fields, ("rep", pa.int32()), ("n", pa.int64()), ("area", pa.float64())]), preserve_index=False)

        for b in batches:
            if not b.num_rows:
                continue
            fields = [b.schema.field(c) for c in (*k, "bin")]
            groups = b.select([*k, "bin"]).to_pandas().reset_index(drop=True)
            s, t, reps, area = b.column("s"), b.column("t"), b.column("reps"), b.column("area").to_numpy()
            for rows in groups.groupby([*k, "bin"], dropna=False).indices.values():
                take, width = pa.array(rows), len(reps[int(rows[0])])
                of_s, of_t = (c.take(take).flatten().to_numpy().reshape(len(rows), width).astype(np.int64) for c in (s, t))
                sums = held_sums.setdefault(tuple(groups.iloc[rows[0]]), [reps[int(rows[0])].as_py(), 0, 0.0])
                sums[1], sums[2] = sums[1] + (of_s * of_t).sum(0), sums[2] + (of_s * area[rows, None]).sum(0)
            if len(held_sums) > HELD:
                yield table()
        if held_sums:
            yield table()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*k, "bin").schema)
    # a ring of a key is summed in DEALT tasks, whatever the number of partitions before
    dealt = pairs.unionByName(rings).withColumn("_deal", F.pmod(F.xxhash64("source"), F.lit(DEALT))).repartition(*k, "bin", "_deal").drop("source", "_deal")
    parts = dealt.mapInArrow(summed, f"{kinds}, rep int, n long, area double")
    whole = areas.groupBy(*k).agg(F.sum("area").alias("_all"))
    each = held.select(*k, F.explode(F.arrays_zip("reps", "t")).alias("e"))
    of = each.groupBy(*k, F.col("e.reps").alias("rep")).agg(F.sum("e.t").alias("_targets"))
    curve = parts.groupBy(*k, "rep", "bin").agg(F.sum("n").alias("n"), F.sum("area").alias("area")).join(of, [*k, "rep"]).join(whole, k).filter("area > 0 OR n > 0")
    o = F.when(F.col("area") > 0, F.col("n") / F.col("area"))
    return curve.select(*k, "rep", "bin", (F.col("bin") * F.lit(float(step))).alias("r"), "n", "area", o.alias("o"), F.try_divide(o * F.col("_all"), F.col("_targets")).alias("g"))
