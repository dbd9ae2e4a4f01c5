import numpy as np
from pyspark.sql import functions as F

from pointloom.operators import raster, spatial


def test_bounded_search_by_doubling_cells(spark, monkeypatch):
    # Many points in reach of each other: cells grow from the points' spacing, up to the bound and no further.
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 3, (150, 3)), 1)
    x[140:] += 30
    rows = [(i % 2, i, *map(float, v)) for i, v in enumerate(x)]
    p = spark.createDataFrame(rows, "zone int, id long, x double, y double, z double")
    a, b = p.filter("id % 3 = 0"), p.filter("id % 3 <> 0")
    radii, real = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda left, right, r, *how: radii.append(r) or real(left, right, r, *how))
    for bound in (0.4, 4.0, 100.0):
        monkeypatch.setattr(spatial, "DIRECT_PAIRS", 10**9)
        want = sorted(map(tuple, spatial.nearest(a, b, ["zone"], max_distance=bound).collect()))
        monkeypatch.setattr(spatial, "DIRECT_PAIRS", 0)
        radii.clear()
        got = sorted(map(tuple, spatial.nearest(a, b, ["zone"], max_distance=bound).collect()))
        assert got == want and max(radii) <= bound and (bound < 100 or radii[0] < bound)
    refs = p.filter("id % 4 < 3").select("x", "y", "z", (F.col("id") % 5).alias("label"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("priority"))
    held = refs.collect()
    for got in (raster.labelled(p, refs, 2.5).collect(), raster.labelled(p, refs.limit(0), 2.5).collect()):
        some = held if any(r["label"] for r in got) else []
        for r in got:
            near = [(q["priority"] or 0, d, q["label"]) for q in some if (d := float(np.sqrt(((r["x"] - q["x"]) ** 2 + (r["y"] - q["y"]) ** 2) + (r["z"] - q["z"]) ** 2))) <= 2.5]
            assert r["label"] == (min(near)[2] if near else 0)


def test_lines_count_particles_without_holding_pairs(spark):
    v = spark.createDataFrame([(0, i, float(i), 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(4)], "zone int, id long, x double, y double, z double, nx double, ny double, nz double")
    rows = [(0, 10 + i, i % 4 + 0.1, 0.2, float(i)) for i in range(40)]
    twice = [*rows, (0, 10, 1.0, 0.0, 30.0), (0, 10, 1.0, 0.0, 30.0)]
    got = {}
    for name, part in (("once", rows), ("twice", twice)):
        p = spark.createDataFrame(part, "zone int, id long, x double, y double, z double")
        out = spatial.cylinder_counts(v, p, 1.5, ["zone"])
        got[name] = {r["id"]: r["n"] for r in out.collect()}
        for i in range(4):
            assert got[name][i] == len({q[1] for q in part if (q[2] - i) ** 2 + q[3] ** 2 <= 2.2})
    p = spark.createDataFrame(rows, "zone int, id long, x double, y double, z double")
    plan = spatial.cylinder_counts(v, p, 1.5, ["zone"])._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan
