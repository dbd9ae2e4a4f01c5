import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import ripley
from pointloom.plans import analyses


def test_sets_on_the_same_places_count_once(spark, monkeypatch):
    # many sets of sites on few places: a place meets the particles once, chunks of a few points, null and copied sites
    rng = np.random.default_rng(5)
    x, q = rng.uniform(0, 20, (12, 3)), rng.uniform(0, 20, (50, 3))
    monkeypatch.setattr(ripley, "CHUNK", 7)
    particles = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(q)], "zone int, id long, x double, y double, z double")
    rows = [(0, "a", rep, i, *map(float, x[(i * (rep + 2)) % 12])) for rep in range(6) for i in range(9)] + [(0, "b", -1, 77, None, 1.0, 1.0), (0, "b", -1, 78, *map(float, x[0]))]
    sets = spark.createDataFrame(rows, "zone int, comparison string, rep int, id long, x double, y double, z double")
    volume = ripley.volumes(particles, ["zone"])
    foci = sets.select("zone", F.struct("comparison", "rep", "id").alias("id"), "x", "y", "z")
    p = {(*r["id"], r["bin"]): r["p"] for r in ripley.box_edge_factors(foci, particles, 2.0, 2.0, 8.0, ["zone"]).collect()}
    monkeypatch.setattr(ripley, "focus_counts", None)
    got = {(r["comparison"], r["rep"], r["bin"]): (r["n_sites"], r["k"]) for r in analyses.site_curves(sets, particles, volume, particles, 2.0, 2.0, 8.0).collect()}
    v = volume.first()["volume"]
    assert len(got) == 7 * 4
    for (comparison, rep, b), (n, k) in got.items():
        mine = [r for r in rows if r[1:3] == (comparison, rep)]
        w = sum((np.linalg.norm(q - np.array(r[4:]), axis=1) < 2.0 * b).sum() / p[(*r[1:4], b)] for r in mine if r[4] is not None)
        assert n == len(mine) and k == pytest.approx(v / (n * len(q)) * w)
