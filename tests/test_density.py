import numpy as np
import pytest

from pointloom.operators import nulls
from pointloom.plans import analyses


def test_controls_against_brute_force(spark):
    rng = np.random.default_rng(4)
    grid = [(x, y) for x in range(0, 60, 6) for y in range(0, 60, 6)]
    surface = [("a", i, x + 0.1 * i % 1, float(y), float(3 * np.sin(x / 15)), *map(float, rng.normal([0, 0, 1], 0.1))) for i, (x, y) in enumerate(grid)]
    particles = [("a", 1000 + i, *map(float, q)) for i, q in enumerate(rng.uniform([0, 0, 0], [60, 60, 40], (80, 3)))] + [("a", 2000, float("nan"), 1.0, 1.0), ("a", 2001, None, 1.0, 1.0)]
    sites = [("a", 5000 + i, *map(float, q)) for i, q in enumerate(rng.uniform([10, 10, -1], [50, 50, 3], (4, 3)))]
    at = "zone string, id long, x double, y double, z double"
    s, p, f = spark.createDataFrame(sites, at), spark.createDataFrame(particles, at), spark.createDataFrame(surface, at + ", nx double, ny double, nz double")
    how = {"snap_limit": 6.0}
    got = analyses.density_controls(s, p, f, [8.0, 12.0], [10.0, 20.0], 5, length=30.0, samples=31, **how).collect()

    v = np.array([r[2:5] for r in surface])
    n = np.array([r[5:8] for r in surface])
    q = np.array([r[2:5] for r in particles[:80]])
    nearest = lambda x: int(np.linalg.norm(v - x, axis=1).argmin())
    density = {}
    for radius in (8.0, 12.0):
        for i in range(len(v)):
            m = n[np.linalg.norm(v - v[i], axis=1) <= radius].mean(0)
            line = v[i] + np.linspace(0, 30, 31)[:, None] * m / np.linalg.norm(m)
            density[radius, i] = (np.linalg.norm(q[:, None] - line[None], axis=2).min(1) <= radius).sum() / (np.pi * radius**2)
    want = {}
    for o in (10.0, 20.0):
        for r in nulls.shifted_sites(s, f, 5, o, "zone", **how).collect():
            for radius in (8.0, 12.0):
                want.setdefault((r["id"], radius, o), []).append(density[radius, nearest([r["x"], r["y"], r["z"]])])
    real = {(i, radius): density[radius, nearest(x)] for _, i, *x in sites for radius in (8.0, 12.0)}
    assert {(r["id"], r["radius"], r["offset"]): (r["n_controls"], pytest.approx(r["control"]), pytest.approx(r["real"])) for r in got} == {
        k: (len(c), np.mean(c), real[k[:2]]) for k, c in want.items()
    }
    assert len(got) >= 12 and any(real.values())


def test_no_row_for_a_control(spark, monkeypatch):
    # controls are averaged where they are moved: no site in a replicate, no search for its surface point
    monkeypatch.setattr(nulls, "shifted_sites", None)
    s = spark.range(40).selectExpr("0 AS zone", "id", "id % 8D * 3 AS x", "floor(id / 8D) * 3D AS y", "0D AS z", "0D AS nx", "0D AS ny", "1D AS nz")
    got = analyses.density_controls(s, s, s, [5.0], [6.0], 4, length=6.0, samples=4).collect()
    assert got and all(0 < r["n_controls"] <= 4 and r["control"] > 0 for r in got)
