import heapq

import numpy as np
import pandas as pd
import pytest

from pointloom.operators import geodesic

K = ["zone"]


def sheet(spark):
    """A bumpy sheet in zone a, two separate patches in zone b, and rows that belong to no mesh."""
    rng = np.random.default_rng(5)
    one = pd.DataFrame({"zone": "a", "x": rng.uniform(0, 70, 300), "y": rng.uniform(0, 50, 300)})
    far = pd.DataFrame({"zone": "b", "x": np.r_[rng.uniform(0, 30, 60), rng.uniform(300, 330, 60)], "y": rng.uniform(0, 30, 120)})
    p = pd.concat([one, far], ignore_index=True)
    p["z"] = 5 * np.sin(p["x"] / 9) + rng.normal(0, 1, len(p))
    p["id"] = np.arange(len(p))
    odd = pd.DataFrame({"zone": ["a", None, "a"], "x": [np.nan, 1.0, np.inf], "y": 1.0, "z": 1.0, "id": [900, 901, 902]})
    return p, spark.createDataFrame(pd.concat([p, odd], ignore_index=True), "zone string, x double, y double, z double, id long")


def dijkstra(edges, source, reach):
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for w, length in edges.get(v, ()):
            if d + length <= reach and d + length < best.get(w, np.inf):
                best[w] = d + length
                heapq.heappush(heap, (d + length, w))
    return best


def test_paths_and_rings_against_brute_force(spark):
    p, df = sheet(spark)
    v, f = geodesic.lattice_mesh(df, 10.0, K)
    vert, face = v.toPandas(), f.toPandas()
    assert vert["n"].sum() == len(p) and set(vert["zone"]) == {"a", "b"}
    edges = geodesic.mesh_edges(v, f, K)
    nets = {}
    for r in edges.collect():
        nets.setdefault(r["zone"], {}).setdefault(r["a"], []).append((r["b"], r["length"]))
    where = {(r.zone, r.id): np.array([r.x, r.y, r.z]) for r in vert.itertuples()}
    assert all(length == pytest.approx(np.linalg.norm(where[z, a] - where[z, b])) for z, net in nets.items() for a, to in net.items() for b, length in to)
    area = {}
    for r in face.itertuples():
        a, b, c = (where[r.zone, i] for i in (r.v0, r.v1, r.v2))
        for i in (r.v0, r.v1, r.v2):
            area[r.zone, i] = area.get((r.zone, i), 0.0) + np.linalg.norm(np.cross(b - a, c - a)) / 6
    areas = geodesic.vertex_areas(v, f, K)
    assert {(r["zone"], r["id"]): r["area"] for r in areas.collect()} == pytest.approx(area)

    near = {}
    for r in p.itertuples():
        mine = vert[vert["zone"] == r.zone]
        near[r.zone, r.id] = int(mine["id"].iloc[((mine[["x", "y", "z"]].to_numpy() - [r.x, r.y, r.z]) ** 2).sum(1).argmin()])
    snapped = spark.createDataFrame([(z, int(i), at) for (z, i), at in near.items()], "zone string, id long, vertex long")
    paths = geodesic.geodesics(edges, snapped.selectExpr("zone", "vertex AS source"), 45.0, K)
    got = {(r["zone"], r["source"], r["vertex"]): r["d"] for r in paths.collect()}
    want = {(z, s, w): d for z, s in {(z, at) for (z, _), at in near.items()} for w, d in dijkstra(nets.get(z, {}), s, 45.0).items()}
    assert got == pytest.approx(want)
    assert len({z for z, *_ in want}) == 2

    rng = np.random.default_rng(6)
    rows = [(z, rep, int(i), bool(rng.random() < 0.4)) for rep in (-1, 0, 1) for z, i in near]
    rows = [r if r[0] == "a" or r[1] != 1 else (*r[:3], False) for r in rows]  # no starts in one replicate of b
    labels = spark.createDataFrame(rows, "zone string, rep int, id long, is_first boolean")
    step, last = 9.0, 5
    n, size = {}, {}
    for rep in (-1, 0, 1):
        of = {(z, i): first for z, r, i, first in rows if r == rep}
        for (z, i), first in of.items():
            if not first:
                continue
            for (y, s, w), d in want.items():
                if (y, s) == (z, near[z, i]) and (b := int(d // step) + 1) <= last:
                    size[z, rep, b] = size.get((z, rep, b), 0.0) + area.get((z, w), 0.0)
                    n[z, rep, b] = n.get((z, rep, b), 0) + sum(1 for (q, j), other in of.items() if q == z and not other and near[q, j] == w)
    curve = geodesic.ring_curves(paths, areas, snapped, labels, step, step * last, K).collect()
    assert {(r["zone"], r["rep"], r["bin"]): (r["n"], pytest.approx(r["area"])) for r in curve} == {k: (n[k], size[k]) for k in size}
    for r in curve:
        whole = sum(a for (z, _), a in area.items() if z == r["zone"])
        targets = sum(1 for z, rep, _, first in rows if (z, rep) == (r["zone"], r["rep"]) and not first)
        assert r["o"] == pytest.approx(r["n"] / r["area"]) and r["g"] == pytest.approx(r["o"] * whole / targets)


def test_empty_meshes_and_lone_vertices(spark):
    none = spark.createDataFrame([], "zone string, x double, y double, z double, id long")
    v, f = geodesic.lattice_mesh(none, 5.0, K)
    assert v.count() == f.count() == geodesic.mesh_edges(v, f, K).count() == geodesic.vertex_areas(v, f, K).count() == 0
    lone = spark.createDataFrame([("a", 1.0, 1.0, 0.0, 1), ("a", 2.0, 2.0, 0.0, 2)], none.schema)
    v, f = geodesic.lattice_mesh(lone, 5.0, K)
    sources = v.selectExpr("zone", "id AS source").union(spark.createDataFrame([("a", None)], "zone string, source long"))
    assert [(r["d"], r["source"] == r["vertex"]) for r in geodesic.geodesics(geodesic.mesh_edges(v, f, K), sources, 10.0, K).collect()] == [(0.0, True)]
