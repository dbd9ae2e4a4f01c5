import json
import struct

import numpy as np
import pytest

from pointloom.sources import binary, text



def star(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    labels = ["faCoordinateX", "faCoordinateY", "faCoordinateZ", "postsynapse"]
    body = "".join(" ".join(map(str, r)) + "\n" for r in rows)
    path.write_text("# made for a test\n\ndata_\n\nloop_\n" + "".join(f"_{n} #{i + 1}\n" for i, n in enumerate(labels)) + body + "\n")


def test_star_picks(spark, tmp_path):
    base = tmp_path / "s1" / "TOP_TOMOS" / "t1" / "al" / "picks"
    star(base / "pick_0_x.star", [(1.5, 2, 3, "False"), (4, 5, "nan", "True")])
    star(base / "pick_7_x.star", [(7, 8, 9, "True")])
    p = text.picks(spark, str(base / "*.star"), "pick_*_x.star")
    rows = sorted((r["cleft"], r["particle_idx"], r["x"], r["z"], r["extras"]["postsynapse"], r["set_name"], r["tomogram_name"], r["alignment_dir"]) for r in p.collect() if r["z"] is not None)
    assert rows == [(0, 0, 1.5, 3.0, "False", "s1", "t1", "al"), (7, 0, 7.0, 9.0, "True", "s1", "t1", "al")]
    assert text.picks(spark, str(base / "*.star"), "pick_*_x.star", [7]).count() == 1
    (base / "other.star").write_bytes(b"\xff\xfe not a loop")
    one = text.picks(spark, str(base / "*.star"), "pick_*_x.star", [7])
    assert one.count() == 1 and one.rdd.getNumPartitions() <= 1  # one file of three is listed
    both = text.two_kinds(p.filter("cleft = 0"), p.filter("cleft = 7"))
    assert {r["aunp_kind"] for r in both.collect()} == {"monomer", "dimer"}


def test_manifest(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text('tomoname,set,alignment_dir,cleft_IDs\na,s1,al,"0,2"\nb,s2,al,\n')
    assert [tuple(r) for r in text.manifest(spark, str(f)).collect()] == [("a", "s1", "al", [0, 2]), ("b", "s2", "al", None)]
    assert text.manifest(spark, str(f), "s2").count() == 1
    f.write_text("tomoname,set\na,b\n")
    with pytest.raises(ValueError):
        text.manifest(spark, str(f))


def test_xyz_and_pdb(spark, tmp_path):
    (tmp_path / "cloud_3.txt").write_text("1 2 3\n\n# no\n4.5 5 6e1\n")
    assert [(r["segment"], r["x"], r["z"]) for r in text.xyz(spark, str(tmp_path / "cloud_3.txt")).orderBy("point_idx").collect()] == [(3, 1.0, 3.0), (3, 4.5, 60.0)]
    (tmp_path / "a.pdb").write_text("ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00\nEND\n")
    assert [(r["x"], r["y"], r["z"]) for r in text.pdb_atoms(spark, str(tmp_path / "a.pdb")).collect()] == [(11.104, 6.134, -6.504)]


def glb(v, f):
    blob = np.asarray(v, "<f4").tobytes() + np.asarray(f, "<u4").tobytes()
    doc = json.dumps(
        {
            "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
            "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(v), "type": "VEC3"}, {"bufferView": 1, "componentType": 5125, "count": 3 * len(f), "type": "SCALAR"}],
            "bufferViews": [{"byteLength": 12 * len(v)}, {"byteOffset": 12 * len(v), "byteLength": 12 * len(f)}],
        }
    ).encode()
    doc += b" " * (-len(doc) % 4)
    body = struct.pack("<I4s", len(doc), b"JSON") + doc + struct.pack("<I4s", len(blob), b"BIN\0") + blob
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def test_meshes(spark, tmp_path):
    (tmp_path / "m.glb").write_bytes(glb([(0, 1, 2), (1, 0, 0), (0, 0, 1)], [(0, 1, 2)]))
    v = binary.glb_vertices(spark, str(tmp_path / "m.glb")).orderBy("id").collect()
    assert (v[0]["x"], v[0]["y"], v[0]["z"]) == (0.0, -20.0, 10.0)
    assert binary.glb_faces(spark, str(tmp_path / "m.glb")).count() == 1
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    points, faces = binary.ply_mesh(spark, str(tmp_path / "m.ply"))
    assert points.count() == 4 and faces.count() == 2


def test_volume(spark, tmp_path):
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, 2, 3, 4, 2)
    struct.pack_into("<3i", head, 28, 2, 3, 4)
    struct.pack_into("<3f", head, 40, 20.0, 30.0, 40.0)
    (tmp_path / "v.mrc").write_bytes(bytes(head) + np.arange(24, dtype="<f4").tobytes())
    rows = binary.mrc_voxels(spark, str(tmp_path / "v.mrc")).collect()
    assert len(rows) == 24 and all(r["value"] == r["z"] * 6 + r["y"] * 2 + r["x"] for r in rows) and rows[0]["voxel_nm"] == 1.0


def test_cleft_surfaces(spark, tmp_path):
    base = tmp_path / "s" / "TOP_TOMOS" / "t" / "al" / "cleft"
    base.mkdir(parents=True)
    for name, n in (("a_pre_outer", 2), ("a_post_outer", 3), ("a_post_inner", 1), ("b_pre_outer", 2), ("b_pre_inner", 2)):
        (base / f"{name}.txt").write_text("".join(f"{i} 1 2\n" for i in range(n)))
    rows = text.cleft_surfaces(spark, str(base / "*.txt")).groupBy("zone", "side", "facing").count().collect()
    assert sorted(map(tuple, rows)) == [("a", "post", "inner", 1), ("a", "post", "outer", 3), ("a", "pre", "outer", 2)]
    assert text.cleft_surfaces(spark, str(base / "*.txt"), ("outer",)).filter("set_name = 's' and tomogram_name = 't'").count() == 5


def test_optional_and_cached_tables(spark, tmp_path):
    assert text.optional_csv(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    (tmp_path / "t.csv").write_text("a\n1\n")
    assert text.optional_csv(spark, str(tmp_path / "t.csv"), "a int").first()["a"] == 1
    calls = []
    made = lambda: calls.append(1) or spark.range(3)
    assert [text.cached_table(spark, str(tmp_path / "c"), t, made).count() for t in (10, 10, 20)] == [3, 3, 3] and len(calls) == 2


def test_results_and_missing_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"name": "a", "n": NaN, "s": 2.5}')
    (tmp_path / "r" / "b.json").write_text("{broken")
    rows = sorted(((r["name"], r["n"], r["s"]) for r in text.results(spark, str(tmp_path / "r"), "name string, n double, s double").collect()), key=str)
    assert ("a", None, 2.5) in rows
    b = text.longest_base(spark.createDataFrame([("abc_1",), ("ab_2",), ("x",)], "name string"), spark.createDataFrame([("ab",), ("abc",)], "base string"))
    assert sorted(map(tuple, b.collect())) == [("ab_2", "ab"), ("abc_1", "abc")]


def test_binary_meshes_and_volumes(spark, tmp_path):
    v = np.arange(15, dtype="<f4").reshape(5, 3)
    f = np.array([[0, 1, 2], [2, 3, 4]], "<i4")
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 5\nproperty float x\nproperty float y\nproperty float z\nelement face {}\nproperty list uchar int vertex_indices\nend_header\n"
    same = head.format(2).encode() + v.tobytes() + b"".join(b"\x03" + r.tobytes() for r in f)
    p, t = binary.ply_arrays(same)
    assert p.tolist() == v.tolist() and t.tolist() == f.tolist()
    mixed = head.format(2).encode() + v.tobytes() + b"\x03" + f[0].tobytes() + b"\x04" + np.array([0, 1, 2, 3], "<i4").tobytes()
    assert binary.ply_arrays(mixed)[1].tolist() == [[0, 1, 2], [0, 1, 2], [0, 2, 3]]
    a = np.arange(24, dtype=float).reshape(4, 3, 2)
    back, size = binary.mrc_array(binary.mrc_bytes(a, 13.5))
    assert back.tolist() == a.tolist() and size == pytest.approx((13.5, 13.5, 13.5))
    rows = [("v", z, y, x, float(a[z, y, x])) for z in range(4) for y in range(3) for x in range(2)]
    made = binary.mrc_files(spark.createDataFrame(rows, "file string, z int, y int, x int, value double"), 10.0).first()
    assert binary.mrc_array(bytes(made["content"]))[0].tolist() == a.tolist()


def test_curve_artifacts(spark, tmp_path):
    np.savez_compressed(tmp_path / "c.npz", r_vals=np.array([1.0, 2.0]), zone_name=np.array("z"), tomogram_name=np.array("t"), fusion=np.array([[1.0, 2.0], [3.0, 4.0]]), empty=np.zeros((0, 2)))
    rows = binary.curve_artifacts(spark, str(tmp_path / "c.npz")).collect()
    assert sorted((r["zone_name"], r["tomogram_name"], r["name"], r["curve"], r["r"], r["value"]) for r in rows) == [("z", "t", "fusion", 0, 1.0, 1.0), ("z", "t", "fusion", 0, 2.0, 2.0), ("z", "t", "fusion", 1, 1.0, 3.0), ("z", "t", "fusion", 1, 2.0, 4.0)]
