import numpy as np
import pytest

from pointloom.sources import binary, volumes


def voxels(df):
    return {(r["z"], r["y"], r["x"]): r["value"] for r in df.collect()}


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(1)
    a = r.normal(size=(9, 5, 7)).astype(np.float32)
    (tmp_path / "a.mrc").write_bytes(binary.mrc_bytes(a, 10.0))
    # big-endian shorts behind an extended header
    b = r.integers(-99, 99, (4, 3, 2))
    head = bytearray(binary.mrc_head((4, 3, 2), 13.5, 1))
    for at in (0, 4, 8, 12, 28, 32, 36, 40, 44, 48):
        head[at : at + 4] = head[at : at + 4][::-1]
    head[92:96], head[212:216] = (160).to_bytes(4, "big"), b"\x11\x11\0\0"
    (tmp_path / "b.mrc").write_bytes(bytes(head) + bytes(160) + b.astype(">i2").tobytes())
    (tmp_path / "notes.txt").write_text("no volume")
    return tmp_path, a, b


def test_volumes_of_a_folder(spark, folder):
    path, a, b = folder
    df = volumes.volumes(spark, str(path), 200)
    for name, v, nm in (("a", a, 1.0), ("b", b, 1.35)):
        one = df.filter(df["file"].endswith(f"/{name}.mrc"))
        assert voxels(one) == {k: float(x) for k, x in np.ndenumerate(v)}
        assert one.select("voxel_nm").distinct().first()[0] == pytest.approx(nm)
    assert df.rdd.getNumPartitions() == 9 + 1
    assert volumes.volumes(spark, str(path / "a*.mrc")).count() == a.size
    assert volumes.volumes(spark, str(path / "b.mrc")).count() == b.size
    (path / "none").mkdir()
    assert volumes.volumes(spark, str(path / "none")).count() == 0


@pytest.mark.parametrize(("cond", "slices"), [("z = 4", [4]), ("z >= 3 and z < 6", [3, 4, 5]), ("z in (0, 7, 99)", [0, 7]), ("z > 8", []), ("z between 2 and 3 and value > 0", [2, 3])])
def test_only_the_slab_is_read(spark, folder, cond, slices):
    path, a, _ = folder
    df = volumes.volumes(spark, str(path / "a.mrc"), 1).filter(cond)
    want = {(z, y, x): float(a[z, y, x]) for z in slices for y in range(5) for x in range(7) if "value" not in cond or a[z, y, x] > 0}
    assert voxels(df) == want
    # the rest of the file may as well not be there: its slices have no partition
    assert df.rdd.getNumPartitions() == max(1, len(slices))


def test_partitions_are_ranges_of_slices(folder):
    path, a, _ = folder
    reader = volumes.VolumeReader(str(path / "a.mrc"), 3 * 5 * 7 * 4)
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 2), (3, 5), (6, 8)]


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.2 GB: one slice is read, and nothing of the rest."""
    shape = (600, 1000, 1000)
    path = tmp_path / "big.mrc"
    with path.open("wb") as f:
        f.write(binary.mrc_head(shape, 1.0))
        f.truncate(1024 + 4 * 600 * 1000 * 1000)
        f.seek(1024 + 4 * 599 * 1000 * 1000)
        f.write(np.arange(1000, dtype="<f4").tobytes())
    df = volumes.volumes(spark, str(path)).filter("z = 599 and y = 0")
    assert df.selectExpr("sum(value)", "count(1)").first()[:] == (499500.0, 1000)
    assert len(volumes.VolumeReader(str(path), volumes.PARTITION).partitions()) == 150


def test_missing_and_cut_files(spark, folder):
    path, _, _ = folder
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        volumes.volumes(spark, str(path / "nowhere.mrc")).count()
    (path / "cut.mrc").write_bytes((path / "a.mrc").read_bytes()[:-30])
    with pytest.raises(Exception, match="ends in slice 8"):
        volumes.volumes(spark, str(path / "cut.mrc")).collect()


def test_written_volumes(spark, tmp_path):
    rows = [("p", 3, 1, 2, 5.0), ("p", 0, 0, 0, 1.0), ("p", 3, 1, 2, 4.0), ("q", 1, 1, 1, -2.0), ("q", 9, 0, 0, 7.0), (None, 0, 0, 0, 1.0), ("r", 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "file string, z int, y int, x int, value double")
    done = volumes.write_volumes(df, str(tmp_path / "out"), (5, 2, 3), 20.0)
    assert {r["key"] for r in done.collect()} == {"p", "q", "r"}
    assert not list((tmp_path / "out").glob(".*"))
    for name, want in (("p", {(3, 1, 2): 5.0, (0, 0, 0): 1.0}), ("q", {(1, 1, 1): -2.0}), ("r", {})):
        v, size = binary.mrc_array((tmp_path / "out" / f"{name}.mrc").read_bytes())
        assert v.shape == (5, 2, 3) and size == (20.0, 20.0, 20.0)
        assert {k: x for k, x in np.ndenumerate(v) if x} == want
