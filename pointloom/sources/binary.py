"""Binary formats by the binaryFile source: GLB and PLY meshes, MRC volumes."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the public formats.
_GLTF = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
_MRC = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}
_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
AXES, SCALES = (0, 2, 1), (10.0, -10.0, 10.0)


def glb_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, faces and normals of all primitives of a GLB file, in its own frame; normals are zero where it has none."""
    magic, _, length = struct.unpack_from("<4sII", data)
    if magic != b"glTF":
        raise ValueError("not a GLB file")
    at, doc, blob = 12, None, b""
    while at < length:
        size, kind = struct.unpack_from("<I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"JSON":
            doc = json.loads(chunk)
        elif kind == b"BIN\0":
            blob = chunk
        at += 8 + size

    def accessor(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        v = doc["bufferViews"][a["bufferView"]]
        kind, width = np.dtype(_GLTF[a["componentType"]]), _WIDTH[a["type"]]
        start = v.get("byteOffset", 0) + a.get("byteOffset", 0)
        stride = v.get("byteStride", kind.itemsize * width)
        if stride == kind.itemsize * width:
            return np.frombuffer(blob, kind, a["count"] * width, start).reshape(a["count"], width)
        return np.stack([np.frombuffer(blob, kind, width, start + stride * k) for k in range(a["count"])])

    vertices, faces, normals, base = [], [], [], 0
    for mesh in doc.get("meshes", []):
        for p in mesh["primitives"]:
            v = accessor(p["attributes"]["POSITION"]).astype(float)
            n = accessor(p["attributes"]["NORMAL"]).astype(float) if "NORMAL" in p["attributes"] else np.zeros_like(v)
            f = accessor(p["indices"]).reshape(-1, 3).astype(int) if "indices" in p else np.arange(len(v)).reshape(-1, 3)
            vertices.append(v)
            normals.append(n)
            faces.append(f + base)
            base += len(v)
    cat = lambda x, d: np.concatenate(x) if x else np.zeros((0, 3), d)
    return cat(vertices, float), cat(faces, int), cat(normals, float)


def ply_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a PLY file (ascii or binary)."""
    end = data.index(b"end_header") + len(b"end_header")
    end = data.index(b"\n", end - 1) + 1
    lines = data[:end].decode("ascii").split("\n")
    form = next(line.split()[1] for line in lines if line.startswith("format"))
    elements: list[tuple[str, int, list[list[str]]]] = []
    for w in (line.split() for line in lines):
        if w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    order = "<" if "little" in form else ">"
    words, pos = (data[end:].split() if form == "ascii" else None), 0 if form == "ascii" else end
    vertices, faces = np.zeros((0, 3)), [np.zeros((0, 3), int)]
    for name, n, props in elements:
        lists = any(p[0] == "list" for p in props)
        if not lists and n:
            names = [p[-1] for p in props]
            if words is not None:
                rows = np.array(words[pos : pos + n * len(props)], float).reshape(n, len(props))
                pos += n * len(props)
            else:
                kind = np.dtype([(f"f{i}", order + _PLY[p[0]]) for i, p in enumerate(props)])
                got = np.frombuffer(data, kind, n, pos)
                rows = np.column_stack([got[f].astype(float) for f in kind.names])
                pos += n * kind.itemsize
            if name == "vertex":
                vertices = rows[:, [names.index(k) for k in "xyz"]]
        elif n:
            read, pos = _ply_lists(data, words, pos, n, props, order)
            if name == "face":
                faces += [np.array([[v[0], v[i], v[i + 1]] for v in read for i in range(1, len(v) - 1)], int).reshape(-1, 3)]
    return vertices, np.concatenate(faces)


def _ply_lists(data: bytes, words: list[bytes] | None, pos: int, n: int, props: list[list[str]], order: str) -> tuple[list[list[int]], int]:
    """The first list of each of n rows. Rows of one list of equal length, as in most meshes, are read at once."""
    if words is None and len(props) == 1:
        count, kind = (np.dtype(order + _PLY[k]) for k in props[0][1:3])
        k = int(np.frombuffer(data, count, 1, pos)[0])
        row = np.dtype([("n", count), ("v", kind, (k,))])
        if pos + n * row.itemsize <= len(data):
            got = np.frombuffer(data, row, n, pos)
            if (got["n"] == k).all():
                return got["v"].astype(int).tolist(), pos + n * row.itemsize

    def value(kind: str) -> float:
        nonlocal pos
        if words is not None:
            pos += 1
            return float(words[pos - 1])
        t = np.dtype(order + _PLY[kind])
        pos += t.itemsize
        return float(np.frombuffer(data, t, 1, pos - t.itemsize)[0])

    out = []
    for _ in range(n):
        row = [[value(p[2]) for _ in range(int(value(p[1])))] if p[0] == "list" else value(p[0]) for p in props]
        out.append([int(i) for i in next(x for x in row if isinstance(x, list))])
    return out, pos


@dataclass
class MrcHeader:
    kind: np.dtype
    nz: int
    ny: int
    nx: int
    offset: int
    voxel: tuple[float, float, float]


def mrc_header(data: bytes) -> MrcHeader:
    """What the first 1024 bytes of an MRC file say; voxel is its size in angstrom along x, y, z."""
    if len(data) < 1024:
        raise ValueError("not an MRC file")
    order = ">" if data[212:214] == b"\x11\x11" else "<"
    nx, ny, nz, mode = struct.unpack_from(order + "4i", data)
    mx, my, mz = struct.unpack_from(order + "3i", data, 28)
    cell = struct.unpack_from(order + "3f", data, 40)
    (extra,) = struct.unpack_from(order + "i", data, 92)
    if mode not in _MRC:
        raise ValueError(f"MRC mode {mode}")
    return MrcHeader(np.dtype(order + _MRC[mode]), nz, ny, nx, 1024 + extra, tuple(c / max(1, m) for c, m in zip(cell, (mx, my, mz), strict=True)))


def mrc_head(shape: tuple[int, int, int], voxel: float, mode: int = 2) -> bytes:
    """The header of a volume of the shape (z, y, x)."""
    nz, ny, nx = shape
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, nx, ny, nz, mode)
    struct.pack_into("<3i", head, 28, nx, ny, nz)
    struct.pack_into("<6f", head, 40, nx * voxel, ny * voxel, nz * voxel, 90.0, 90.0, 90.0)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    head[208:212], head[212:216] = b"MAP ", b"\x44\x44\0\0"
    return bytes(head)


def mrc_array(data: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Volume [z, y, x] and the voxel size in angstrom along x, y, z."""
    h = mrc_header(data)
    return np.frombuffer(data, h.kind, h.nx * h.ny * h.nz, h.offset).reshape(h.nz, h.ny, h.nx), h.voxel


def moved(v: np.ndarray) -> np.ndarray:
    """Mesh frame to the tomogram's: axes swapped, scaled; the same for normals."""
    return v[:, AXES] * np.array(SCALES)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).selectExpr("path as file", "content")


def glb_vertices(spark: SparkSession, path: str) -> DataFrame:
    """file, id, x, y, z, nx, ny, nz in the tomogram's frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                v, _, n = glb_arrays(bytes(content))
                m = np.hstack([moved(v), moved(n)])
                yield pd.DataFrame(m, columns=["x", "y", "z", "nx", "ny", "nz"]).assign(file=file, id=np.arange(len(m)))

    return _files(spark, path).mapInPandas(run, "file string, id long, x double, y double, z double, nx double, ny double, nz double")


def glb_faces(spark: SparkSession, path: str) -> DataFrame:
    """file, face, v0, v1, v2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                f = glb_arrays(bytes(content))[1]
                yield pd.DataFrame(f, columns=["v0", "v1", "v2"]).assign(file=file, face=np.arange(len(f)))

    return _files(spark, path).mapInPandas(run, "file string, face long, v0 long, v1 long, v2 long")


def ply_mesh(spark: SparkSession, path: str, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(file, id, x, y, z) and (file, face, v0, v1, v2)."""

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                v = ply_arrays(bytes(content))[0] * scale
                yield pd.DataFrame(v, columns=["x", "y", "z"]).assign(file=file, id=np.arange(len(v)))

    def faces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                f = ply_arrays(bytes(content))[1]
                yield pd.DataFrame(f, columns=["v0", "v1", "v2"]).assign(file=file, face=np.arange(len(f)))

    files = _files(spark, path)
    return files.mapInPandas(vertices, "file string, id long, x double, y double, z double"), files.mapInPandas(faces, "file string, face long, v0 long, v1 long, v2 long")


def mrc_voxels(spark: SparkSession, path: str) -> DataFrame:
    """file, z, y, x, value and the voxel size in nm: one row for each voxel, made slice by slice. A row of the file source holds a whole file: volumes over 2 GiB, and slabs, go through sources.volumes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                v, size = mrc_array(bytes(content))
                y, x = np.indices(v.shape[1:])
                for z in range(len(v)):
                    yield pd.DataFrame({"file": file, "z": z, "y": y.ravel(), "x": x.ravel(), "value": v[z].ravel().astype(float), "voxel_nm": size[0] / 10.0})

    return _files(spark, path).mapInPandas(run, "file string, z int, y int, x int, value double, voxel_nm double")


def curve_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """file, zone_name, tomogram_name, name, curve, r, value of saved curve matrices (NPZ with r_vals and one matrix for each name)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    r = z["r_vals"].astype(float)
                    tags = {n: str(z[n]) if n in z.files else None for n in ("zone_name", "tomogram_name")}
                    for name in z.files:
                        m = z[name]
                        if name in ("r_vals", *tags) or m.dtype.kind not in "fiu":
                            continue
                        m = np.atleast_2d(m.astype(float))
                        if not m.size or m.shape[1] != len(r):
                            continue
                        yield pd.DataFrame({"file": file, **tags, "name": name, "curve": np.repeat(np.arange(len(m)), len(r)), "r": np.tile(r, len(m)), "value": m.ravel()})

    return _files(spark, path).mapInPandas(run, "file string, zone_name string, tomogram_name string, name string, curve int, r double, value double")


def mrc_bytes(v: np.ndarray, voxel: float) -> bytes:
    """A volume [z, y, x] of 32-bit floats or 8-bit labels as an MRC file; voxel is its size in angstrom."""
    mode, kind = (0, "i1") if v.dtype.kind in "iub" else (2, "<f4")
    return mrc_head(v.shape, voxel, mode) + v.astype(kind).tobytes()


def mrc_files(voxels: DataFrame, voxel: float, keys: Sequence[str] = ("file",)) -> DataFrame:
    """keys, content: the MRC file of each key's voxels (z, y, x, value); missing voxels are 0. A volume is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["z", "y", "x"]].to_numpy(int)
        v = np.zeros(at.max(0) + 1, np.float32)
        v[tuple(at.T)] = pdf["value"]
        return pdf.iloc[:1][list(keys)].assign(content=[mrc_bytes(v, voxel)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voxels.select(*keys).schema)
    return voxels.groupBy(*keys).applyInPandas(run, f"{kinds}, content binary")
