"""MRC volumes by slices: a data source whose partitions are byte ranges of a file.

spark.read.format("mrc").load(path) has one row for each voxel. A partition
reads its own slices only, a few rows of an image at a time, so a volume may be
larger than any task's memory. Filters on z are pushed into the reader: slices
that they rule out are never read. Files are reached through pyarrow's file
systems (local paths, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .binary import mrc_head, mrc_header

SCHEMA = "file string, z int, y int, x int, value double, voxel_nm double"
#: Bytes of voxels that a partition reads, and voxels in a batch of rows.
PARTITION, BATCH = 16 << 20, 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def found(path: str) -> list[str]:
    """The files of a path: a file, a folder's *.mrc files, or a pattern in the last part."""
    folder, _, last = path.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else "*.mrc"
    top = folder if pattern == last else path.rstrip("/")
    fs, inner = _open(top)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File]
    return [f"{top}/{n}" for n in sorted(names) if fnmatch.fnmatch(n, pattern) and not n.startswith(".")]


@dataclass
class Slices(InputPartition):
    file: str
    first: int
    last: int


class VolumeReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.low, self.high, self.among = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("z",) or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, In):
                wanted = {int(v) for v in f.value if v is not None}
                self.among = wanted if self.among is None else self.among & wanted
                continue
            low = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}.get(type(f))
            high = {EqualTo: f.value, LessThan: f.value - 1, LessThanOrEqual: f.value}.get(type(f))
            self.low = self.low if low is None else max(self.low, low)
            self.high = self.high if high is None else high if self.high is None else min(self.high, high)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for file in found(self.path):
            fs, inner = _open(file)
            with fs.open_input_file(inner) as f:
                h = mrc_header(f.read(1024))
            step = max(1, self.size // max(1, h.ny * h.nx * h.kind.itemsize))
            wanted = [z for z in range(self.low, min(h.nz - 1, h.nz - 1 if self.high is None else self.high) + 1) if self.among is None or z in self.among]
            run: list[int] = []
            for z in wanted:  # runs of neighbouring slices
                if run and (z != run[-1] + 1 or len(run) == step):
                    out.append(Slices(file, run[0], run[-1]))
                    run = []
                run.append(z)
            if run:
                out.append(Slices(file, run[0], run[-1]))
        return out or [Slices("", 0, -1)]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, inner = _open(partition.file)
        with fs.open_input_file(inner) as f:
            h = mrc_header(f.read(1024))
            rows = max(1, BATCH // h.nx)
            for z in range(partition.first, partition.last + 1):
                for y in range(0, h.ny, rows):
                    n = min(rows, h.ny - y)
                    f.seek(h.offset + (z * h.ny + y) * h.nx * h.kind.itemsize)
                    raw = f.read(n * h.nx * h.kind.itemsize)
                    if len(raw) < n * h.nx * h.kind.itemsize:
                        raise ValueError(f"{partition.file} ends in slice {z}")
                    m = n * h.nx
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([partition.file] * m), pa.array(np.full(m, z, np.int32)), pa.array(np.repeat(np.arange(y, y + n, dtype=np.int32), h.nx)),
                            pa.array(np.tile(np.arange(h.nx, dtype=np.int32), n)), pa.array(np.frombuffer(raw, h.kind).astype(np.float64)), pa.array(np.full(m, h.voxel[0] / 10.0)),
                        ],
                        names=["file", "z", "y", "x", "value", "voxel_nm"],
                    )


class VolumeSource(DataSource):
    """format("mrc"); option partitionBytes: bytes of voxels for each partition."""

    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return VolumeReader(self.options["path"], int(self.options.get("partitionbytes", self.options.get("partitionBytes", PARTITION))))


def volumes(spark: SparkSession, path: str, partition_bytes: int = PARTITION) -> DataFrame:
    """file, z, y, x, value, voxel_nm of the volumes at path, read by slices; a filter on z reads its slices only."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)
    return spark.read.format("mrc").option("partitionBytes", partition_bytes).load(path)


def write_volumes(voxels: DataFrame, path: str, shape: tuple[int, int, int], voxel: float, key: str = "file") -> DataFrame:
    """Write <path>/<key>.mrc for each key from its voxels (z, y, x, value), as 32-bit floats; returns key, path and voxels written.

    shape is (z, y, x), voxel the size in angstrom. A volume streams through
    one task slice by slice; missing voxels are 0, and of several values for a
    voxel the greatest counts; those outside the shape and null keys are left out.
    Each file is written under another name and renamed, so a task that runs
    twice leaves one file.
    """
    nz, ny, nx = shape
    fs, base = _open(path)
    fs.create_dir(base, recursive=True)
    inside = F.col("z").between(0, nz - 1) & F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)
    dealt = voxels.filter(inside & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("int").alias(c) for c in "zyx"], F.col("value").cast("double").alias("value"))
    parts = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("key", "z", "y", "x", F.col("value").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, where, folder = TaskContext.get().taskAttemptId(), *_open(path)
        now, out, image, at, n, done = None, None, None, 0, 0, []

        def close() -> None:
            for z in range(at, nz):
                out.write((image if z == at else np.zeros((ny, nx), "<f4")).tobytes())
            out.close()
            where.move(f"{folder}/.{attempt}-{now}", f"{folder}/{now}.mrc")
            done.append((now, f"{path}/{now}.mrc", n))

        for b in batches:
            keys, (z, y, x), v = b.column(0).to_numpy(zero_copy_only=False), [b.column(i).to_numpy() for i in (1, 2, 3)], np.nan_to_num(b.column(4).to_numpy(zero_copy_only=False).astype(float))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (z[1:] != z[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if i == j:
                    continue
                if keys[i] != now:
                    if out:
                        close()
                    now, at, n = keys[i], 0, 0
                    out = where.open_output_stream(f"{folder}/.{attempt}-{now}")
                    out.write(mrc_head(shape, voxel))
                    image = np.zeros((ny, nx), "<f4")
                while at < z[i]:
                    out.write(image.tobytes())
                    image, at = np.zeros((ny, nx), "<f4"), at + 1
                image[y[i:j], x[i:j]] = v[i:j]
                n += int(j - i)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["key", "path", "n"])

    return dealt.mapInArrow(run, "key string, path string, n long")
