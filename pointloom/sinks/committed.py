"""A keyed table in buckets whose versions are commits.

The rows of a key lie in the bucket that the hash of the key names. A commit
writes the buckets that its keys touch into a folder of its own, then a list
of all buckets' folders under the next number, by a rename that fails if the
number is taken. Readers follow the newest list, so a writer that dies changes
nothing. The table needs a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import KEY, upsert, without_keys

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer committed first; read again and repeat."""


class CommittedTable:
    """The table under a path; `buckets` and `keys` are set by its first commit.

    A commit reads and writes the touched buckets only. The last `kept` lists
    can still be read; what no kept list names is swept after a commit, so a
    reader that is older than that must read again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = KEY, buckets: int = 64, kept: int = 2):
        self.spark, self.path, self.keys, self.buckets, self.kept = spark, path.rstrip("/"), list(keys), buckets, kept
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        now = self.manifest()
        if now["version"]:
            self.buckets = now["buckets"]
            if now["keys"] != self.keys:
                raise ValueError(f"the table's keys are {now['keys']}")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Numbers of the lists that are there, ascending."""
        folder = self._at("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, keys, buckets, schema, folders (by bucket) and batches (by writer); the newest unless told."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "folders": {}, "batches": {}}
        stream = self._fs.open(self._at(f"commits/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, wanted: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of a manifest's buckets, or None if it lists none of them."""
        held = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(manifest["folders"].items()) if wanted is None or int(b) in wanted]
        if not held:
            return None
        return self.spark.read.schema(manifest["schema"]).parquet(*held)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the newest unless told."""
        now = self.manifest(version)
        if not now["version"]:
            raise FileNotFoundError(f"no commit under {self.path}")
        rows = self._read(now)
        return self.spark.createDataFrame([], now["schema"]) if rows is None else rows

    def upsert(self, new: DataFrame, writer: str = "", batch: int | None = None) -> int:
        """Replace the rows of new's keys by new; the version that holds them.

        A batch that this writer committed before changes nothing. Columns that
        one side lacks are null. An empty table commits its schema only.
        """
        return self._commit(new, True, writer, batch)

    def delete(self, gone: DataFrame, writer: str = "", batch: int | None = None) -> int:
        """Take out the rows whose keys occur in gone; the version without them."""
        return self._commit(gone, False, writer, batch)

    def _commit(self, rows: DataFrame, add: bool, writer: str, batch: int | None) -> int:
        now = self.manifest()
        if batch is not None and now["batches"].get(writer, -1) >= batch:
            return now["version"]
        if not add and not now["version"]:
            return 0
        touched = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets`
        old = self._read(now, touched)
        old = old if old is not None else self.spark.createDataFrame([], now["schema"] if now["version"] else rows.schema)
        out = upsert(old, rows, self.keys) if add else without_keys(old, rows, self.keys)
        folder = f"{now['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched}
        if touched:
            dealt = out.withColumn(BUCKET, self._bucket()).repartition(len(touched), BUCKET)
            dealt.write.partitionBy(BUCKET).parquet(self._at(f"data/{folder}").toString())
            made = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"data/{folder}"))]
            folders |= {n.partition("=")[2]: folder for n in made if n.startswith(f"{BUCKET}=")}
        batches = now["batches"] | ({writer: batch} if batch is not None else {})
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
        self._publish({"version": now["version"] + 1, "keys": self.keys, "buckets": self.buckets, "schema": schema, "folders": folders, "batches": batches})
        self._sweep()
        return now["version"] + 1

    def _publish(self, manifest: dict) -> None:
        target, draft = self._at(f"commits/{manifest['version']:012d}.json"), self._at(f"drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is taken")

    def _sweep(self) -> None:
        """Delete lists but the last ones, and older folders that none of those names."""
        there = self.versions()
        live = {f for v in there[-self.kept :] for f in self.manifest(v)["folders"].values()}
        for v in there[: -self.kept]:
            self._fs.delete(self._at(f"commits/{v:012d}.json"), False)
        data = self._at("data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = s.getPath().getName()
            if name not in live and int(name.partition("-")[0]) <= there[-1]:  # a later number is a commit under way
                self._fs.delete(s.getPath(), True)
