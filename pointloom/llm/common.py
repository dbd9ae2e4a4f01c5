"""Shared pieces of the text operators: tables, staged results, Arrow mapping, ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what spark.checkpoint.dir names. Only a local session may go without
    that setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = os.path.join(tempfile.gettempdir(), f"pointloom-{os.getuid()}")
    os.makedirs(root, exist_ok=True)
    return f"file://{root}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


_MADE: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, whatever executor is lost.

    drop_staged deletes it; what is left goes when the driver ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    where, fs = _hadoop(df.sparkSession, path)
    fs.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, fs = _hadoop(spark, path)
    fs.delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    for path in _paths(df):
        _delete(df.sparkSession, path)


def _paths(df: DataFrame) -> list[str]:
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    return [p for p in _MADE if p.rpartition("/")[2] in read]


def made() -> set[str]:
    """The staged tables that are there."""
    return set(_MADE)


def drop_made(spark: SparkSession, before: set[str], kept: DataFrame) -> None:
    """Delete all that was staged since `before` but what `kept` reads."""
    for path in set(_MADE) - before - set(_paths(kept)):
        _delete(spark, path)


def wrapped(df: DataFrame, keep: list[str], name: str = "_own") -> DataFrame:
    """df with all columns but `keep` held in one struct, so that an operator's columns cannot clash with them."""
    rest = [c for c in df.columns if c not in keep]
    held = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("string")
    return df.select(*[F.col(f"`{c}`") for c in keep if c in df.columns], held.alias(name))


def unwrapped(df: DataFrame, like: DataFrame, keep: list[str], name: str = "_own") -> DataFrame:
    """The columns of `like` from a wrapped table, in their order and with their own values."""
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(name).getField(c).alias(c) for c in like.columns])


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add; the operator's own columns win."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def slices(columns: list[pa.Array], rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of at most `rows` rows whose columns hold about `size` bytes; a run has one row at least."""
    n = len(columns[0]) if columns else 0
    weight = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_list(c.type):
            weight += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            weight += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(weight), 0
    while at < n:
        before = int(upto[at - 1]) if at else 0
        end = min(n, at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))))
        yield at, end - at
        at = end


def map_columns(
    df: DataFrame,
    inputs: list[str],
    added: str,
    fn: Callable[..., list],
    setup: Callable[[], object] | None = None,
    rows: int = 4096,
    size: int = 4 << 20,
) -> DataFrame:
    """Append columns that fn makes from the input columns, at most `rows` rows and about `size` bytes at a time.

    fn gets the object that setup() made in the worker (if any) and one Arrow
    array per input column, and returns one array or list per added column.
    Input columns named like an added one are replaced. Spark bounds the bytes
    of the Arrow batches themselves.
    """
    new = fields(added)
    low = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in low]
    schema = T.StructType(kept + new)
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new]
        state = [setup()] if setup else []
        for whole in batches:
            read = [whole.column(whole.schema.get_field_index(c)) for c in inputs]
            for at, n in slices(read, rows, size):
                batch = whole.slice(at, n)
                out = fn(*state, *[batch.column(batch.schema.get_field_index(c)) for c in inputs])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + arrays, names=keep + [f.name for f in new])

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the value as text, modulo mod; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def ranked(df: DataFrame, order: list[Column], name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Rows in global order with their rank from 0, and for each name: column of sums the running sum before the row.

    Rows are dealt by range and numbered inside each range; only one row for
    each range goes to the driver. The input must be staged, so that a second
    read gives the same rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "ranked"
    )
    sums = sums or {}
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()]).orderBy("_part").collect()
    offsets, run = [], {"_n": 0, **{k: 0 for k in sums}}
    for r in totals:
        offsets.append((r["_part"], run["_n"], *[run[k] for k in sums]))
        run["_n"] += r["_n"]
        for k in sums:
            run[k] += r[f"_t_{k}"] or 0
    ddl = "_part int, _o_n long" + "".join(f", _o_{k} long" for k in sums)
    w = Window.partitionBy("_part").orderBy("_seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(F.broadcast(spark.createDataFrame(offsets, ddl)), "_part")  # one row for each range
        .select(
            *[F.col(f"`{c}`") for c in df.columns],
            (F.col("_o_n") + F.row_number().over(w) - 1).alias(name),
            *[(F.col(f"_o_{k}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(k) for k, c in sums.items()],
        )
    )


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows staged in global order with their number from 0.

    Rows are dealt by range; a row's number is its place in its range plus the
    rows of the ranges before, of which one row each goes to the driver. Rows
    that agree in the whole order lie in any order, spread over ranges too.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    dealt = staged(
        salted.repartitionByRange(parts, *order, F.col("_salt")).sortWithinPartitions(*order, F.col("_salt")).drop("_salt")
        .withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()),
        "numbered",
    )
    offsets, run = [], 0
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r["_part"], run))
        run += r["count"]
    before = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))  # one row for each range
    in_part = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(before, "_part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + in_part).alias(name))


class _Known(dict):
    """A dict that learns the keys it lacks, from an older one if that has them."""

    def __init__(self, learn: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.learn, self.older = learn, older

    def __missing__(self, key: str) -> bytes:
        b = self.older.get(key)
        if b is None:
            b = self.learn(key)
        self[key] = b
        return b


class WordMemo:
    """Encoded words by text, in two generations: when the newer is full, the older is dropped.

    Words in use move to the newer generation, so frequent words stay, and
    memory has a bound.
    """

    def __init__(self, learn: Callable[[str], bytes], most: int = 400_000):
        self.learn, self.most = learn, most
        self.new = _Known(learn, {})

    def turn(self) -> None:
        if len(self.new) > self.most:
            self.new.older = {}
            self.new = _Known(self.learn, self.new)

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The joined bytes of each text's words."""
        self.turn()
        get = self.new.__getitem__
        return [b"".join(map(get, ws)) for ws in texts]
