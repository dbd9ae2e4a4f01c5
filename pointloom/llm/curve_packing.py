"""Packing along a space-filling curve: like documents share sequences, and nothing is padded.

A document's token ids fall into hashed buckets; the damped counts are a vector,
which random signs project to a few dimensions. The cell of that point has a
place on the Hilbert curve. Rows are dealt by ranges of that place and sorted,
and each range is one stream of ids, cut every 2048. What is left at the end of
a range is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_made, made, staged
from .token_store import coder

LENGTH = 2048
BUCKETS, DIMS, BITS = 1024, 4, 15
#: Ids in a row between the stages; longer documents take several rows, which may lie in two ranges.
SEGMENT = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed hash of 64-bit integers."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Projector:
    """Points of documents in the unit cube, the same on every machine: sums are of whole numbers."""

    def __init__(self, buckets: int = BUCKETS, dims: int = DIMS):
        self.buckets, self.dims = buckets, dims
        with np.errstate(over="ignore"):
            self.bucket = (_mixed(np.arange(1 << 16)) % np.uint64(buckets)).astype(np.int64)
            bits = _mixed(np.arange(buckets * dims) + (1 << 32)) >> np.uint64(7)
        self.signs = np.where(bits & np.uint64(1), 1.0, -1.0).reshape(buckets, dims)

    def counts(self, ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc * self.buckets + self.bucket[ids & 0xFFFF], minlength=n * self.buckets).reshape(n, self.buckets)

    def points(self, counts: np.ndarray) -> np.ndarray:
        damped = np.floor(16 * np.sqrt(counts))
        z = damped @ self.signs / np.sqrt(np.maximum((damped * damped).sum(1), 1))[:, None]
        return 0.5 + 0.5 * z / (1 + np.abs(z))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of points in [0, 1)**d, one row a point; d * bits is 63 at most.

    A cube's halves are visited in Gray-code order. Within a half the axes are
    mirrored or swapped with the first so that its curve joins its neighbours'.
    """
    n, d = points.shape
    x = np.clip((points * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(d):
            upper = (x[axis] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    turned = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turned
    place = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(d):
            place = place << 1 | (x[axis] >> level & 1)
    return place


CODED = "place long, text_hash long, doc_id long, row long, start long, doc_tokens long, ids binary"


def encoded(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each SEGMENT ids of a document, with the document's place on the curve."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, projector = coder(tokenizer, end_id), Projector()
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(h[2]) - 1 for h in held])
            all_ids = np.concatenate([h[2][:-1] for h in held]).astype(np.int64)
            places = hilbert(projector.points(projector.counts(all_ids, np.repeat(np.arange(len(held)), sizes), len(held))))
            out = {k: [] for k in ("place", "text_hash", "doc_id", "row", "start", "doc_tokens", "ids")}
            for (doc, row, ids), place in zip(held, places.tolist(), strict=True):
                raw = ids.tobytes()
                digest, width = zlib.crc32(raw), ids.itemsize
                for at in range(0, len(ids), SEGMENT):
                    for k, v in zip(out, (place, digest, doc, row, at, len(ids), raw[at * width : (at + SEGMENT) * width]), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

        for batch in batches:
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), code.documents(batch.column(1)), strict=True):
                held.append((doc, row, ids))
                size += len(ids)
                if len(held) >= 256 or size >= 1 << 20:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, CODED)


PACKED = "part int, number long, ids binary, doc_id array<long>, start array<long>, length array<int>, doc_tokens array<long>"
#: Sequences in a batch of rows.
ROWS = 512


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _rows(part: int, number: int, sizes: np.ndarray, ids: np.ndarray, pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of sequences of the given sizes from a run of ids and its pieces (doc_id, null, start, length, doc_tokens), which are cut to fit."""
    doc, null, start, length, total = pieces
    ends, begins = np.cumsum(sizes), np.cumsum(length) - length
    # a piece begins where a document's run or a sequence does
    at = np.union1d(begins, ends[:-1])
    at = at[at < ends[-1]]
    of = np.searchsorted(begins, at, "right") - 1
    cut_length = np.diff(np.append(at, ends[-1]))
    bounds = np.searchsorted(at, np.concatenate([[0], ends]))
    cols = [pa.array(doc[of], pa.int64(), mask=null[of]), pa.array(start[of] + at - begins[of], pa.int64()), pa.array(cut_length, pa.int32()), pa.array(total[of], pa.int64())]
    raw, width = ids.tobytes(), ids.itemsize
    byte_ends = np.concatenate([[0], ends]) * width
    for a in range(0, len(sizes), ROWS):
        b = min(len(sizes), a + ROWS)
        offsets = pa.array(bounds[a : b + 1], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * (b - a), pa.int32()), pa.array(np.arange(number + a, number + b), pa.int64()),
                pa.array([raw[byte_ends[i] : byte_ends[i + 1]] for i in range(a, b)], pa.binary()),
                *[pa.ListArray.from_arrays(offsets, c) for c in cols],
            ],
            names=["part", "number", "ids", "doc_id", "start", "length", "doc_tokens"],
        )


def pack(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Sequences of at most `length` ids: part, number (in the part), ids (little-endian) and the pieces' arrays.

    Every document's ids, with end_id after them, lie in exactly one place.
    Null and empty texts have the end id alone; documents longer than a
    sequence are cut. Documents of one place on the curve lie by their ids'
    hash, doc_id and row, so copies are neighbours, and however many there are
    they are dealt over several ranges. Repeated rows are packed each. The
    table is staged: it is what a trainer reads.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = staged(encoded(df, tokenizer, end_id, id_col, text_col), "coded")
    order = ["place", "text_hash", "doc_id", "row", "start"]
    dealt = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "start", "doc_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        kind = coder(tokenizer, end_id).kind
        ids, pieces = np.zeros(0, kind), [np.zeros(0, np.int64), np.zeros(0, bool), *[np.zeros(0, np.int64)] * 3]
        for batch in batches:
            doc = batch.column(0)
            sizes = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
            new = [pc.fill_null(doc, 0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), sizes, batch.column(2).to_numpy()]
            pieces = [np.concatenate([a, b]) for a, b in zip(pieces, new, strict=True)]
            ids = np.concatenate([ids, *[np.frombuffer(x, kind) for x in batch.column(3).to_pylist()]])
            whole = len(ids) // length
            if whole:
                yield from _rows(part, number, np.full(whole, length), ids[: whole * length], pieces)
                number, pieces = number + whole, _after(pieces, whole * length)
                ids = ids[whole * length :]
        if len(ids):
            yield from _rows(part, number, np.array(_powers(len(ids))), ids, pieces)

    return staged(dealt.mapInArrow(run, PACKED), "packed")


def _after(pieces: list[np.ndarray], n: int) -> list[np.ndarray]:
    """What is left of the pieces when the first n ids are gone."""
    doc, null, start, length, total = pieces
    ends = np.cumsum(length)
    first = int(np.searchsorted(ends, n, "right"))
    left = [x[first:].copy() for x in pieces]
    if first < len(length):
        gone = n - int(ends[first] - length[first])
        left[2][0] += gone
        left[3][0] -= gone
    return left


DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def digest(packed: DataFrame) -> DataFrame:
    """One row for each piece of the packed sequences, which are numbered through all parts."""
    spark = packed.sparkSession
    counts, first = [], 0
    for r in packed.groupBy("part").count().orderBy("part").collect():  # one row for each part
        counts.append((r["part"], first))
        first += r["count"]
    known = packed.join(F.broadcast(spark.createDataFrame(counts, "part int, before long")), "part")
    rows = known.select((F.col("before") + F.col("number")).alias("sequence_id"), "ids", "doc_id", "start", "length", "doc_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(4)
            n = pc.list_value_length(lengths).to_numpy(zero_copy_only=False)
            flat = [batch.column(i).flatten() for i in (2, 3, 4, 5)]
            sizes = flat[2].to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            crc, offsets = [], np.zeros(len(sizes), np.int64)
            for i, raw in enumerate(batch.column(1).to_pylist()):
                own = sizes[ends[i] : ends[i + 1]]
                upto = np.cumsum(own)
                offsets[ends[i] : ends[i + 1]] = upto - own
                wide = np.frombuffer(raw, f"<u{len(raw) // int(upto[-1])}").astype("<u4").tobytes()
                crc += [zlib.crc32(wide[4 * (e - k) : 4 * e]) for e, k in zip(upto.tolist(), own.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [flat[0], flat[1], pa.array(sizes), pa.array(crc, pa.int64()), flat[3], pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(offsets)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return rows.mapInArrow(run, DIGEST)


def packed_digest(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of a new packing of df; other columns play no part, an empty table gives no rows."""
    before = made()
    out = staged(digest(pack(df, tokenizer, end_id, id_col, text_col)), "pieces")
    drop_made(df.sparkSession, before, out)
    return out
