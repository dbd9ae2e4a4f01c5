"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A store is a folder of parts in document order. A part follows the public
zstandard seekable format: data frames (each a run of whole documents' ids, or
a piece of one long document), a skippable frame with the documents' index,
and the seek table (a skippable frame whose footer ends the file). Plain
zstandard tools decompress a part to its ids. Ids take two bytes where the
vocabulary allows, else four, little-endian.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _Known, new_path, slices, staged

# Fixed values of the seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, FOOTER_MAGIC, FOOTER_SIZE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 9
HAS_CHECKSUM = 0x80
FRAME_IDS = 1 << 16


class Writer:
    """Writes one part to an open binary file."""

    def __init__(self, out, width: int, level: int = 3, frame_ids: int = FRAME_IDS):
        self.out, self.kind, self.frame_ids = out, np.dtype(f"<u{width}"), frame_ids
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.seek: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        for at in range(0, len(ids), self.frame_ids):
            piece = ids[at : at + self.frame_ids]
            self.held.append(piece.astype(self.kind))
            self.count += len(piece)
            if self.count >= self.frame_ids:
                self.flush()

    def flush(self) -> None:
        if self.count:
            raw = b"".join(x.tobytes() for x in self.held)
            data = self.zip.compress(raw)
            self.out.write(data)
            self.seek.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.count = [], 0

    def close(self) -> None:
        self.flush()
        ids = np.array([d[0] for d in self.docs], "<i8").tobytes()
        nulls = np.array([d[1] for d in self.docs], "u1").tobytes()
        sizes = np.array([d[2] for d in self.docs], "<u8").tobytes()
        body = self.zip.compress(struct.pack("<BQ", self.kind.itemsize, len(self.docs)) + ids + nulls + sizes)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.seek.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *e) for e in self.seek)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + FOOTER_SIZE) + entries + struct.pack("<IBI", len(self.seek), HAS_CHECKSUM, FOOTER_MAGIC))


class Reader:
    """Reads documents of one part; a document costs its own frames only."""

    def __init__(self, file, size: int):
        self.file = file
        n, flags, magic = struct.unpack("<IBI", self._at(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != FOOTER_MAGIC or not flags & HAS_CHECKSUM:
            raise ValueError("not a seekable part with checksums")
        table = np.frombuffer(self._at(size - FOOTER_SIZE - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = table.T
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.unzip = zstandard.ZstdDecompressor()
        body = self.unzip.decompress(self._at(int(self.offsets[n - 1]) + 8, int(self.sizes[-1]) - 8))
        width, docs = struct.unpack_from("<BQ", body)
        self.kind, at = np.dtype(f"<u{width}"), 9
        self.doc_ids = np.frombuffer(body, "<i8", docs, at)
        self.nulls = np.frombuffer(body, "u1", docs, at + 8 * docs).astype(bool)
        self.counts = np.frombuffer(body, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.frame_starts = np.concatenate([[0], np.cumsum(self.raw[:-1] // width)])
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, self.kind))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            raw = self.unzip.decompress(self._at(int(self.offsets[i]), int(self.sizes[i])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"checksum of frame {i}")
            self.last = (i, np.frombuffer(raw, self.kind))
        return self.last[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the part."""
        at, end = int(self.starts[i]), int(self.starts[i + 1])
        f = int(np.searchsorted(self.frame_starts, at, "right")) - 1
        out = []
        while at < end:
            ids, base = self.frame(f), int(self.frame_starts[f])
            out.append(ids[at - base : end - base])
            at, f = min(end, base + len(ids)), f + 1
        return np.concatenate(out) if out else np.zeros(0, self.kind)


class WordEncoder:
    """Encodes with the tokenizers library, each distinct word once while it is remembered.

    The text is cut at spaces and line feeds, which the tokenizer's own
    splitting never spans, so the ids are those of the whole text. Where the
    tokenizer lower-cases and takes letters, digits and marks apart (tried on
    some words at the start), runs of Latin letters go to the library's model
    alone, and marks and digits are remembered apart.

    Known words are an Arrow column beside one array of all their ids, so what
    is known costs no Python per word; when there are too many, the words of
    the text at hand stay.
    """

    def __init__(self, path: str, end_id: int | None, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = False
        self.model, self.most = self.tok.model, most
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.bytes_as_chars = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        rest = [b for b in range(256) if b not in self.bytes_as_chars]
        self.bytes_as_chars |= {b: chr(256 + i) for i, b in enumerate(rest)}
        tries = ("the", "Zzqxk", "für", "École", "niño")
        self.cores, self.marks = {}, _Known(self._encode, {})  # runs of letters, and the rest
        self._spell(list(tries))
        pairs = [(t, m) for t in tries for m in (*MARKS, "1", "***", "=7")]
        self.plain = all(self.cores[t] == self._encode(t) and self.cores[t] + self._pieces(m) == self._encode(t + m) for t, m in pairs)
        self.tail = np.array([] if end_id is None else [end_id], self.kind)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def _spell(self, cores: list[str]) -> None:
        """Remember runs of letters below U+0180, by the model alone."""
        for at in range(0, len(cores), 20_000):
            part = cores[at : at + 20_000]
            low = [w.lower() for w in part]
            found = [self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes_as_chars)) for w in low]
            ends = list(accumulate(map(len, found)))
            raw = np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), self.kind, ends[-1]).tobytes()
            self.cores.update(zip(part, [raw[a * self.width : b * self.width] for a, b in zip([0, *ends], ends)]))

    def _pieces(self, word: str) -> bytes:
        """A word without letters, or with ASCII letters, by its runs."""
        return b"".join([self.cores[x] if x in self.cores else self.marks[x] for x in RUNS.findall(word)])

    def _learned(self, words: pa.Array) -> None:
        if len(self.marks) > self.most // 16:
            self.marks.clear()
        if len(self.cores) > self.most // 8:
            self.cores = {}
        if self.plain:
            core = pc.utf8_rtrim(words, characters=MARKS)
            # a word is letters and marks, or ASCII that no apostrophe splits, or else the library's
            lone = pc.match_substring_regex(core, LETTERS).to_numpy(zero_copy_only=False).tolist()
            mixed = pc.match_substring_regex(words, "^[\\x21-\\x26\\x28-\\x7e]+$").to_numpy(zero_copy_only=False).tolist()
            whole, cores = _strings(words), _strings(core)
            need = {c for c, k in zip(cores, lone) if k}
            for w, k, m in zip(whole, lone, mixed):
                if m and not k:
                    need.update(ASCII_LETTERS.findall(w))
            self._spell([c for c in need if c not in self.cores])
            known, marks = self.cores, self.marks
            coded = [
                (known[c] if len(c) == len(w) else known[c] + marks[w[len(c) :]]) if k else self._pieces(w) if m else self._encode(w)
                for w, c, k, m in zip(whole, cores, lone, mixed)
            ]
        else:
            coded = [self._encode(w) for w in words.to_pylist()]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // self.width
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), self.kind)])
        self.known = pa.concat_arrays([self.known, words])

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the offset of each text among them (and the end)."""
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        if len(self.known) > self.most:
            self._forget()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        places, first = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(self.known)
        if found.null_count:
            self._learned(coded.dictionary.filter(found.is_null()))
            places[places < 0] = np.arange(first, len(self.known))
        at = places[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(n)]
        upto = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], upto]).astype(np.int64)]

    def documents(self, texts: pa.Array, size: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of each text with the end id; about `size` bytes of text are worked on at a time."""
        for at, n in slices([texts], 8192, size):
            part = texts.slice(at, n)
            if n == 1 and len(text := part[0].as_py()) > size:
                yield np.concatenate([self.column(pa.array([x]))[0] for x in _cut(text, size)] + [self.tail])
                continue
            ids, offsets = self.column(part)
            ids = np.insert(ids, np.repeat(offsets[1:], len(self.tail)), np.tile(self.tail, n)) if len(self.tail) else ids
            offsets = offsets + len(self.tail) * np.arange(n + 1)
            for i in range(n):
                yield ids[offsets[i] : offsets[i + 1]]


def _strings(words: pa.Array) -> list[str]:
    """Words, which hold no space, as Python strings; one split is faster than a value at a time."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


def _cut(text: str, size: int) -> Iterator[str]:
    """A long text in parts of about `size` characters that end before a space; a longer run without one is one part."""
    at = 0
    while at < len(text):
        end = text.rfind(" ", at + 1, at + size) if at + size < len(text) else len(text)
        if end < 0:
            end = text.find(" ", at + size)
        yield text[at : (end := len(text) if end < 0 else end)]
        at = end


#: Marks that a word may end in.
MARKS = ".,;:!?"
#: Letters below U+0180, but the capital dotted I, the one letter there whose lower case is two characters.
LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"
ASCII_LETTERS = re.compile("[A-Za-z]+")
RUNS = re.compile("[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
_CODERS: dict[tuple, WordEncoder] = {}


def coder(path: str, end_id: int | None) -> WordEncoder:
    """One encoder for each worker process, so that its memory serves the tasks that follow."""
    if (path, end_id) not in _CODERS:
        _CODERS[(path, end_id)] = WordEncoder(path, end_id)
    return _CODERS[(path, end_id)]


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(df: DataFrame, tokenizer: str, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> list[tuple]:
    """Encode df and write a store to path; returns (part, documents, ids) in order.

    Rows are dealt by ranges of the id and sorted, null ids first; null texts
    are empty. Rows with equal ids follow each other in the order of a hash of
    their texts. Each task writes its part under a temporary name and renames
    it, so a task that runs twice leaves one part.
    """
    spark = df.sparkSession
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by the text's hash too, so that many rows of one id, or without one, are no single range
    dealt = slim.withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    fs, folder = _open_fs(path)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, base = _open_fs(path)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        code, docs, ids = coder(tokenizer, end_id), 0, 0
        name, temp = f"part-{part:06d}.zst", f"{base}/.part-{part:06d}-{attempt}"
        with where.open_output_stream(temp) as out:
            writer = Writer(out, code.width, level)
            for whole in batches:
                for doc, x in zip(whole.column(0).to_pylist(), code.documents(whole.column(1)), strict=True):
                    writer.add(doc, x)
                    docs, ids = docs + 1, ids + len(x)
            writer.close()
        if where.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
            where.move(temp, f"{base}/{name}")
        else:  # another attempt of this task has left the same part
            where.delete_file(temp)
        yield pa.RecordBatch.from_pydict({"part": [name], "docs": [docs], "ids": [ids]})

    done = dealt.mapInArrow(run, "part string, docs long, ids long").collect()  # one row for each part
    return sorted(tuple(r) for r in done)


def read(spark: SparkSession, path: str, parts: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a store, from its files."""
    rows, start = [], 0
    for name, docs, ids in parts:
        if docs:
            rows.append((name, start))
        start += ids
    todo = spark.createDataFrame(rows, "part string, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open_fs(path)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                full = f"{base}/{name}"
                with where.open_input_file(full) as file:
                    reader = Reader(file, file.size())
                    n = len(reader.doc_ids)
                    for at in range(0, n, 8192):
                        to = min(n, at + 8192)
                        crc = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(at, to)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[at:to], pa.int64(), mask=reader.nulls[at:to]),
                                pa.array(first + reader.starts[at:to], pa.int64()),
                                pa.array(reader.counts[at:to], pa.int64()),
                                pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df to a new store in the shared folder and return the digest that its files give; ids must be integers.

    Null and empty texts have the end id alone; very long ones span frames.
    Rows that repeat an id follow each other, each with a start of its own.
    Other columns, whatever their names, play no part; an empty table gives an
    empty digest. The digest is staged, and the store stays for other readers
    until its folder is removed.
    """
    path = new_path(df.sparkSession, "tokens")
    parts = write(df, tokenizer, path, end_id, id_col, text_col)
    return staged(read(df.sparkSession, path, parts), "digest")


def part_bytes(docs: list[tuple[int | None, np.ndarray]], width: int = 2, frame_ids: int = FRAME_IDS) -> bytes:
    """A part in memory."""
    out = io.BytesIO()
    w = Writer(out, width, frame_ids=frame_ids)
    for doc_id, ids in docs:
        w.add(doc_id, ids)
    w.close()
    return out.getvalue()
