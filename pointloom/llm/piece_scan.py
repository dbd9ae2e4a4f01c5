"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan over chunks.

The model file is of the BPE kind. Its result for a text is the one sequence
of pieces in which every two neighbours are what BPE makes of their joined
text, so encoding is a best path with weight 0 for such neighbours and minus
infinity for others. A giant text is cut into chunks anywhere. The state at a
boundary is the piece that holds the character before it and how far it
reaches past it. A chunk yields the matrix of states it can lead from and to;
matrices multiply associatively in the max-plus semiring; products from both
ends leave one state at each boundary, and every chunk is traced back alone.

Places where no piece can pass (before a space that follows other text, and
around characters that are in no piece) are cuts: all paths meet there, so
inside a chunk only the stretches between the boundaries and their nearest
cuts need the lattice; the rest is encoded by the library, word by word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, as_bytes, map_columns, staged, without

SPACE = "▁"
#: Texts of more characters are encoded in chunks of this many.
CHUNK = 32_768
CUT = -1  # the state at a boundary that is a cut
MAX_CACHED = 50_000


class Pieces:
    """A model file with the parts that the scan needs."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in plain}
        self.score = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.text = {i: p for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this model has pieces across words")
        self.longest = max(map(len, self.ids))
        self.chars = {c for p in self.ids for c in p}
        if "\n" in self.chars:
            raise ValueError("this model has pieces with line feeds")
        self.cut = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.feed = np.array(self.sp.encode("\n")[1:], "<i4").tobytes()
        self.memo = WordMemo(self._learn, 100_000)
        self.pairs: dict[tuple[str, str], bool] = {}

    # whole words by the library
    def many(self, prepared: list[str]) -> list[np.ndarray]:
        """Ids of stretches between cuts; spaces are already U+2581."""
        return [np.frombuffer(self.memo.joined([self.cut.findall(t)])[0], "<i4") for t in prepared]

    def _learn(self, word: str) -> bytes:
        # the library adds one space in front; where there is none, a line feed keeps it apart
        if word == "\n":
            return self.feed
        if word == SPACE:
            return np.array([self.ids[SPACE]], "<i4").tobytes()
        if word[0] == SPACE:
            return np.array(self.sp.encode(word[1:].replace(SPACE, " ")), "<i4").tobytes()
        return np.array(self.sp.encode("\n" + word)[len(self.feed) // 4 + 1 :], "<i4").tobytes()

    def words(self, prepared: str) -> np.ndarray:
        return self.many([prepared])[0]

    def encode(self, text: str | None) -> np.ndarray:
        return self.words(prepare(text)) if text else np.zeros(0, "<i4")

    # the lattice
    def is_cut(self, before: str, after: str) -> bool:
        return (after == SPACE and before != SPACE) or before not in self.chars or after not in self.chars

    def merge(self, text: str) -> list[str]:
        """BPE of a short text by its definition: the best piece first, the leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def joins(self, a: str, b: str) -> bool:
        """True if a and b stay neighbours, that is if BPE of their text is a, b."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MAX_CACHED:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    def starting(self, s: str, at: int) -> list[str]:
        """Pieces of s that start at a place, or the character alone if it is in none."""
        found = [s[at : at + n] for n in range(1, min(self.longest, len(s) - at) + 1) if s[at : at + n] in self.ids or n == 1]
        return [p for p in found if len(p) == 1 or self.merge_self(p)]

    def merge_self(self, p: str) -> bool:
        key = (p, "")
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.merge(p) == [p]
        return got

    def id_bytes(self, part: str) -> list[int]:
        """Ids of one part of a path: its piece, or the bytes of a character that is in none."""
        if part in self.ids:
            return [self.ids[part]]
        return np.frombuffer(self.words(part).tobytes(), "<i4").tolist() if part == "\n" else self.sp.encode("\n" + part)[len(self.feed) // 4 + 1 :]

    def covers(self, s: str, at: int) -> list[tuple[str, int]]:
        """States at the place `at` of s: (part that holds the character before it, characters it reaches past it)."""
        if at == 0 or at == len(s) or self.is_cut(s[at - 1], s[at]):
            return [("", CUT)]
        out = []
        for start in range(max(0, at - self.longest), at):
            out += [(p, start + len(p) - at) for p in self.starting(s, start) if start + len(p) >= at]
        return out

    def spread(self, s: str, entries: list[tuple[str, int]], stop: int) -> dict[tuple[str, int], tuple[int, tuple[str, int] | None]]:
        """All parts that paths from the entries (part, end) reach, with the entries as bits and a step back.

        A part is expanded if it ends before stop.
        """
        seen: dict[tuple[str, int], tuple[int, tuple[str, int] | None]] = {e: (1 << i, None) for i, e in enumerate(entries)}
        by_end: dict[int, list[tuple[str, int]]] = {}
        for e in entries:
            by_end.setdefault(e[1], []).append(e)
        for end in range(min(by_end, default=stop), stop):
            for here in by_end.get(end, []):
                free = here[0] == "" or self.is_cut(s[end - 1], s[end])
                for p in self.starting(s, end):
                    if not free and not self.joins(here[0], p):
                        continue
                    to = (p, end + len(p))
                    if any(self.is_cut(s[i - 1], s[i]) for i in range(end + 1, to[1])):
                        continue
                    old = seen.get(to)
                    if old is None:
                        by_end.setdefault(to[1], []).append(to)
                        seen[to] = (seen[here][0], here)
                    else:
                        seen[to] = (old[0] | seen[here][0], old[1])
        return seen


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One model for each worker process, so that its memory serves the tasks that follow."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def prepare(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


class Chunk:
    """Characters [low, high) of a prepared text, with context on both sides as far as pieces reach."""

    def __init__(self, pieces: Pieces, context: str, low: int, high: int, first: bool, last: bool):
        self.p, self.s, self.low, self.high = pieces, context, low, high
        self.into = [("", CUT)] if first else pieces.covers(context, low)
        self.out = [("", CUT)] if last else pieces.covers(context, high)
        cuts = [i for i in range(low, high + 1) if i in (0, len(context)) or pieces.is_cut(context[i - 1], context[i])] if high > low else []
        self.left = low if first else cuts[0] if cuts else None
        self.right = high if last else cuts[-1] if cuts else None
        if self.left is None and self.right is not None:
            self.left = self.right
        if self.right is None and self.left is not None:
            self.right = self.left

    def _ends(self, state: tuple[str, int], at: int) -> tuple[str, int]:
        return state if state[1] == CUT and state[0] else (state[0], at + (0 if state[1] == CUT else state[1]))

    def matrix(self) -> list[tuple[int, int]]:
        """Pairs (number of the entry state, number of the exit state) that a path joins; all others are minus infinity."""
        enter = [self._ends(x, self.low) for x in self.into]
        leave = [self._ends(x, self.high) for x in self.out]
        if self.left is None:
            seen = self.p.spread(self.s, enter, self.high)
            reach = [seen.get(x, (0, None))[0] for x in leave]
            return [(i, j) for i in range(len(enter)) for j, bits in enumerate(reach) if bits >> i & 1]
        head = self.p.spread(self.s, enter, self.left)
        ok_in = 0
        for (_, end), (bits, _) in head.items():
            if end == self.left:
                ok_in |= bits
        tail = self.p.spread(self.s, [("", self.right)], self.high)
        ok_out = [x[1] == self.right and x[0] == "" or x in tail for x in leave]
        return [(i, j) for i in range(len(enter)) if ok_in >> i & 1 for j, ok in enumerate(ok_out) if ok]

    @staticmethod
    def _back(seen: dict, at: tuple[str, int]) -> list[str]:
        parts = []
        step = seen[at][1]
        while step is not None:
            parts.append(at[0])
            at, step = step, seen[step][1]
        return parts[::-1]

    def trace(self, i: int, j: int) -> np.ndarray:
        """Ids of the parts that end in the chunk or pass its end, those of the entry state left out."""
        enter, leave = self._ends(self.into[i], self.low), self._ends(self.out[j], self.high)
        if self.left is None:
            parts = self._back(self.p.spread(self.s, [enter], self.high), leave)
            return np.array([x for p in parts for x in self.p.id_bytes(p)], "<i4")
        head = self.p.spread(self.s, [enter], self.left)
        at = next((x for x in head if x[1] == self.left), None)
        first = self._back(head, at) if at is not None else []
        last = []
        if leave != ("", self.right):
            last = self._back(self.p.spread(self.s, [("", self.right)], self.high), leave)
        as_ids = lambda parts: np.array([x for p in parts for x in self.p.id_bytes(p)], "<i4")
        return np.concatenate([as_ids(first), self.p.words(self.s[self.left : self.right]), as_ids(last)])


def product(a: set[tuple[int, int]], b: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Max-plus product of two matrices of 0 and minus infinity."""
    by: dict[int, list[int]] = {}
    for i, j in b:
        by.setdefault(i, []).append(j)
    return {(i, k) for i, j in a for k in by.get(j, [])}


def boundary_states(matrices: list[list[tuple[int, int]]]) -> list[int]:
    """The state at each inner boundary; products of neighbours, pair by pair, leave one at each.

    Products are formed up a binary tree; then each node, whose outer states
    are known, picks the state between its two halves.
    """
    levels = [[set(x) for x in matrices]]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([product(m[i], m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    outer = [(0, 0)]  # the states around each node, from the root down
    for m in levels[-2::-1]:
        inner: list[tuple[int, int]] = []
        for k, (enter, leave) in enumerate(outer):
            if 2 * k + 1 == len(m):
                inner.append((enter, leave))
                continue
            both = {j for i, j in m[2 * k] if i == enter} & {i for i, j in m[2 * k + 1] if j == leave}
            if len(both) != 1:
                raise ValueError(f"{len(both)} states at a boundary")
            state = both.pop()
            inner += [(enter, state), (state, leave)]
        outer = inner
    return [leave for _, leave in outer[:-1]]


def chunk_of(pieces: Pieces, prepared: str, n: int, size: int) -> tuple[str, int, int, bool, bool]:
    margin = 2 * pieces.longest
    low, high = n * size, min(len(prepared), (n + 1) * size)
    at = max(0, low - margin)
    return prepared[at : high + margin], low - at, high - at, n == 0, high == len(prepared)


def scan(pieces: Pieces, text: str, size: int) -> np.ndarray:
    """Ids of one text by the scan, in one process."""
    prepared = prepare(text)
    chunks = [Chunk(pieces, *chunk_of(pieces, prepared, n, size)) for n in range(-(-len(prepared) // size))]
    states = [0, *boundary_states([c.matrix() for c in chunks]), 0]
    return np.concatenate([c.trace(states[i], states[i + 1]) for i, c in enumerate(chunks)])


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, "<i4")])))


_CHUNK = "k1 long, k2 long, n int, context string, low int, high int, first boolean, last boolean"


def _giants(base: DataFrame, model: str, text_col: str, size: int) -> DataFrame:
    """The rows of base, all with giant texts, with ids and n_chunks, by the scan."""
    text = F.col(f"`{text_col}`")
    setup = lambda: pieces_of(model)
    keyed = base.withColumn("_k1", F.xxhash64(F.lit(1), text)).withColumn("_k2", F.xxhash64(F.lit(2), text))
    distinct = keyed.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), text.alias("text")).dropDuplicates(["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        names = ["k1", "k2", "n", "context", "low", "high", "first", "last"]
        kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("context", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])
        for batch in batches:
            for row in range(batch.num_rows):
                k1, k2, t = (batch.column(i)[row].as_py() for i in range(3))
                prepared = prepare(t)
                total = -(-len(prepared) // size)
                for at in range(0, total, 64):
                    rows = [(k1, k2, n, *chunk_of(pieces, prepared, n, size)) for n in range(at, min(total, at + 64))]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)

    chunks = staged(distinct.mapInArrow(cut, _CHUNK).repartition(F.xxhash64("k1", "n")), "chunks")
    inputs = ["context", "low", "high", "first", "last"]

    def matrices(p: Pieces, *columns: pa.Array) -> list:
        got = [Chunk(p, *r).matrix() for r in zip(*[c.to_pylist() for c in columns], strict=True)]
        return [[[i for i, _ in m] for m in got], [[j for _, j in m] for m in got]]

    small_rows = map_columns(chunks, inputs, "a array<int>, b array<int>", matrices, setup, rows=64).select("k1", "k2", "n", "a", "b")

    def combine(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        states = [0, *boundary_states([list(zip(a, b, strict=True)) for a, b in zip(pdf["a"], pdf["b"], strict=True)]), 0]
        return pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "n": pdf["n"], "i": states[:-1], "j": states[1:]})

    states = small_rows.groupBy("k1", "k2").applyInPandas(combine, "k1 long, k2 long, n int, i int, j int")  # a text's matrices, a few numbers a chunk

    def trace(p: Pieces, *columns: pa.Array) -> list:
        *rest, i, j = [c.to_pylist() for c in columns]
        return [_lists([Chunk(p, *r).trace(a, b) for *r, a, b in zip(*rest, i, j, strict=True)])]

    traced = map_columns(chunks.join(states, ["k1", "k2", "n"]), [*inputs, "i", "j"], "part array<int>", trace, setup, rows=64).select("k1", "k2", "n", "part")
    whole = traced.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("n", "part"))).alias("parts"))  # one text
    whole = whole.select("k1", "k2", F.flatten(F.transform("parts", lambda x: x["part"])).alias("ids"), F.size("parts").alias("n_chunks"))
    return keyed.join(whole, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).select(*[F.col(f"`{c}`") for c in base.columns], "ids", "n_chunks")


def _parts(df: DataFrame, text_col: str, size: int, added: list[str]) -> tuple[DataFrame, DataFrame]:
    """df without the columns to add, as rows of texts up to size and rows of giant ones."""
    base = without(df, [n for n in (*added, "_k1", "_k2") if n != text_col])
    giant = F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)) > size
    return base.filter(~giant), base.filter(giant)


def encode(df: DataFrame, model: str, text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """df with ids (array<int>) and n_chunks; columns of these names are replaced.

    Null and empty texts have no ids. Equal giant texts are scanned once. Rows
    are judged alone, so repeats and extra columns change nothing; an empty
    table stays empty.
    """
    small, giant = _parts(df, text_col, size, ["ids", "n_chunks"])

    def run(p: Pieces, column: pa.Array) -> list:
        ids = p.many([prepare(t) if t else "" for t in column.to_pylist()])
        return [_lists(ids), [1] * len(ids)]

    plain = map_columns(small, [text_col], "ids array<int>, n_chunks int", run, lambda: pieces_of(model), rows=1024, size=1 << 20)
    return plain.union(_giants(giant, model, text_col, size))


DIGEST = "n_tokens long, ids_crc32 long, round_trip boolean"


def _digest(p: Pieces, text: pa.Array, ids: list[np.ndarray]) -> list:
    crc = [zlib.crc32(x.tobytes()) for x in ids]
    same = [d == (t or b"").decode().replace(SPACE, " ") for t, d in zip(as_bytes(text), decode(p, ids), strict=True)]
    return [[len(x) for x in ids], crc, same]


def with_digest(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """An encoded df with n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip in place of ids.

    round_trip says that decoding gives the text back, where the file's own
    marker U+2581 counts as a space.
    """

    def run(p: Pieces, text: pa.Array, ids: pa.Array) -> list:
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<i4"), ids.offsets.to_numpy()
        return _digest(p, text, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])

    return map_columns(df, [text_col, "ids"], DIGEST, run, lambda: pieces_of(model), rows=128).drop("ids")


def encode_to_digest(df: DataFrame, model: str, text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """with_digest(encode(df)), with the ids of texts up to size digested in the worker that made them."""
    small, giant = _parts(df, text_col, size, ["ids", "n_chunks", "n_tokens", "ids_crc32", "round_trip"])

    def run(p: Pieces, column: pa.Array) -> list:
        ids = p.many([prepare(t) if t else "" for t in column.to_pylist()])
        return [[1] * len(ids), *_digest(p, column, ids)]

    plain = map_columns(small, [text_col], f"n_chunks int, {DIGEST}", run, lambda: pieces_of(model), rows=1024, size=1 << 20)
    return plain.unionByName(with_digest(_giants(giant, model, text_col, size), model, text_col))


def decode(p: Pieces, ids: list[np.ndarray]) -> list[str]:
    return [p.sp.decode(x.tolist()) if len(x) else "" for x in ids]
