"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, slices, without

#: Labelled documents of each language that the model is fitted on (in expectation), how often a word has to occur in them, and the longest n-gram.
SAMPLE, LEAST_COUNT, LONGEST = 5_000, 2, 4
EDGE = "\x01"
_TRIM = ".,;:!?\"'()[]{}<>*_-0123456789"


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: dict[str, int] = field(default_factory=dict)
    gram_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def grams_of(word: str, n: int) -> list[str]:
    w = f"{EDGE}{word}{EDGE}" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def words_of(text: str) -> Counter:
    """Lower-case words without marks around them, and how often they occur."""
    out: Counter = Counter()
    for w, c in Counter(text.lower().split()).items():
        out[w.strip(_TRIM)] += c
    out.pop("", None)
    return out


def _count(batches):
    """Word and n-gram counts of each language, joined within a few megabytes of text."""
    for batch in (b.slice(at, n) for b in batches for at, n in slices([b.column(0)], 4096, 4 << 20)):
        by: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(words_of(text))
        rows: list[tuple] = []
        for lang, words in by.items():
            grams: Counter = Counter()
            for w, c in words.items():
                rows.append((lang, 0, w, c))
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        grams[g] += c
            rows += [(lang, 1, g, c) for g, c in grams.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["lang", "kind", "gram", "n"])


def fit(df: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> Model:
    """Model from the rows given, of which a hash of id and text draws about `sample` of each language at most, from all of the table alike.

    Rows with a null text or language take no part; empty texts add nothing.
    Rows that repeat an id and a text are drawn together. The model holds all
    n-grams of the draw and the words that occur LEAST_COUNT times in it,
    whatever the size of the table. A table without labelled rows gives a model
    without languages. Other columns, whatever their names, play no part.
    """
    slim = df.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l"), F.col(f"`{id_col}`").alias("i")).filter("t is not null and l is not null")
    sizes = slim.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()  # one row for each language
    langs = [r["l"] for r in sizes]
    if not langs:
        return Model([])
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], sample / r["n"])])
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(6), "i", "t"), 11) / F.lit(float(1 << 53))
    drawn = slim.filter(spread < F.element_at(share, F.col("l")))
    counts = drawn.select("t", "l").mapInArrow(_count, "lang string, kind int, gram string, n long")
    counts = counts.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    per = counts.groupBy("kind", "gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    kept = per.filter((F.col("kind") == 1) | (F.col("total") >= LEAST_COUNT)).select("kind", "gram", "by")
    at = {x: i for i, x in enumerate(langs)}
    grams: tuple[dict[str, int], dict[str, int]] = ({}, {})
    table = kept.toArrow()  # of the draw's texts alone
    kinds, by = table.column("kind").to_numpy(), table.column("by").combine_chunks()
    names = table.column("gram").to_pylist()
    row = np.repeat(np.arange(len(kinds)), np.diff(by.offsets.to_numpy()))
    lang = np.array([at[x] for x in by.values.field("lang").to_pylist()], np.int64)
    c = np.full((len(kinds), len(langs)), 0.5)
    c[row, lang] += by.values.field("n").to_numpy()
    scores = []
    for kind in (0, 1):
        mine = np.flatnonzero(kinds == kind)
        mine = mine[np.argsort([names[i] for i in mine], kind="stable")] if len(mine) else mine
        grams[kind].update((names[i], j) for j, i in enumerate(mine))
        part = c[mine]
        scores.append(np.log(part / np.maximum(part.sum(0), 1e-300)).astype(np.float32))
    return Model(langs, grams[0], scores[0], grams[1], scores[1])


class Scorer:
    """Scores whole texts; keeps the vectors of unseen words, up to a bound."""

    def __init__(self, model: Model, cache: int = 100_000):
        self.m, self.cache = model, cache
        self.seen: dict[str, np.ndarray] = {}
        self.posteriors = self._softmax(model.word_scores) if model.langs else None

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(-1, keepdims=True)) if len(x) else x
        return e / e.sum(-1, keepdims=True) if len(x) else x

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the known n-grams of the longest order that has any."""
        v = self.seen.get(word)
        if v is None:
            v = np.zeros(len(self.m.langs), np.float32)
            for n in range(LONGEST, 0, -1):
                found = [i for g in grams_of(word, n) if (i := self.m.grams.get(g)) is not None]
                if found:
                    v = self.m.gram_scores[found].mean(0)
                    break
            if len(self.seen) >= self.cache:
                self.seen.clear()
            self.seen[word] = v
        return v

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.m.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        ids, n, rest, rest_n = [], [], [], []
        known = self.m.words
        for w, c in words_of(text).items():
            i = known.get(w)
            if i is None:
                rest.append(self.backoff(w))
                rest_n.append(c)
            else:
                ids.append(i)
                n.append(c)
        total, share, words = np.zeros(len(self.m.langs)), np.zeros(len(self.m.langs)), 0
        if ids:
            k = np.asarray(n, np.float64)
            total += k @ self.m.word_scores[ids]
            share += k @ self.posteriors[ids]
            words += k.sum()
        if rest:
            k, v = np.asarray(rest_n, np.float64), np.stack(rest)
            total += k @ v
            share += k @ self._softmax(v)
            words += k.sum()
        best = int(np.argmax(total))  # ties: the first language by code point
        return self.m.langs[best], float(min(1.0, max(0.0, share[best] / max(words, 1))))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score; columns of these names are replaced.

    score is the mean over words of the posterior of the predicted language.
    Null texts and texts without a letter (or a model without languages) get
    und and 0. Ties go to the language that comes first by code point. Rows
    are judged alone, a very long text by all its words; an empty table stays
    empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by that of the draw it was fitted on

    def run(scorer: Scorer, text: pa.Array) -> list:
        out = [scorer.score(t) for t in text.to_pylist()]
        return [[x[0] for x in out], [x[1] for x in out]]

    base = without(df, ["lang_pred", "score"])
    return map_columns(base, [text_col], "lang_pred string, score double", run, setup=lambda: Scorer(shared.value))


def training_rows(df: DataFrame, held_out: Column) -> DataFrame:
    return df.filter(~held_out)
