"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, without

WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "the", "of", "and", "to", "in", "that", "is", "was", "it", "for", "with", "as", "by", "on", "this", "are", "be", "an", "or", "not",
    "der", "die", "das", "und", "ist", "von", "mit", "den", "dem", "zu", "sich", "ein", "eine", "nicht", "auf", "für", "im", "er", "auch", "des",
    "le", "la", "les", "de", "et", "un", "une", "en", "que", "qui", "dans", "pour", "est", "pas", "sur", "au", "avec", "du", "plus", "par",
    "el", "los", "las", "y", "se", "por", "con", "una", "su", "para", "es", "lo", "como", "más", "o", "pero", "sus", "del", "al", "no",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a bound of None is open."""

    metric: str
    low: float | None
    high: float | None


#: The method's verdict. Ratios are shares of words, of characters in words, or of lines with words.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.02, None),
    Rule("words_per_line", 1.0, None),
)

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _bound(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row: the argument of a lambda is not inlined."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def repeat_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of width words found twice or more in the text, the first one included.

    Windows are compared by a 64-bit hash of their words. A text whose windows
    all differ takes only the distinctness test.
    """

    def covered(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            at = F.transform(
                s,
                lambda x, i: F.when(
                    F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)), x["i"]
                ),
            )
            return F.array_sort(F.array_compact(at))

        return F.aggregate(
            _bound(tagged, starts),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct((p + width).alias("end"), (a["n"] + p + width - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"].cast("long"),
        )

    def counted(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) <= width, F.lit(0).cast("long")).otherwise(
            _bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
        )

    return _bound(F.transform(tokens, lambda w: F.xxhash64(w)), counted)


def measures(text: Column, tokens: Column) -> dict[str, Column]:
    """Columns by name; all take the whole text, a null one as empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(tokens),
        "n_stop_words": F.size(F.filter(tokens, lambda w: F.lower(w).isin(sorted(STOP_WORDS)))).cast("long"),
    }


def verdict(rules=RULES) -> Column:
    """All thresholds of the table as one boolean column over the measures."""
    ratio = lambda n, d: F.col(n) / F.greatest(F.col(d), F.lit(1))
    metrics = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "words_per_line": ratio("n_words", "n_lines"),
        "n_words": F.col("n_words"),
    }
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (metrics[r.metric] >= r.low)
        if r.high is not None:
            ok = ok & (metrics[r.metric] <= r.high)
    return ok


def quality(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """df with the measures, base_failed and kept; columns of these names that df has are replaced.

    Null and empty texts have no words and fail the base rule (under ten
    words). Rows are judged alone, so repeated rows and ties change nothing,
    and an empty table gives an empty table.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]
    base = without(df, [n for n in names if n.lower() != text_col.lower()] + ["_words"])
    split = base.withColumn("_words", words(F.col(f"`{text_col}`")))
    made = split.select(*[F.col(f"`{c}`") for c in base.columns], *[c.alias(k) for k, c in measures(F.col(f"`{text_col}`"), F.col("_words")).items()])
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return made.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
