import collections
import re

import corpus_pipeline as P
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F
from test_llm import classes

from pointloom.llm.queries import tokenizer_path


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    language = P.language_id(spark, docs, SF)
    assert language.columns == docs.columns and language.count() > 0.9 * len(texts)
    good = P.quality_rules(spark, language, SF).cache()
    assert good.columns == docs.columns and 0.5 * len(texts) < good.count() < language.count()
    kept = P.near_duplicates(spark, good, SF).cache()
    have = {r["doc_id"]: r["text"] for r in good.collect()}
    assert {r["doc_id"] for r in kept.collect()} == set(classes(have).values())
    mixed = P.mix_sources(spark, kept, SF).cache()
    assert mixed.columns == docs.columns
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert set(times.values()) <= {1, 2} and set(times) <= {r["doc_id"] for r in kept.collect()}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r["text"]) for r in kept.collect())
    assert abs(sum(n * words(texts[k]) for k, n in times.items()) - 1.5 * total) < 0.1 * total
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    coded = P.encode_pieces(spark, mixed, SF).collect()
    assert len(coded) == sum(times.values()) and all(r["ids"] == sp.encode(texts[r["doc_id"]]) for r in coded)


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "12345", "en", "a", 5), (3, "the cat is on the mat and the dog is in the house of the man", "en", "a", 60)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        df = stage(spark, df, SF)
        assert df.count() >= 0, name
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_own_columns_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clash = ["kept", "score", "lang_pred", "copies", "copy", "size", "target", "rate", "n_words", "_id", "_th", "_n", "_own", "_s", "cut", "unit", "id", "th", "node", "ids", "n_chunks", "source_size", "Taken"]
    own = docs.select(*docs.columns, *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in clash])
    plain = docs
    for name, stage in P.STAGES:
        own, plain = stage(spark, own, SF), stage(spark, plain, SF)
        if name != "encode_pieces":
            assert own.columns == [*docs.columns, *clash]
            rows = own.collect()
            assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in clash), name
        else:
            rows = own.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in plain.collect()), name
