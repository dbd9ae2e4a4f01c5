"""From raw documents to token ids: language, quality, near duplicates, mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but
the last return the columns of docs; the last returns ids for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import language, mixing, near_dedup, piece_scan, quality
from pointloom.llm.common import crc_mod, drop_made, drop_staged, made, staged, unwrapped, wrapped
from pointloom.llm.queries import tokenizer_path

#: Texts whose words fit their best language worse than this have no language.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones.

    Null texts, empty ones and texts without letters go; of a very long text
    every word counts. Rows are judged alone, so repeats stay together. Other
    columns keep their values, whatever their names; an empty table stays empty.
    Ties between languages go to the first by code point.
    """
    keep = ["doc_id", "text"]
    model = language.fit(docs.filter(crc_mod(F.col("doc_id"), 5) != 0), "text", "lang", "doc_id")
    found = language.predict(wrapped(docs, keep), model)
    return unwrapped(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs, keep)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on their whole text.

    Null and empty texts have too few words and go. Rows are judged alone, so
    repeats stay together and there are no ties. Other columns keep their
    values, whatever their names; an empty table stays empty.
    """
    keep = ["doc_id", "text"]
    return unwrapped(quality.quality(wrapped(docs, keep)).filter("kept"), docs, keep)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least id, then the least hash of the text.

    Null texts and texts without words are each alone and stay; rows that
    repeat id and text stay once. Other columns keep their values, whatever
    their names; an empty table stays empty.
    """
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; a document may repeat.

    A null source is a source. Null and empty texts have no words: they cost
    nothing and follow their source's rate. Documents of a source that agree in
    id and text are taken alike. Other columns keep their values, whatever
    their names; an empty table stays empty.
    """
    keep = ["doc_id", "text", "source"]
    return unwrapped(mixing.mixed_rows(mixing.mix(wrapped(docs, keep))), docs, keep)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every row.

    Null and empty texts have no ids; very long texts are scanned in chunks.
    Repeated rows stay; an empty table stays empty. Other columns are left out.
    """
    coded = piece_scan.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Language models, signatures and token ids have no SQL form; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what the stages before it wrote is deleted as soon as the next has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = made()
        new = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            new = staged(new, name)
            drop_made(spark, before, new)
            if i:
                drop_staged(docs)
        docs = new
    return docs
