"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows that the stage before it
kept; all but the last return the columns of ``documents``, and pass other columns through.

Defined results: null texts go in the first stage (a null text given to a later one stays
as it is, as an empty one where it is read); rows that repeat an id are judged one by one,
except that copies are near-duplicates, of which the smallest id stays; null ids are kept,
and come last in ties; a stage given no rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from tracelake.llm.common import crc_mod, materialize, quoted
from tracelake.llm.queries import vocabulary

#: Texts whose best language is less likely than this are rejected.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter (null and empty ones among them) and texts of no clear language.

    Where no row with a language is there to learn from, nothing can be judged and all rows stay.
    """
    model = language_id.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    if model is None:
        return docs
    predicted = language_id.predict(docs, model)
    return predicted.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select([F.col(quoted(c)) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has; ``n_chars`` follows the text, a null one stays null if no line goes."""
    out = line_dedup.dedup_lines(docs)
    text = F.col("kept_text")
    changed = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
    return out.select([changed.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: its smallest id, of several rows with it any one; texts without words are alike only if equal."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark passages make up a twentieth of the words or more; texts without words stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents left, packed into sequences; a null text is one end token."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
