"""A corpus from documents to token ids: language, near duplicates, benchmark leaks, secrets, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import decontaminate, language, pieces, secrets, simhash
from lumengraph.llm.common import scratch, written
from lumengraph.llm.queries import TOKENIZER

#: Documents stay from this share of the likelihoods on.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that stands out, go; null and empty texts are among them.

    The others stay as they are, with all their columns, however they are called. Texts count whole, however long; where two
    languages code a text equally well, neither stands out. Repeated rows share their fate; no documents, no result.
    """
    out = language.tagged(docs, language.train(docs), lang_name="_lang_pred", score_name="_score")
    return out.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; null and empty texts are one group.

    Of repeated rows one stays; of different texts with the smallest id one, always the same; documents without an id all
    stay. Texts are read whole, all columns stay, and no documents give no result.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds an item of the benchmark go, repeated ones all.

    Null and empty texts hold none and stay, as all do if the benchmark is empty. Texts are searched whole; all columns stay.
    """
    with scratch(spark):
        return decontaminate.without_leaks(docs, decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, wherever they stand in it; n_chars, if there is such a column, follows.

    A null text stays null and an empty one empty; every row stays, repeated ones too, and so do all other columns, also one
    that is called secrets.
    """
    out = secrets.find(docs, out_col="_secrets").withColumn("text", secrets.redacted(F.col("text"), F.col("_secrets")))
    out = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(*(f"`{c}`" for c in docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_pieces, ids) of every row; null and empty texts have no ids.

    Repeated rows and null ids are kept, long texts and words are encoded whole, other columns are left out. The documents
    are those that the stage before has written, so that they come in the same order each time they are read.
    """
    return pieces.encode(docs, pieces.load(spark, TOKENIZER), stable=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table of documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
