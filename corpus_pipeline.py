"""From raw documents to tokens: five stages, each a table written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkboard.llm import bpe, langid, lines, mixing, simhash
from sparkboard.llm.queries import MIX_LEAST, MIX_POWERS, language_fits, language_model, margins, tokenizer_file
from sparkboard.llm.shared import column, dropped, free_name, saved, shipped


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; texts without a letter, foreign prose and letter noise go.

    The model and its limits come from all learning texts, whatever their number.
    """
    shipped(spark)
    model = language_model(docs, per_language=None)
    return langid.accepted(docs, model, usual=language_fits(docs, model, per_language=None))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go, and documents of which nothing else is left."""
    found = lines.without_repeats(docs, counts="__counts")
    nothing_left = (F.col("__counts.n_removed") > 0) & (F.col("__counts.n_removed") == F.col("__counts.n_lines"))
    n_chars = F.when(F.col("__counts.n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.where(~nothing_left).withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    shipped(spark)
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of source, language and topic; null and very small categories keep theirs."""
    name = free_name("mix", docs.columns)
    mixed = mixing.mixed(docs, margins(), MIX_POWERS, least=MIX_LEAST, name=name)
    return mixed.where(f"{name}.kept").select(*map(column, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the text they decode to."""
    shipped(spark)
    return bpe.encoded(docs, tokenizer_file(), keep=("lang", "source")).withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix),
    ("BPE", tokens),
]

#: The language model and the tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder: (doc_id, lang, source, n_tokens, ids, decoded_sha256)."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        dropped(*written)
        written = [docs]
    return docs
