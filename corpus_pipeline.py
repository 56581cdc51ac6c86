"""A training corpus from raw documents: five operators of ``tidemark.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of the table they were given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, langid, mixing, simhash
from tidemark.llm.common import bound_batches, crc_mod
from tidemark.session import stored

#: Language ID, SimHash fingerprints, a seeded mix and BPE are beyond SQL: tests compare with brute force.
ORACLE_SQL: str | None = None


def _wrapped(docs: DataFrame) -> DataFrame:
    """The row as one column, so that its names cannot clash with those of an operator."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "lang", "source")


def _small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: fewer of them in an Arrow batch, so that workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    bound_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or torn between languages, go."""
    _small_batches(spark)
    model = langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    told = langid.predict(_wrapped(docs).select("doc", "text"), model)
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= 0.5)).select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(_wrapped(docs), carry=["doc"]).where("kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    _small_batches(spark)
    return simhash.drop_near_copies(docs, shingle=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    mixed = mixing.mix(_wrapped(docs), carry=["doc"]).where("times > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and whether they decode to it."""
    _small_batches(spark)
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")), "text", "ids", "decoded")
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
