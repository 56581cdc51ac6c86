"""One query for each operator, over its whole table.

Each query reads the table, applies the operator with production parameters and
derives the contract's digest columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    bpe,
    decontaminate,
    exact_dedup,
    langid,
    license_scan,
    mixing,
    negatives,
    ngram_lm,
    phrases,
    sharding,
    simhash,
    token_counts,
)

from .common import crc_mod

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth id."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays; every row's group and digest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(exact_dedup.normalised("text"), 256))
    return exact_dedup.exact_dedup(docs, carry=["doc_id", "text_sha256"])


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, "text", "ids").select("doc_id", "ids")
    both = bpe.decode(coded, "ids", "decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token count of every whole text."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), limit=4096)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal size."""
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    model = langid.train(docs.where(~F.col("held_out")))
    found = langid.predict(docs.select("doc_id", "held_out", "text"), model, score="score")
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of those that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 7) == 2
    shared, tries = ngram_lm.train(docs.where(~held_out))
    scored = ngram_lm.score(docs, shared, tries)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(shared.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and the items met."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    length = F.transform("hits", lambda x: (x[1] - x[0] + 1).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(length, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has another label."""
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def queries() -> dict[str, Query]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.all_sql()
