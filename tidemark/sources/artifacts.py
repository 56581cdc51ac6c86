"""Prepared datasets, feature sets, reports and models on storage
(S9-S13, S15-S17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import feature_set_hash


# ------------------------------------------------------------------ datasets
def split_metadata(
    df: DataFrame, features: Sequence[str], target: str = "target", order: str = "ts"
) -> DataFrame:
    """Size, span and target distribution per split."""
    t = F.col(target)
    stats = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min(order).alias("start"),
        F.max(order).alias("end"),
        F.min(t).cast("double").alias("target_min"),
        F.max(t).cast("double").alias("target_max"),
        F.avg(t).alias("target_mean"),
        F.stddev_samp(t).alias("target_std"),
    )
    return stats.withColumns(
        {
            "n_features": F.lit(len(features)),
            "target_type": F.lit(dict(df.dtypes)[target]),
        }
    )


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy("split", target).agg(F.count(F.lit(1)).alias("count"))


def export_datasets(
    df: DataFrame,
    path: str,
    feature_set_id: str,
    features: Sequence[str],
    target: str = "target",
    created_at: str = "",
    tags: dict[str, str] | None = None,
) -> None:
    """One table by split plus a metadata record."""
    home = f"{path}/datasets_{feature_set_id}"
    keys = [c for c in ("symbol", "ts") if c in df.columns]
    data = df.select(*keys, *features, target, "split")
    data.write.mode("overwrite").partitionBy("split").parquet(f"{home}/data")
    meta = split_metadata(df, features, target).withColumns(
        {
            "feature_set_id": F.lit(feature_set_id),
            "created_at": F.lit(created_at),
            "feature_names": F.array(*[F.lit(f) for f in features]),
            "target": F.lit(target),
            "tags": F.to_json(F.create_map(*[F.lit(x) for kv in (tags or {}).items() for x in kv]))
            if tags
            else F.lit("{}"),
        }
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{home}/meta")


def load_datasets(
    spark: SparkSession, path: str, feature_set_id: str, split: str | None = None
) -> DataFrame:
    """One split, or all with their ``split`` column."""
    df = spark.read.parquet(f"{path}/datasets_{feature_set_id}/data")
    return df.where(F.col("split") == split) if split else df


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    """Newest first."""
    meta = spark.read.json(f"{path}/datasets_*/meta")
    found = meta.groupBy("feature_set_id", "created_at").agg(
        F.sum("n_samples").alias("n_samples"), F.max("n_features").alias("n_features")
    )
    return found.orderBy(F.desc("created_at"), "feature_set_id")


# --------------------------------------------------------------- feature sets
_SET_SCHEMA = (
    "feature_set_id string, features array<string>, n_features int, config string, "
    "created_at string, description string"
)


def feature_set_record(
    spark: SparkSession,
    features: Sequence[str],
    config: str | None = None,
    created_at: str = "",
    description: str = "",
) -> DataFrame:
    """The stored form of a feature list (``config`` is JSON text)."""
    row = [(list(features), config, created_at, description)]
    schema = "features array<string>, config string, created_at string, description string"
    df = spark.createDataFrame(row, schema)
    return df.select(
        feature_set_hash(F.col("features"), F.col("config")).alias("feature_set_id"),
        F.array_sort("features").alias("features"),
        F.size("features").alias("n_features"),
        "config",
        "created_at",
        "description",
    )


def save_feature_set(record: DataFrame, path: str) -> str:
    set_id = record.first()["feature_set_id"]
    record.coalesce(1).write.mode("overwrite").json(f"{path}/feature_sets/{set_id}")
    return set_id


def load_feature_set(spark: SparkSession, path: str, set_id: str) -> DataFrame:
    return spark.read.schema(_SET_SCHEMA).json(f"{path}/feature_sets/{set_id}")


def list_feature_sets(spark: SparkSession, path: str) -> DataFrame:
    sets = spark.read.schema(_SET_SCHEMA).json(f"{path}/feature_sets/*")
    return sets.orderBy(F.desc("created_at"), "feature_set_id")


# ------------------------------------------------------------ reports, models
def save_comparison(metrics: DataFrame, path: str, metric: str = "accuracy") -> None:
    """Model comparison as CSV, best first."""
    best_first = metrics.orderBy(F.desc(metric))
    best_first.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each report table as parquet."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def save_model(model, path: str) -> None:
    """S15."""
    model.write().overwrite().save(path)
