"""Time-ordered splits.

Splits are columns, not separate tables.  They come from each row's position,
computed without sorting a whole series in one task; fold membership is
arithmetic on that position, so no fold table is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import DEFAULT, Series, row_index


def indexed(df: DataFrame, series: Series = DEFAULT) -> DataFrame:
    return row_index(df, series, "rn", "n")


def _share(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(ratio)).cast("bigint")


def ratio_split(
    df: DataFrame,
    train_ratio: float = 0.6,
    val_ratio: float = 0.2,
    test_ratio: float | None = None,
    series: Series = DEFAULT,
) -> DataFrame:
    """``split`` = train / val / test by position."""
    test = 1.0 - train_ratio - val_ratio if test_ratio is None else test_ratio
    if not math.isclose(train_ratio + val_ratio + test, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"ratios sum to {train_ratio + val_ratio + test}, not 1")
    rn, n = F.col("rn"), F.col("n")
    split = (
        F.when(rn < _share(n, train_ratio), "train")
        .when(rn < _share(n, train_ratio + val_ratio), "val")
        .otherwise("test")
    )
    return indexed(df, series).withColumn("split", split)


def date_split(
    df: DataFrame, train_end: str, val_end: str, order: str = "ts"
) -> DataFrame:
    """Inclusive upper bounds; no shuffle."""
    t = F.col(order)
    split = (
        F.when(t <= F.lit(train_end).cast("timestamp"), "train")
        .when(t <= F.lit(val_end).cast("timestamp"), "val")
        .otherwise("test")
    )
    return df.withColumn("split", split)


def _members(frame: DataFrame, folds: Column) -> DataFrame:
    return frame.withColumn("_m", F.explode(folds)).select(
        *[c for c in frame.columns if not c.startswith("_")], "_m.fold", "_m.role"
    )


def _expanding(fold_size: Column, position: Column, k: int) -> Column:
    """Folds 1..k: train = blocks before block i, val = block i."""
    block = F.floor(F.try_divide(position, fold_size)).cast("int")
    train = F.transform(
        F.when(block < k, F.sequence(F.greatest(block + 1, F.lit(1)), F.lit(k))),
        lambda i: F.struct(i.alias("fold"), F.lit("train").alias("role")),
    )
    val = F.when(
        (block >= 1) & (block <= k),
        F.array(F.struct(block.alias("fold"), F.lit("val").alias("role"))),
    )
    return F.concat(F.coalesce(train, F.array()), F.coalesce(val, F.array()))


def cv_split(
    df: DataFrame, n_splits: int = 5, test_ratio: float = 0.2, series: Series = DEFAULT
) -> DataFrame:
    """Expanding folds before a reserved tail; one row per membership."""
    cv = _share(F.col("n"), 1 - test_ratio)
    size = F.floor(cv / F.lit(n_splits + 1)).cast("bigint")
    frame = indexed(df, series).withColumn("_size", size).where(F.col("rn") < cv)
    return _members(frame, _expanding(F.col("_size"), F.col("rn"), n_splits))


def series_folds(df: DataFrame, n_splits: int = 5, series: Series = DEFAULT) -> DataFrame:
    """The last k blocks are tests; training rows split 80/20 inside.

    Roles are ``train``, ``val`` (tail of the training rows) and ``test``.
    """
    n, k = F.col("n"), n_splits
    size = F.floor(n / F.lit(k + 1)).cast("bigint")
    # blocks counted from the end, so the first block takes the remainder
    shifted = F.col("rn") - (n - size * (k + 1))
    frame = indexed(df, series).withColumn("_size", size)
    frame = frame.withColumn("_block", F.greatest(shifted, F.lit(0)))
    members = _members(frame, _expanding(F.col("_size"), F.col("_block"), k))
    start = F.col("n") - F.floor(F.col("n") / F.lit(k + 1)) * (k + 1 - F.col("fold"))
    inner = F.floor(start * F.lit(0.8))
    role = (
        F.when(F.col("role") == "val", "test")
        .when(F.col("rn") < inner, "train")
        .otherwise("val")
    )
    return members.withColumn("role", role)


def walk_forward_split(
    df: DataFrame, train_size: int, val_size: int, step_size: int, series: Series = DEFAULT
) -> DataFrame:
    """Sliding windows; a row joins every window that covers it."""
    rn, n = F.col("rn"), F.col("n")
    width = train_size + val_size
    last = F.floor((n - width) / F.lit(step_size))
    first = F.greatest(F.ceil((rn - width + 1) / F.lit(step_size)), F.lit(0))
    upto = F.least(F.floor(rn / F.lit(step_size)), last)
    windows = F.when((n >= width) & (first <= upto), F.sequence(first, upto))
    role = lambda w: F.when(rn - w * step_size < train_size, "train").otherwise("val")
    folds = F.transform(
        windows, lambda w: F.struct((w + 1).cast("int").alias("fold"), role(w).alias("role"))
    )
    return _members(indexed(df, series), folds)


def purge_and_embargo(
    df: DataFrame,
    purge: int = 0,
    embargo: int = 0,
    train_ratio: float = 0.6,
) -> DataFrame:
    """X5 on a ratio-split table: drop the last ``purge`` training rows and the
    first ``embargo`` validation rows of each series.

    The borders follow from the position and size columns, so nothing is
    shuffled.
    """
    rn, n = F.col("rn"), F.col("n")
    val_start = _share(n, train_ratio)
    keep = (
        F.when(F.col("split") == "train", rn < val_start - purge)
        .when(F.col("split") == "val", rn >= val_start + embargo)
        .otherwise(True)
    )
    return df.where(keep)


def split_statistics(df: DataFrame, column: str) -> DataFrame:
    """Numeric summary of a column per split."""
    c = F.col(column)
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def split_class_counts(df: DataFrame, column: str) -> DataFrame:
    """Class counts and shares per split."""
    counts = df.groupBy("split", column).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("split"))
    return counts.withColumn("pct", F.col("count") * 100.0 / total)
