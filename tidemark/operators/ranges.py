"""Running sums along values, however they are distributed.

Ranks, curves and inversions need sums over all smaller values.  One task cannot
sort a column, and ranges of equal width fail where the values crowd.  Here the
rows are dealt by Spark's sampled range partitioning, so that ranges follow the
values; the ranges' sums are added up (a row a range), and a window inside a range
does the rest.  The rows should be aggregated by value before, so that a value
that most rows have is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a range, about.
ROWS = 1 << 17
RANGE = "_range"


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str = "ranges", size: int | None = None) -> DataFrame:
    """``rows`` with the number of their range: stretches of about ``size`` (``ROWS``) rows by keys and order."""
    rows = stored(rows, label)
    ranges = -(-rows.count() // (size or ROWS))
    if ranges <= 1:
        return rows.withColumn(RANGE, F.lit(0))
    # stored, as the sample may differ when it is drawn again
    return stored(rows.repartitionByRange(ranges, *keys, *order).withColumn(RANGE, F.spark_partition_id()), label)


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Sequence[str], label: str = "ranges") -> DataFrame:
    """``rows`` with ``<c>__before``, the sum of ``c`` over the rows in front of it, and ``<c>__total`` over its key.

    ``keys`` must not be null, and ``order`` must tell all rows of a key apart.
    """
    dealt = in_ranges(rows, keys, order, label)
    parts = dealt.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(f"{c}__sum") for c in sums])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys,
        RANGE,
        *[F.coalesce(F.sum(f"{c}__sum").over(before), F.lit(0)).alias(f"{c}__ahead") for c in sums],
        *[F.sum(f"{c}__sum").over(Window.partitionBy(*keys)).alias(f"{c}__total") for c in sums],
    )
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(parts, [*keys, RANGE]).select(
        *rows.columns,
        *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{c}__ahead")).alias(f"{c}__before") for c in sums],
        *[f"{c}__total" for c in sums],
    )


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], value: str, often: str, total: int, share: int = 200) -> DataFrame:
    """``rows`` with ``value`` from ``table``, which has one row for each of the rows' keys.

    ``table`` says in ``often`` how many rows have a key.  Keys of more than a
    ``share``-th of ``total`` rows are at most ``share`` and broadcast; the others
    meet by a shuffle in which none has more than that.
    """
    hot = F.col(often) * share > F.lit(total)
    few = F.broadcast(table.where(hot).select(*keys, F.col(value).alias("_hot")))
    met = rows.join(few, list(keys), "left")
    cold = met.where(F.col("_hot").isNull()).drop("_hot").join(table.where(~hot).select(*keys, value), list(keys))
    return met.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", value).unionByName(cold)
