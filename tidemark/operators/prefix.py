"""Prefix values along a series without ever holding a series in one task.

A series (all rows of one ``symbol``) may hold a large share of a table, so a
plain ``Window.partitionBy(symbol)`` would put it on one executor thread.
Everything that looks back without bound (row numbers, running sums, last
known value) is instead split by time *bucket*:

1. one partial-aggregated summary row per (symbol, bucket);
2. an exclusive prefix over the summaries; where their number per symbol is
   not bounded by the calendar it is done in two levels, so that a symbol with
   very many buckets is spread as well;
3. bucket prefix + a window inside (symbol, bucket).

Only step 3 touches full rows, and its partitions are bounded by the bucket.  Where
rows may crowd in time (ticks), ``Series.dense`` cuts buckets by rows instead: they
are ranges of the sorted series, dealt by Spark's sampled splitters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_us
from .ranges import RANGE, in_ranges

BUCKET = "_bucket"
_GROUP = "_bucket_group"
_FANOUT = 1024


@dataclass(frozen=True)
class Series:
    """How a table of ordered series is keyed, ordered and cut into buckets.

    ``bucket_seconds`` bounds the rows of one bucket: with a bar every five
    minutes a day holds 288 rows per symbol.  ``segment_rows`` is the size of
    the units in which row-window features are computed.  ``dense`` is the number
    of rows of a bucket that is cut by rows, wherever they lie in time (0: by time);
    ``ties`` then tells rows of one time apart, so that they can be cut as well.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: str = "ts"
    bucket_seconds: int = 86_400
    segment_rows: int = 16_384
    reverse: bool = False
    dense: int = 0
    ties: tuple[str, ...] = ()

    def with_(self, **changes) -> "Series":
        return replace(self, **changes)

    def bucket(self) -> Column:
        width = self.bucket_seconds * 1_000_000
        number = F.floor(epoch_us(self.order) / F.lit(width)).cast("bigint")
        return -number if self.reverse else number

    @property
    def bounded(self) -> bool:
        """Buckets of a day or more: a century is 36 525 summaries a series."""
        return not self.dense and self.bucket_seconds >= 86_400

    def sort(self) -> Column:
        """Row order: ascending time, or descending when ``reverse`` is set."""
        return F.desc(self.order) if self.reverse else F.asc(self.order)

    @property
    def position(self) -> str:
        """SQL of what tells the rows of a series apart in order."""
        return f"struct({', '.join([self.order, *self.ties])})" if self.ties else self.order

    def falling(self) -> list[Column]:
        return [F.desc(c) for c in (self.order, *self.ties)]

    def bucketed(self, df: DataFrame) -> DataFrame:
        if self.dense:
            return in_ranges(df, self.keys, [self.sort(), *self.ties], "dense", self.dense).withColumnRenamed(RANGE, BUCKET)
        return df.withColumn(BUCKET, self.bucket())

    def in_bucket(self):
        return Window.partitionBy(*self.keys, BUCKET).orderBy(self.sort(), *self.ties)


DEFAULT = Series()


def _scans(
    part: str,
    order: str,
    before: str,
    after: str,
    sums: Sequence[str],
    lasts: Sequence[str],
    nexts: Sequence[str],
) -> list[tuple[str, str]]:
    """Exclusive scans of a summary as ``(name, SQL)``."""
    span = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    part = f"PARTITION BY {part} " if part else ""
    past = f"({part}ORDER BY {order} {span})"
    future = f"({part}ORDER BY {order} DESC {span})"
    out = [(f"{c}{before}", f"coalesce(sum(`{c}`) OVER {past}, 0)") for c in sums]
    out += [(f"{c}{before}", f"last(`{c}`) IGNORE NULLS OVER {past}") for c in lasts]
    out += [(f"{c}{after}", f"last(`{c}`) IGNORE NULLS OVER {future}") for c in nexts]
    return [(name, f"{sql} AS `{name}`") for name, sql in out]


def bucket_prefix(
    summary: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    nexts: Sequence[str] = (),
    totals: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """Exclusive prefixes over bucket summaries.

    ``sums`` gives ``<c>__before`` = sum over earlier buckets, ``lasts`` gives
    ``<c>__before`` = nearest earlier non-null value, ``nexts`` gives
    ``<c>__after`` = nearest later non-null value.  ``totals``, a part of
    ``sums``, also gives ``<c>__total`` over the whole series.  ``bounded``
    states that a series has few buckets whatever its rows, so that one window
    over its summaries is enough; else the prefix is taken in two levels.

    Expressions are written as SQL text here and in the fills: these plans
    have a column per feature, and text is one driver call per column.
    """
    by = ", ".join(keys)
    all_rows = f"(PARTITION BY {by})" if by else "()"
    if bounded:
        return summary.selectExpr(
            *[f"`{c}`" for c in summary.columns],
            *[e for _, e in _scans(by, BUCKET, "__before", "__after", sums, lasts, nexts)],
            *[f"sum(`{c}`) OVER {all_rows} AS `{c}__total`" for c in totals],
        )
    known = f"CASE WHEN `{{c}}` IS NOT NULL THEN {BUCKET} END"
    grouped = summary.withColumn(_GROUP, F.floor(F.col(BUCKET) / F.lit(_FANOUT)))
    top = grouped.groupBy(*keys, _GROUP).agg(
        *[F.expr(f"sum(`{c}`) AS `{c}`") for c in sums],
        *[F.expr(f"max_by(`{c}`, {known.format(c=c)}) AS `{c}`") for c in lasts],
        *[F.expr(f"min_by(`{c}`, {known.format(c=c)}) AS `{c}`") for c in nexts],
    )

    def scans(part: str, order: str, suffix: str) -> list[str]:
        return [e for _, e in _scans(part, order, suffix, "__n" + suffix, sums, lasts, nexts)]

    top = top.selectExpr(
        *keys,
        _GROUP,
        *scans(by, _GROUP, "__top"),
        *[f"sum(`{c}`) OVER {all_rows} AS `{c}__total`" for c in totals],
    )
    within = f"{by}, {_GROUP}" if by else _GROUP
    local = grouped.selectExpr("*", *scans(within, BUCKET, "__in"))
    joined = local.join(top, [*keys, _GROUP], "left")
    return joined.selectExpr(
        *[f"`{c}`" for c in summary.columns],
        *[f"coalesce(`{c}__in`, 0) + coalesce(`{c}__top`, 0) AS `{c}__before`" for c in sums],
        *[f"coalesce(`{c}__in`, `{c}__top`) AS `{c}__before`" for c in lasts],
        *[f"coalesce(`{c}__n__in`, `{c}__n__top`) AS `{c}__after`" for c in nexts],
        *[f"`{c}__total`" for c in totals],
    )


def row_index(
    df: DataFrame,
    series: Series = DEFAULT,
    name: str = "rn",
    size: str | None = None,
    bucket: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Exact 0-based position of every row inside its series.

    ``size`` also adds the number of rows of the series.  ``bucket`` replaces
    the time bucket for tables ordered by something else; ``bounded`` then says
    whether their number is.
    """
    rows = df.withColumn(BUCKET, bucket) if bucket is not None else series.bucketed(df)
    counts = rows.groupBy(*series.keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    totals = ["_n"] if size else []
    few = bounded if bucket is not None else series.bounded
    offsets = bucket_prefix(counts, series.keys, sums=["_n"], totals=totals, bounded=few)
    offsets = offsets.drop("_n")
    position = F.row_number().over(series.in_bucket()) - 1 + F.col("_n__before")
    added = [position.cast("bigint").alias(name)]
    if size:
        added.append(F.col("_n__total").cast("bigint").alias(size))
    return rows.join(offsets, [*series.keys, BUCKET]).select(*df.columns, *added)


def running_sum(
    df: DataFrame, columns: dict[str, str], series: Series = DEFAULT
) -> DataFrame:
    """Inclusive running sums ``{output: input}`` along each series."""
    rows = series.bucketed(df)
    totals = rows.groupBy(*series.keys, BUCKET).agg(
        *[F.sum(src).alias(f"_s_{out}") for out, src in columns.items()]
    )
    sums = [f"_s_{out}" for out in columns]
    before = bucket_prefix(totals, series.keys, sums=sums, bounded=series.bounded).drop(*sums)
    window = series.in_bucket().rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(before, [*series.keys, BUCKET])
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(src).over(window), F.lit(0)) + F.col(f"_s_{out}__before")).alias(out)
            for out, src in columns.items()
        ],
    )
