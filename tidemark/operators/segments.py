"""Segments: bounded units for row windows, with the history each one needs.

Row-window features (rolling means, lags, oscillators, smoothing) look back a
known number of rows.  A series is cut into segments of about
``Series.segment_rows`` rows and every segment also receives the ``halo`` rows
before it, so windows partitioned by (symbol, segment) give the same values as
windows over the whole series while a symbol of any size is spread over many
tasks of equal size.  Rows are replicated by ``halo / segment_rows``.

Buckets are assigned to segments from their row offsets, so the full rows are
shuffled to their segments without having been numbered one by one first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .prefix import BUCKET, DEFAULT, Series, bucket_prefix

SEG = "_seg"
OWN = "_own"
RN = "_rn"
BLOCK = "_blk"


@dataclass
class Segmented:
    """Rows with segment columns, and the window specification over them."""

    df: DataFrame
    series: Series
    block_rows: int

    def __post_init__(self) -> None:
        # one specification object per frame, however many features use it
        keys = self.series.keys
        self.window = Window.partitionBy(*keys, SEG).orderBy(BLOCK, self.series.sort())
        block = Window.partitionBy(*keys, SEG, BLOCK).orderBy(self.series.sort())
        self.running = self.window.rowsBetween(Window.unboundedPreceding, 0)
        self.running_before = self.window.rowsBetween(Window.unboundedPreceding, -1)
        self.block_running = block.rowsBetween(Window.unboundedPreceding, 0)
        self._trailing: dict[int, WindowSpec] = {}

    def trailing(self, n: int) -> WindowSpec:
        if n not in self._trailing:
            self._trailing[n] = self.window.rowsBetween(-(n - 1), 0)
        return self._trailing[n]

    def previous(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(-n, -1)

    def select(self, *columns: Column | str) -> "Segmented":
        return Segmented(self.df.select(*columns), self.series, self.block_rows)

    def add(self, columns: dict[str, Column]) -> "Segmented":
        """One projection (and at most one Window node per frame key)."""
        if not columns:
            return self
        return Segmented(self.df.withColumns(columns), self.series, self.block_rows)

    def finish(self, *columns: Column | str) -> DataFrame:
        """Drop the history rows and the helper columns."""
        own = self.df.where(F.col(OWN))
        return own.select(*columns) if columns else own.drop(SEG, OWN, RN, BLOCK)


def fitted_rows(series: Series, rows: int, tasks: int, halo: int) -> Series:
    """Smaller segments where a table is too small to occupy every task.

    Never below twice the halo, so history is at most half of the work."""
    even = max(rows // max(2 * tasks, 1), 2 * halo)
    return series.with_(segment_rows=min(series.segment_rows, even))


def segment(
    df: DataFrame,
    halo: int,
    series: Series = DEFAULT,
    lasts: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    extra: DataFrame | None = None,
    block_rows: int = 1 << 20,
) -> Segmented:
    """Distribute ``df`` into segments carrying ``halo`` rows of history.

    Each segment starts at a bucket border.  For columns in ``lasts`` the last
    non-null value before the segment's first row is added as ``<c>__carry``;
    for ``sums`` the total of the expression over all rows before it.  ``extra``
    supplies further ``<c>__before`` columns per (symbol, bucket).
    """
    sums = sums or {}
    if series.reverse and lasts:
        raise ValueError("carried values need a forward series")
    keys = list(series.keys)
    rows = series.bucketed(df)
    known = lambda c: F.when(F.col(c).isNotNull(), F.expr(series.position))
    summary = rows.groupBy(*keys, BUCKET).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.col(c), known(c)).alias(c) for c in lasts],
        *[F.sum(e).alias(c) for c, e in sums.items()],
    )
    prefix = bucket_prefix(
        summary, keys, sums=["_n", *sums], lasts=lasts, bounded=series.bounded
    )
    size = F.lit(series.segment_rows)
    own = F.floor(F.col("_n__before") / size)
    # last segment whose history reaches back into this bucket
    reach = F.floor((F.col("_n__before") + F.col("_n") + F.lit(halo - 1)) / size)
    carries = [f"{c}__before" for c in (*lasts, *sums)]
    if extra is not None:
        carries += [c for c in extra.columns if c.endswith("__before")]
        prefix = prefix.join(extra, [*keys, BUCKET], "left")
    plan = prefix.select(
        *keys,
        BUCKET,
        F.col("_n__before").alias("_start"),
        own.alias("_home"),
        F.greatest(own, reach).alias("_reach"),
        *carries,
    )
    # window work is heavy per byte, so the partition count is stated: adaptive
    # coalescing by size would put many segments into one task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = (
        rows.join(plan, [*keys, BUCKET])
        .withColumn(SEG, F.explode(F.sequence("_home", "_reach")))
        .withColumn(OWN, F.col(SEG) == F.col("_home"))
        .repartition(tasks, *keys, SEG)
    )
    order = Window.partitionBy(*keys, SEG).orderBy(series.sort())
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = spread.select(
        *df.columns,
        SEG,
        OWN,
        (F.row_number().over(order) - 1 + F.first("_start").over(first)).alias(RN),
        *[F.first(c).over(first).alias(c.replace("__before", "__carry")) for c in carries],
    )
    blocked = numbered.withColumn(BLOCK, F.floor(F.col(RN) / F.lit(block_rows)))
    return Segmented(blocked, series, block_rows)
