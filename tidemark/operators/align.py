"""Bringing feeds onto one timeline.

Joins are on (symbol, ts), which spreads any symbol over the whole cluster;
deduplication and the liquidation aggregate use the same keys, so every feed
is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fill import fill
from .prefix import DEFAULT, Series


def keep_first(df: DataFrame, series: Series = DEFAULT, seq: str | None = None) -> DataFrame:
    """First row per (symbol, ts) by ``seq``.

    The rank limit is applied before the shuffle too, so a timestamp that is
    repeated very often does not reach one task whole.
    """
    tie = F.col(seq) if seq else F.xxhash64(*df.columns)
    w = Window.partitionBy(*series.keys, series.order).orderBy(tie)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def base_timeline(
    ohlcv: DataFrame, series: Series = DEFAULT, seq: str | None = None
) -> DataFrame:
    """A1: one row per (symbol, ts), timestamps as UTC instants."""
    typed = ohlcv.withColumn(series.order, F.col(series.order).cast("timestamp"))
    return keep_first(typed, series, seq)


def join_feed(
    base: DataFrame,
    feed: DataFrame,
    suffix: str,
    series: Series = DEFAULT,
    dedup: bool = True,
    seq: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Left equi join on (symbol, ts); clashing feed columns get a suffix.

    Returns the joined frame and the names of the feed's columns in it.
    """
    keys = [*series.keys, series.order]
    feed = feed.withColumn(series.order, F.col(series.order).cast("timestamp"))
    if dedup:
        feed = keep_first(feed, series, seq)
    if seq:
        feed = feed.drop(seq)
    names = {c: f"{c}{suffix}" if c in base.columns else c for c in feed.columns if c not in keys}
    renamed = feed.select(*keys, *[F.col(c).alias(n) for c, n in names.items()])
    return base.join(renamed, keys, "left"), list(names.values())


def align_feed(
    base: DataFrame,
    feed: DataFrame,
    name: str,
    fill_method: str | None = "ffill",
    series: Series = DEFAULT,
    seq: str | None = None,
) -> DataFrame:
    """A2: join one feed, then fill only what it brought."""
    joined, columns = join_feed(base, feed, f"_{name}", series, seq=seq)
    return fill(joined, columns, fill_method, series)


def align_feeds(
    ohlcv: DataFrame,
    feeds: dict[str, DataFrame],
    fill_method: str | None = "ffill",
    series: Series = DEFAULT,
    seq: str | None = None,
) -> DataFrame:
    """A3: all joins first, then one fill over all the columns they brought.

    Filling after the last join gives the same values as filling after each
    one, because a left join on unique keys never changes the base rows (for
    ``drop``: any missing feed column drops the row either way).
    """
    frame = base_timeline(ohlcv, series, seq)
    if seq:
        frame = frame.drop(seq)
    brought: list[str] = []
    for name, feed in feeds.items():
        if feed is not None:
            frame, columns = join_feed(frame, feed, f"_{name}", series, seq=seq)
            brought += columns
    return fill(frame, brought, fill_method, series) if brought else frame


def liquidation_bars(liquidations: DataFrame, series: Series = DEFAULT) -> DataFrame:
    """L1-L5 per timestamp.  A SELL closes a long position, a BUY a short."""
    q = F.col("quantity")
    return liquidations.groupBy(*series.keys, series.order).agg(
        F.sum(q).alias("liq_volume"),
        F.avg(q).alias("liq_avg_size"),
        F.count(q).alias("liq_count"),
        F.sum(F.when(F.col("side") == "SELL", q).otherwise(0)).alias("long_liq_volume"),
        F.sum(F.when(F.col("side") == "BUY", q).otherwise(0)).alias("short_liq_volume"),
    )


def join_liquidations(
    base: DataFrame, liquidations: DataFrame, series: Series = DEFAULT
) -> DataFrame:
    """Totals become 0 without liquidations, the side volumes stay NULL."""
    typed = liquidations.withColumn(series.order, F.col(series.order).cast("timestamp"))
    bars = liquidation_bars(typed, series)
    joined = base.join(bars, [*series.keys, series.order], "left")
    return joined.fillna(0, subset=["liq_volume", "liq_avg_size", "liq_count"])


def join_all(
    ohlcv: DataFrame,
    open_interest: DataFrame | None = None,
    funding: DataFrame | None = None,
    liquidations: DataFrame | None = None,
    ls_ratio: DataFrame | None = None,
    series: Series = DEFAULT,
    seq: str | None = None,
) -> DataFrame:
    """The joined frame the feature layers start from."""
    frame = base_timeline(ohlcv, series, seq)
    if seq:
        frame = frame.drop(seq)
    for feed, suffix in ((open_interest, "_oi"), (funding, "_fund")):
        if feed is not None:
            frame, _ = join_feed(frame, feed, suffix, series, seq=seq)
    if liquidations is not None:
        frame = join_liquidations(frame, liquidations, series)
    if ls_ratio is not None:
        frame, _ = join_feed(frame, ls_ratio, "_ls", series, seq=seq)
    return frame


# ---------------------------------------------------------------- resampling
BAR_AGGREGATION = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}


def bin_start(ts: str, seconds: int) -> Column:
    """Start of the epoch-aligned bin of ``seconds`` holding ``ts``."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.timestamp_micros(F.floor(micros / F.lit(seconds * 1_000_000)) * (seconds * 1_000_000))


def _aggregate(column: str, how: str, order: Column) -> Column:
    c = F.col(column)
    known = F.when(c.isNotNull(), order)
    simple = {
        "max": F.max,
        "min": F.min,
        "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
        "mean": F.avg,
        "count": F.count,
    }
    if how == "first":
        return F.min_by(c, known)
    if how == "last":
        return F.max_by(c, known)
    if how in simple:
        return simple[how](c)
    raise ValueError(f"unknown aggregation {how!r}")


def resample(
    df: DataFrame,
    seconds: int,
    aggregation: dict[str, str] | None = None,
    series: Series = DEFAULT,
    order: str | None = None,
    empty_bins: bool = True,
) -> DataFrame:
    """Bars of ``seconds``; columns not named aggregate by last value.

    ``order`` (default the timestamp) decides first and last and must be
    unique within a bin for a deterministic result.  Empty bins between the
    first and the last bar appear with NULLs and sum 0.
    """
    keys = list(series.keys)
    skip = {*keys, series.order, order}
    if aggregation is None:
        aggregation = {c: BAR_AGGREGATION.get(c, "last") for c in df.columns if c not in skip}
    position = F.col(order or series.order)
    binned = df.withColumn("_bin", bin_start(series.order, seconds))
    bars = binned.groupBy(*keys, "_bin").agg(
        *[_aggregate(c, how, position).alias(c) for c, how in aggregation.items()]
    )
    bars = bars.withColumnRenamed("_bin", series.order)
    if not empty_bins:
        return bars
    sums = [c for c, how in aggregation.items() if how in ("sum", "count")]
    out = spine(bars, seconds, series).join(bars, [*keys, series.order], "left")
    return out.fillna(0, subset=sums) if sums else out


def spine(df: DataFrame, seconds: int, series: Series = DEFAULT) -> DataFrame:
    """Complete timestamps from the first to the last row of each series.

    Expanded in two steps with a shuffle between, so a long series is neither
    one huge array nor one task's work.
    """
    keys, ts = list(series.keys), F.unix_micros(F.col(series.order).cast("timestamp"))
    step, chunk = seconds * 1_000_000, seconds * 1_000_000 * 4096
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    chunks = span.withColumn(
        "_from", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(chunk)))
    ).repartition(*keys, "_from")
    until = F.least(F.col("_hi"), F.col("_from") + F.lit(chunk - step))
    points = F.explode(F.sequence(F.col("_from"), until, F.lit(step)))
    return chunks.select(*keys, points.alias("_t")).select(
        *keys, F.timestamp_micros("_t").alias(series.order)
    )


def complete_timestamps(
    df: DataFrame, seconds: int, fill_method: str | None = "ffill", series: Series = DEFAULT
) -> DataFrame:
    """Reindex onto the spine (rows off the grid drop), then fill."""
    keys = [*series.keys, series.order]
    typed = df.withColumn(series.order, F.col(series.order).cast("timestamp"))
    columns = [c for c in df.columns if c not in keys]
    full = spine(typed, seconds, series).join(typed, keys, "left")
    return fill(full, columns, fill_method, series)

