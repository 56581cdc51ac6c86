"""Forward-looking targets.

A target reads later rows, so the series is segmented in descending time: a
lead becomes a lag into the halo, and the row position counts from the end,
which makes "drop the last h rows" a plain filter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Rolling
from ..functions.scalar import fdiv, sign
from .prefix import DEFAULT, Series, row_index
from .segments import RN, Segmented, segment


def _backward(df: DataFrame, reach: int, series: Series) -> tuple[Segmented, Rolling]:
    seg = segment(df, halo=reach, series=series.with_(reverse=True))
    return seg, Rolling(seg)


def _future_change(r: Rolling, x: str, h: int) -> Column:
    # in a descending series the lag is the value h rows later
    return fdiv(r.lag(x, h) - F.col(x), x)


def _label(change: Column, threshold: float) -> Column:
    """2 above the threshold, 0 below its negative, else (or unknown) 1."""
    return F.when(change > threshold, 2).when(change < -threshold, 0).otherwise(1)


def hours_name(horizon: int) -> str:
    return f"{horizon * 5 / 60:.0f}h"


def classification_target(
    df: DataFrame,
    horizon: int = 48,
    threshold: float = 0.005,
    n_classes: int = 3,
    series: Series = DEFAULT,
) -> DataFrame:
    """Class of the return ``horizon`` rows ahead, last rows cut."""
    seg, r = _backward(df, horizon, series)
    change = F.col("future_return")
    label = _label(change, threshold) if n_classes == 3 else (
        F.coalesce(change > threshold, F.lit(False)).cast("int")
    )
    out = seg.add({"future_return": _future_change(r, "close", horizon)}).add({"target": label})
    cut = Segmented(out.df.where(F.col(RN) >= horizon), out.series, out.block_rows)
    return cut.finish(*df.columns, "target", "future_return")


def regression_target(
    df: DataFrame, horizons: Sequence[int] = (12, 48, 288), series: Series = DEFAULT
) -> DataFrame:
    """Future returns at several horizons."""
    seg, r = _backward(df, max(horizons), series)
    columns = {f"target_return_{hours_name(h)}": _future_change(r, "close", h) for h in horizons}
    out = seg.add(columns)
    cut = Segmented(out.df.where(F.col(RN) >= max(horizons)), out.series, out.block_rows)
    return cut.finish(*df.columns, *columns)


def oi_target(df: DataFrame, horizon: int = 48, series: Series = DEFAULT) -> DataFrame:
    """T4: future relative change of open interest."""
    if "open_interest" not in df.columns:
        raise ValueError("column open_interest is absent")
    seg, r = _backward(df, horizon, series)
    out = seg.add({"target_oi_change": _future_change(r, "open_interest", horizon)})
    cut = Segmented(out.df.where(F.col(RN) >= horizon), out.series, out.block_rows)
    return cut.finish(*df.columns, "target_oi_change")


def volatility_target(
    df: DataFrame, horizon: int = 48, lookback: int = 20, series: Series = DEFAULT
) -> DataFrame:
    """T5: annualised deviation of the log returns of rows
    ``t+horizon-lookback+1 .. t+horizon``; undefined on the first rows."""
    indexed = row_index(df, series, "_pos")
    trail = segment(indexed, halo=lookback + 1, series=series)
    trail = trail.add({"_lr": Rolling(trail).log_return("close")})
    frame = trail.window.rowsBetween(1 - lookback, 0)
    full = F.count("_lr").over(frame) == lookback
    trail = trail.add({"_dev": F.when(full, F.stddev_samp("_lr").over(frame))})
    seg, _ = _backward(trail.finish(*indexed.columns, "_dev"), horizon, series)
    ahead = F.lag("_dev", horizon).over(seg.window)
    value = F.when(F.col("_pos") >= lookback - 1, ahead * math.sqrt(288))
    out = seg.add({"target_volatility": value})
    cut = Segmented(out.df.where(F.col(RN) >= horizon + lookback), out.series, out.block_rows)
    return cut.finish(*df.columns, "target_volatility")


def multi_horizon_targets(
    df: DataFrame,
    horizons: Sequence[int] = (12, 48, 96, 288),
    threshold: float = 0.005,
    series: Series = DEFAULT,
) -> DataFrame:
    """Return and class per horizon."""
    seg, r = _backward(df, max(horizons), series)
    returns = {f"target_return_{hours_name(h)}": _future_change(r, "close", h) for h in horizons}
    classes = {
        f"target_class_{hours_name(h)}": _label(F.col(f"target_return_{hours_name(h)}"), threshold)
        for h in horizons
    }
    out = seg.add(returns).add(classes)
    cut = Segmented(out.df.where(F.col(RN) >= max(horizons)), out.series, out.block_rows)
    return cut.finish(*df.columns, *returns, *classes)


def direction_labels(df: DataFrame, horizon: int = 48, series: Series = DEFAULT) -> DataFrame:
    """-1/0/1 direction of the close ``horizon`` rows ahead."""
    seg, r = _backward(df, horizon, series)
    out = seg.add({"direction": sign(r.lag("close", horizon) - F.col("close")).cast("int")})
    cut = Segmented(out.df.where(F.col(RN) >= horizon), out.series, out.block_rows)
    return cut.finish(*df.columns, "direction")


def target_distribution(df: DataFrame, column: str = "target") -> DataFrame:
    """Rows and share per class; the window runs over the class counts."""
    counts = df.groupBy(F.col(column)).agg(F.count(F.lit(1)).alias("count"))
    every = Window.partitionBy()
    return counts.withColumn("percentage", F.col("count") * 100.0 / F.sum("count").over(every))


def with_return_target(df: DataFrame) -> DataFrame:
    """The future return doubles as the regression target."""
    return df.withColumn("target_return", F.col("future_return"))


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str | None = None,
    lookback: int = 60,
    series: Series = DEFAULT,
) -> DataFrame:
    """Per row the ``lookback`` preceding feature vectors as one array.

    Only rows with a full history are returned; the array is bounded by
    ``lookback``.
    """
    seg = segment(df, halo=lookback, series=series)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    out = seg.add({"sequence": F.collect_list(vector).over(seg.previous(lookback))})
    full = Segmented(out.df.where(F.col(RN) >= lookback), out.series, out.block_rows)
    kept = [*series.keys, series.order, "sequence"]
    return full.finish(*kept, *([target] if target else []))
