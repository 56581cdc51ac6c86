"""Filling missing values along a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_us, null_if_inf
from .prefix import BUCKET, DEFAULT, Series, bucket_prefix


def _with_neighbours(
    df: DataFrame,
    columns: Sequence[str],
    series: Series,
    back: bool = True,
    ahead: bool = False,
    own_first: bool = False,
) -> DataFrame:
    """Attach ``_b_<c>`` / ``_a_<c>``: nearest known value outside the bucket.

    With ``own_first`` the first known value of the bucket itself counts as
    lying ahead.
    """
    rows = series.bucketed(df)
    keys = [*series.keys, BUCKET]
    when = f"CASE WHEN `{{c}}` IS NOT NULL THEN {series.position} END"
    aggs = []
    if back:
        aggs += [F.expr(f"max_by(`{c}`, {when.format(c=c)}) AS `_b_{c}`") for c in columns]
    if ahead:
        aggs += [F.expr(f"min_by(`{c}`, {when.format(c=c)}) AS `_a_{c}`") for c in columns]
    summary = rows.groupBy(*keys).agg(*aggs)
    prefix = bucket_prefix(
        summary,
        series.keys,
        lasts=[f"_b_{c}" for c in columns] if back else (),
        nexts=[f"_a_{c}" for c in columns] if ahead else (),
        bounded=series.bounded,
    )
    later = "coalesce(`_a_{c}`, `_a_{c}__after`)" if own_first else "`_a_{c}__after`"
    picked = [f"`_b_{c}__before` AS `_b_{c}`" for c in columns if back]
    picked += [f"{later.format(c=c)} AS `_a_{c}`" for c in columns if ahead]
    return rows.join(prefix.selectExpr(*keys, *picked), keys)


def _replace(df: DataFrame, original: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(*[values[c].alias(c) if c in values else c for c in original.columns])


def ffill(df: DataFrame, columns: Sequence[str], series: Series = DEFAULT) -> DataFrame:
    rows = _with_neighbours(df, columns, series)
    w = series.in_bucket().rowsBetween(Window.unboundedPreceding, 0)
    return _replace(
        rows,
        df,
        {c: F.coalesce(F.last(c, ignorenulls=True).over(w), f"_b_{c}") for c in columns},
    )


def bfill(df: DataFrame, columns: Sequence[str], series: Series = DEFAULT) -> DataFrame:
    rows = _with_neighbours(df, columns, series, back=False, ahead=True)
    # a descending running frame is linear; "current row to end" is quadratic
    w = Window.partitionBy(*series.keys, BUCKET).orderBy(*series.falling())
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    return _replace(
        rows,
        df,
        {c: F.coalesce(F.last(c, ignorenulls=True).over(w), f"_a_{c}") for c in columns},
    )


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def interpolate_time(
    df: DataFrame, columns: Sequence[str], series: Series = DEFAULT
) -> DataFrame:
    """Linear in time between known neighbours; trailing rows keep the last
    known value and leading rows stay missing."""
    points = df.withColumns(
        {
            f"_pt_{c}": F.when(
                F.col(c).isNotNull(),
                F.struct(epoch_us(series.order).alias("t"), F.col(c).cast("double").alias("x")),
            )
            for c in columns
        }
    )
    names = [f"_pt_{c}" for c in columns]
    rows = _with_neighbours(points, names, series, back=True, ahead=True)
    up = series.in_bucket().rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*series.keys, BUCKET).orderBy(*series.falling())
    down = down.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {f"_p_{c}": F.coalesce(F.last(f"_pt_{c}", True).over(up), f"_b__pt_{c}") for c in columns}
    ).withColumns(
        {
            f"_n_{c}": F.coalesce(F.last(f"_pt_{c}", True).over(down), f"_a__pt_{c}")
            for c in columns
        }
    )

    def value(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        share = F.try_divide(
            (epoch_us(series.order) - p["t"]).cast("double"), (n["t"] - p["t"]).cast("double")
        )
        line = p["x"] + (n["x"] - p["x"]) * share
        return F.coalesce(F.col(c).cast("double"), line, p["x"])

    return _replace(rows, df, {c: value(c) for c in columns})


def fill_all(
    df: DataFrame,
    columns: Sequence[str],
    series: Series = DEFAULT,
    mode: str = "reference",
) -> DataFrame:
    """Last known value, else (``reference`` mode) next known value, else 0.

    ``causal`` mode skips the look-ahead, so no row depends on a later one.
    ``df`` is evaluated twice (summary and rows): pass a stored table.
    """
    if mode not in ("reference", "causal"):
        raise ValueError(f"unknown fill mode {mode!r}")
    ahead = mode == "reference"
    # the look-ahead is reached only when nothing is known before a row, so the
    # first known value of its own bucket then lies after it
    rows = _with_neighbours(df, columns, series, back=True, ahead=ahead, own_first=True)
    by = ", ".join([*series.keys, BUCKET])
    running = (
        f"(PARTITION BY {by} ORDER BY {', '.join([series.order, *series.ties])} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    filled = set(columns)

    def value(c: str) -> str:
        if c not in filled:
            return f"`{c}`"
        later = f"`_a_{c}`, " if ahead else ""
        zero = f"CAST(0 AS {df.schema[c].dataType.simpleString()})"
        return f"coalesce(last(`{c}`) IGNORE NULLS OVER {running}, `_b_{c}`, {later}{zero}) AS `{c}`"

    return rows.selectExpr(*[value(c) for c in df.columns])


def replace_inf(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: null_if_inf(c) for c in columns})


FILLS = ("ffill", "bfill", "zero", "drop", "interpolate")


def fill(
    df: DataFrame, columns: Sequence[str], method: str | None, series: Series = DEFAULT
) -> DataFrame:
    """Dispatch on the fill mode name; ``None`` keeps the gaps."""
    if method is None:
        return df
    if method == "ffill":
        return ffill(df, columns, series)
    if method == "bfill":
        return bfill(df, columns, series)
    if method == "zero":
        return zero_fill(df, columns)
    if method == "drop":
        return drop_missing(df, columns)
    if method == "interpolate":
        return interpolate_time(df, columns, series)
    raise ValueError(f"fill method must be one of {FILLS}, not {method!r}")
