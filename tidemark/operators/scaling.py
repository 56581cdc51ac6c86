"""Scaling with statistics from the training rows only.

A fitted scaler is a table ``(symbol, feature, center, scale)``; one global
scaler has a NULL symbol.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .quantiles import exact_quantiles

METHODS = ("standard", "minmax", "robust")


def fit_scaler(
    train: DataFrame,
    columns: Sequence[str],
    method: str = "standard",
    per_symbol: bool = False,
    exact: bool = True,
) -> DataFrame:
    """One aggregation pass; a zero scale becomes 1."""
    x = {c: f"CAST(`{c}` AS DOUBLE)" for c in columns}
    if method == "standard":
        center, scale = "avg({x})", "stddev_pop({x})"
    elif method == "minmax":
        center, scale = "min({x})", "max({x}) - min({x})"
    elif method == "robust" and exact:
        by = ["symbol"] if per_symbol else []
        q = exact_quantiles(train, columns, [0.25, 0.5, 0.75], by)
        spread = F.col("q")[0.75] - F.col("q")[0.25]
        symbol = F.col("symbol") if per_symbol else F.lit(None).cast("string").alias("symbol")
        fitted = q.select(
            symbol, "feature", F.col("q")[0.5].alias("center"), F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("scale")
        )
        # a feature without a known value has no statistics, but a row
        groups = train.select(*by).distinct() if per_symbol else train.sparkSession.range(1).select(symbol)
        every = groups.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
        same = F.col("e.symbol").eqNullSafe(F.col("f.symbol")) & (F.col("e.feature") == F.col("f.feature"))
        return every.alias("e").join(fitted.alias("f"), same, "left").select("e.symbol", "e.feature", "center", "scale")
    elif method == "robust":
        q = "percentile_approx({{x}}, {p}, 10000)"
        center = q.format(p=0.5)
        scale = f"{q.format(p=0.75)} - {q.format(p=0.25)}"
    else:
        raise ValueError(f"scaling method must be one of {METHODS}")
    group = train.groupBy("symbol") if per_symbol else train.groupBy()
    wide = group.agg(
        *[F.expr(f"{center.format(x=v)} AS `{c}__c`") for c, v in x.items()],
        *[F.expr(f"{scale.format(x=v)} AS `{c}__s`") for c, v in x.items()],
    )
    lines = ", ".join(
        f"named_struct('feature', '{c}', 'center', `{c}__c`, "
        f"'scale', CASE WHEN `{c}__s` = 0 THEN 1.0D ELSE `{c}__s` END)"
        for c in columns
    )
    symbol = "symbol" if per_symbol else "CAST(NULL AS STRING) AS symbol"
    return wide.selectExpr(symbol, f"inline(array({lines}))")


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``columns``; an unseen symbol uses the first fitted one.

    A global scaler has one row per feature and becomes literals.  Per-symbol
    statistics are joined as one row per symbol; they are as many as there are
    symbols, so the join strategy is left to the optimizer's size check.
    """
    wanted = stored(scaler.where(F.col("feature").isin(list(columns))), "scaler")
    first = wanted.agg(F.min("symbol")).first()[0]
    base = wanted.where(F.col("symbol").isNull() if first is None else F.col("symbol") == first)
    default = {r["feature"]: (r["center"], r["scale"]) for r in base.collect()}

    def literal(v: float | None) -> str:
        return "CAST(NULL AS DOUBLE)" if v is None else f"CAST('{v!r}' AS DOUBLE)"

    if first is None:
        def value(c: str) -> str:
            center, scale = default[c]
            return f"(CAST(`{c}` AS DOUBLE) - {literal(center)}) / {literal(scale)} AS `{c}`"

        return df.selectExpr(*[value(c) if c in default else f"`{c}`" for c in df.columns])

    wide = wanted.groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("center", "scale")))).alias(
            "_stats"
        )
    )

    def joined(c: str) -> str:
        center, scale = (literal(v) for v in default[c])
        stat = f"_stats['{c}']"
        return (
            f"(CAST(`{c}` AS DOUBLE) - CASE WHEN _stats IS NULL THEN {center} ELSE {stat}.center END)"
            f" / CASE WHEN _stats IS NULL THEN {scale} ELSE {stat}.scale END AS `{c}`"
        )

    rows = df.join(wide, "symbol", "left")
    return rows.selectExpr(*[joined(c) if c in default else f"`{c}`" for c in df.columns])


def scale_splits(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "standard",
    per_symbol: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Fit on ``split = 'train'``, apply to all; returns (table, scaler)."""
    scaler = fit_scaler(df.where("split = 'train'"), columns, method, per_symbol)
    return apply_scaler(df, scaler, columns), scaler


def save_scaler(scaler: DataFrame, path: str) -> None:
    """S14."""
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
