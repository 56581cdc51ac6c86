"""Feed contracts and data-quality reports (Q1-Q11)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import Rolling
from ..functions.scalar import epoch_us
from .prefix import BUCKET, DEFAULT, Series, bucket_prefix
from .segments import segment

# Type names that count as the same contract type.
EQUIVALENT_TYPES = {
    "integer": {"int", "bigint", "smallint", "tinyint"},
    "float": {"double", "float"},
    "timestamp": {"timestamp", "timestamp_ntz", "date"},
    "string": {"string"},
}


def same_type(actual: str, expected: str) -> bool:
    """Q2: equal names, or members of one equivalence group."""
    return actual == expected or any(
        actual in group and expected in group for group in EQUIVALENT_TYPES.values()
    )


@dataclass(frozen=True)
class Contract:
    """Declared columns of a feed.  ``unique_ts`` is off for event feeds,
    where several rows per timestamp are normal."""

    name: str
    columns: dict[str, str]
    required: tuple[str, ...]
    frequency: str
    unique_ts: bool = True
    optional: tuple[str, ...] = field(default=())


_F, _T, _S = "double", "timestamp", "string"
CONTRACTS = {
    "ohlcv": Contract(
        "ohlcv",
        {"ts": _T, "open": _F, "high": _F, "low": _F, "close": _F, "volume": _F},
        ("ts", "open", "high", "low", "close", "volume"),
        "5min",
    ),
    "open_interest": Contract(
        "open_interest", {"ts": _T, "open_interest": _F}, ("ts", "open_interest"), "5min"
    ),
    "funding": Contract("funding", {"ts": _T, "funding_rate": _F}, ("ts", "funding_rate"), "8h"),
    "liquidations": Contract(
        "liquidations",
        {"ts": _T, "quantity": _F, "side": _S, "price": _F},
        ("ts", "quantity", "side"),
        "irregular",
        unique_ts=False,
        optional=("price",),
    ),
    "ls_ratio": Contract(
        "ls_ratio", {"ts": _T, "longShortRatio": _F}, ("ts", "longShortRatio"), "5min"
    ),
    "features": Contract("features", {"ts": _T, "close": _F}, ("ts",), "5min"),
    "targets": Contract("targets", {"ts": _T, "target": "bigint"}, ("ts", "target"), "5min"),
}


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def validate(
    df: DataFrame, contract: Contract, series: Series = DEFAULT, arrival: str | None = None
) -> DataFrame:
    """Q1: one row ``(feed, valid, errors, warnings)``.

    Schema checks need no job.  Duplicates are counted per (symbol, ts) by
    partial aggregation; with ``arrival`` (a sequence column) rows that arrive
    before their predecessor are counted too.
    """
    missing = [c for c in contract.required if c not in df.columns]
    errors = [f"missing column {c}" for c in missing]
    types = dict(df.dtypes)
    warnings = [
        f"column {c} is {types[c]}, expected {t}"
        for c, t in contract.columns.items()
        if c in types and not same_type(types[c], t)
    ]
    if types.get(series.order) == "timestamp_ntz":
        warnings.append("timestamps carry no time zone")
    if series.order in missing:
        spark = df.sparkSession
        found = spark.range(1).select(F.lit(0).alias("_dup"), F.lit(0).alias("_back"))
    else:
        keys = [*series.keys, series.order]
        per_ts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
        found = per_ts.select((F.col("_c") - 1).alias("_dup"), F.lit(0).alias("_back"))
        if arrival:
            late = out_of_order(df, arrival, series)
            found = found.union(late.select(F.lit(0), F.lit(1)))
        found = found.agg(
            F.coalesce(F.sum("_dup"), F.lit(0)).alias("_dup"),
            F.coalesce(F.sum("_back"), F.lit(0)).alias("_back"),
        )
    dynamic = []
    if contract.unique_ts:
        dynamic.append(F.when(F.col("_dup") > 0, F.concat("_dup", F.lit(" duplicate timestamps"))))
    dynamic.append(F.when(F.col("_back") > 0, F.concat("_back", F.lit(" timestamps out of order"))))
    problems = F.concat(_texts(errors), F.filter(F.array(*dynamic), lambda e: e.isNotNull()))
    return found.select(
        F.lit(contract.name).alias("feed"),
        (F.size(problems) == 0).alias("valid"),
        problems.alias("errors"),
        _texts(warnings).alias("warnings"),
    )


def absent_feed(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(name).alias("feed"),
        F.lit(None).cast("boolean").alias("valid"),
        _texts([]).alias("errors"),
        _texts([f"feed {name} not given"]).alias("warnings"),
    )


def validate_feeds(
    feeds: dict[str, DataFrame | None], series: Series = DEFAULT, spark: SparkSession | None = None
) -> DataFrame:
    """Q3: one row per known feed."""
    spark = spark or next(d for d in feeds.values() if d is not None).sparkSession
    rows = [
        validate(df, CONTRACTS[name], series) if df is not None else absent_feed(spark, name)
        for name, df in feeds.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def validation_summary(report: DataFrame) -> DataFrame:
    """Q4: totals and the overall outcome."""
    return report.agg(
        F.sum(F.size("errors")).alias("total_errors"),
        F.sum(F.size("warnings")).alias("total_warnings"),
        F.bool_and(F.coalesce("valid", F.lit(True))).alias("passed"),
    )


def ensure_timezone(df: DataFrame, zone: str = "UTC", column: str = "ts") -> DataFrame:
    """Q5: local wall-clock times of ``zone`` become instants; instants stay."""
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return df
    session = F.current_timezone()
    instant = F.convert_timezone(F.lit(zone), session, F.col(column)).cast("timestamp")
    return df.withColumn(column, instant)


def out_of_order(df: DataFrame, arrival: str, series: Series = DEFAULT) -> DataFrame:
    """Q6: rows whose timestamp lies before that of the row that arrived
    before them.  ``arrival`` is an increasing number; it is cut into ranges so
    the check of one symbol is spread too."""
    width = 1 << 16
    keys = list(series.keys)
    rows = df.withColumn(BUCKET, F.floor(F.col(arrival) / F.lit(width)))
    tails = rows.groupBy(*keys, BUCKET).agg(F.max_by(series.order, arrival).alias("_tail"))
    before = bucket_prefix(tails, keys, lasts=["_tail"]).select(*keys, BUCKET, "_tail__before")
    w = series.with_(order=arrival).in_bucket()
    previous = F.coalesce(F.lag(series.order).over(w), F.col("_tail__before"))
    joined = rows.join(before, [*keys, BUCKET]).withColumn("_prev", previous)
    return joined.where(F.col(series.order) < F.col("_prev")).select(*df.columns)


def is_monotonic(df: DataFrame, arrival: str, series: Series = DEFAULT) -> DataFrame:
    late = out_of_order(df, arrival, series)
    return late.agg((F.count(F.lit(1)) == 0).alias("monotonic"))


def duplicate_timestamps(df: DataFrame, series: Series = DEFAULT) -> DataFrame:
    """Q7: every row of a repeated (symbol, ts).

    Repeated keys are found by partial aggregation and joined back, so a
    timestamp with very many rows is never gathered in one window.
    """
    keys = [*series.keys, series.order]
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    return df.join(repeated, keys, "left_semi")


def time_gaps(
    df: DataFrame, expected_seconds: int, tolerance_seconds: int = 60, series: Series = DEFAULT
) -> DataFrame:
    """Q8: steps longer than expected + tolerance, in seconds."""
    seg = segment(df.select(*series.keys, series.order), halo=1, series=series)
    step = (epoch_us(series.order) - Rolling(seg).lag(epoch_us(series.order))) / F.lit(1e6)
    steps = seg.add({"gap_seconds": step}).finish(*series.keys, series.order, "gap_seconds")
    late = steps.where(F.col("gap_seconds") > expected_seconds + tolerance_seconds)
    return late.withColumns(
        {
            "expected_seconds": F.lit(float(expected_seconds)),
            "excess_seconds": F.col("gap_seconds") - expected_seconds,
        }
    )


def missing_report(df: DataFrame, columns: Sequence[str] | None = None, order: str = "ts") -> DataFrame:
    """Q9: count, share and first position of missing values per column."""
    columns = list(columns or [c for c in df.columns if c != order])
    gone = {c: F.col(c).isNull() for c in columns}
    stats = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(g).alias(f"n_{c}") for c, g in gone.items()],
        *[F.min(F.when(g, F.col(order))).alias(f"t_{c}") for c, g in gone.items()],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n_{c}").alias("missing_count"),
                (F.col(f"n_{c}") * 100.0 / F.col("_n")).alias("missing_pct"),
                F.col(f"t_{c}").alias("first_missing"),
            )
            for c in columns
        ]
    )
    report = stats.select(F.inline(lines)).where("missing_count > 0")
    return report.orderBy(F.desc("missing_count"), "column")


def alignment_summary(df: DataFrame, order: str = "ts") -> DataFrame:
    """Q10: size, span and number of missing cells of a frame."""
    gone = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("bigint") for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min(order).alias("start"),
        F.max(order).alias("end"),
        F.sum(gone).alias("missing_cells"),
    )


def feature_set_check(sets: DataFrame, available: Sequence[str]) -> DataFrame:
    """Q11: features a stored set requires and a table lacks."""
    have = F.array(*[F.lit(c) for c in available])
    lacking = F.array_sort(F.array_except("features", have))
    return sets.select(
        "feature_set_id", lacking.alias("missing"), (F.size(lacking) == 0).alias("valid")
    )
