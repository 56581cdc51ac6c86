"""from five raw feeds to the filled 160-feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import join_all
from ..operators.ewm import ewm
from ..operators.features import HALO, feature_frame, feature_names
from ..operators.fill import fill_all, replace_inf
from ..operators.prefix import DEFAULT, Series
from ..operators.segments import fitted_rows
from ..session import stored


#: Exponential averages of a column that are taken straight from it.
AVERAGES = {
    "open_interest": {"oi_ema_12": 12, "oi_ema_26": 26},
    "close": {"ema_12": 12, "ema_26": 26, "_ema_20": 20},
    "volume": {"volume_ema_20": 20},
}


def has_gaps(frame: DataFrame, column: str, series: Series = DEFAULT) -> bool:
    """Whether a column has a missing value after its first known one."""
    return column in gap_columns(frame, [column], series)


def gap_columns(frame: DataFrame, columns: Sequence[str], series: Series = DEFAULT) -> list[str]:
    """The columns with a missing value after their first known one, in one pass.

    One number per column reaches the planner, like any size check.
    """
    t = F.col(series.order)
    spans = frame.groupBy(*series.keys).agg(
        *[F.min(F.when(F.col(c).isNotNull(), t)).alias(f"_from_{c}") for c in columns],
        *[F.max(F.when(F.col(c).isNull(), t)).alias(f"_miss_{c}") for c in columns],
    )
    found = spans.agg(*[F.count_if(F.col(f"_miss_{c}") > F.col(f"_from_{c}")).alias(c) for c in columns]).first()
    return [c for c in columns if found[c]]


def features_unfilled(
    frame: DataFrame, series: Series = DEFAULT, gaps: bool | None = None
) -> DataFrame:
    """Features of a joined frame (read twice, so pass a stored table).

    A gap decays the weights of exponential averages.  Averages of a column
    that has one come from the gap-aware scan and are joined in; what is built
    on them follows.  ``gaps=False`` promises that there is none.
    """
    columns = [c for c in AVERAGES if c in frame.columns]
    found = columns if gaps else [] if gaps is False else gap_columns(frame, columns, series)
    if not found:
        return feature_frame(frame, series=series)
    spans = {name: (c, span) for c in found for name, span in AVERAGES[c].items()}
    frame = stored(ewm(frame, spans, series), "averages")
    return feature_frame(frame, series=series).drop("_ema_20")


def engineer_all(
    ohlcv: DataFrame,
    open_interest: DataFrame | None = None,
    funding: DataFrame | None = None,
    liquidations: DataFrame | None = None,
    ls_ratio: DataFrame | None = None,
    series: Series = DEFAULT,
    seq: str | None = None,
    fill_mode: str | None = "reference",
    clean_inf: bool = False,
) -> DataFrame:
    """Join, compute and fill all features.

    Two tables are written on the way, because their rows are needed twice:
    the joined frame (summary and rows) and the raw features (fill summary and
    rows).  ``fill_mode=None`` skips the fill and its table; ``clean_inf``
    turns infinities into missing values before it (A12).
    """
    frame = join_all(ohlcv, open_interest, funding, liquidations, ls_ratio, series, seq)
    frame = stored(frame, "joined")
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = fitted_rows(series, frame.count(), tasks, HALO)
    features = features_unfilled(frame, series)
    if clean_inf:
        doubles = {f.name for f in features.schema if f.dataType.typeName() == "double"}
        features = replace_inf(features, [c for c in features.columns if c in doubles])
    if fill_mode is None:
        return features
    keys = {*series.keys, series.order}
    columns = [c for c in features.columns if c not in keys]
    return fill_all(stored(features, "features"), columns, series, fill_mode)


__all__ = ["engineer_all", "features_unfilled", "feature_names", "has_gaps"]
