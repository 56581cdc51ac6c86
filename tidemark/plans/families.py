"""Feature families: which groups and inputs each reported family needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import tidy
from ..operators.align import join_all
from ..operators.features import feature_frame
from ..operators.fill import ffill
from .derived import Feeds

# family -> (feature groups, features)
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "feat_oi_change": (
        ("oi",),
        (
            "oi_change_abs",
            "oi_pct_change_1",
            "oi_pct_change_5",
            "oi_pct_change_20",
            "oi_log_return",
            "oi_velocity_1h",
            "oi_velocity_4h",
            "oi_velocity_24h",
            "oi_acceleration",
        ),
    ),
    "feat_oi_trend": (
        ("oi",),
        (
            "oi_sma_20",
            "oi_sma_50",
            "oi_sma_200",
            "oi_ema_12",
            "oi_ema_26",
            "oi_macd",
            "oi_macd_signal",
            "oi_macd_histogram",
            "oi_trend_slope_20",
            "oi_trend_slope_50",
            "oi_r_squared_20",
        ),
    ),
    "feat_oi_bands": (
        ("oi",),
        (
            "oi_std_20",
            "oi_std_50",
            "oi_bb_upper",
            "oi_bb_lower",
            "oi_bb_position",
            "oi_bb_width",
            "oi_cv",
        ),
    ),
    "feat_oi_divergence": (
        ("oi",),
        ("oi_price_divergence_20", "oi_price_divergence_48", "oi_price_divergence_288"),
    ),
    "feat_oi_extremes": (
        ("oi",),
        ("oi_zscore", "oi_percentile_100", "oi_dist_from_high", "oi_dist_from_low"),
    ),
    "feat_price_returns": (
        ("price",),
        (
            *(f"return_{k}" for k in (1, 5, 10, 20, 50, 100)),
            *(f"log_return_{k}" for k in (1, 5, 20)),
            "realized_vol_20",
        ),
    ),
    "feat_price_trend": (
        ("price",),
        (
            *(f"sma_{n}" for n in (10, 20, 50, 200)),
            "ema_12",
            "ema_26",
            *(f"price_vs_sma{n}" for n in (10, 20, 50, 200)),
            "sma_cross_20_50",
        ),
    ),
    "feat_price_momentum": (
        ("price",),
        (
            "rsi_14",
            "rsi_50",
            "MACD_12_26_9",
            "MACDs_12_26_9",
            "MACDh_12_26_9",
            "STOCHk_14_3_3",
            "STOCHd_14_3_3",
            "roc_10",
            "roc_30",
            "willr_14",
        ),
    ),
    "feat_price_volatility": (
        ("price",),
        (
            "atr_14",
            "atr_50",
            "natr",
            *(f"BB{k}_20_2" for k in "LMUBP"),
            "bb_width",
            "bb_position",
            "kc_upper",
            "kc_lower",
            "kc_width",
        ),
    ),
    "feat_price_adx": (("price",), ("ADX_14", "DMP_14", "DMN_14")),
    "feat_market_structure": (("price",), ("market_structure",)),
    "feat_volume_stats": (
        ("volume",),
        (
            "volume_change",
            "volume_change_20",
            "volume_sma_20",
            "volume_sma_50",
            "volume_ema_20",
            "volume_ratio",
            "volume_roc_10",
            "volume_trend_20",
            "volume_std_20",
            "volume_cv",
            "volume_percentile_100",
        ),
    ),
    "feat_volume_flow": (
        ("volume",),
        (
            "obv",
            "obv_sma_20",
            "obv_divergence",
            "cmf",
            "mfi",
            "typical_price",
            "vwap",
            "price_vs_vwap",
            "price_volume_corr_20",
        ),
    ),
    "feat_funding": (
        ("funding",),
        (
            "funding_change",
            "funding_change_24h",
            "cumulative_funding_7d",
            "cumulative_funding_30d",
            "funding_mean_100",
            "funding_std_100",
            "funding_zscore",
            "funding_percentile",
            "funding_extreme_positive",
            "funding_extreme_negative",
            "funding_momentum",
        ),
    ),
    "feat_liquidation": (
        ("liquidation",),
        (
            "liq_volume",
            "liq_avg_size",
            "liq_count",
            "long_liq_volume",
            "short_liq_volume",
            "liq_volume_1h",
            "liq_volume_4h",
            "liq_count_1h",
            "net_liquidation",
            "net_liquidation_1h",
            "liq_spike",
            "liq_momentum",
        ),
    ),
    "feat_ls_ratio": (
        ("ls_ratio",),
        (
            "ls_ratio_change_1h",
            "ls_ratio_change_4h",
            "ls_ratio_change_24h",
            "ls_ratio_sma_20",
            "ls_ratio_ema_20",
            "ls_ratio_percentile",
            "ls_ratio_extreme_long",
            "ls_ratio_extreme_short",
            "ls_ratio_zscore",
        ),
    ),
    "feat_time": (
        ("time",),
        (
            "hour",
            "day_of_week",
            "day_of_month",
            "month",
            "hour_sin",
            "hour_cos",
            "day_sin",
            "day_cos",
            "month_sin",
            "month_cos",
            "is_asia_session",
            "is_europe_session",
            "is_us_session",
            "is_weekend",
            "funding_cycle_sin",
            "funding_cycle_cos",
        ),
    ),
    "feat_interaction": (
        ("oi", "price", "volume", "funding", "liquidation", "ls_ratio", "interaction"),
        (
            "oi_volume_ratio",
            "oi_volume_divergence",
            "rsi_funding_interaction",
            "oi_price_momentum",
            "volume_volatility",
            "funding_price_momentum",
            "oi_price_macd_interaction",
            "liq_volatility",
            "ls_rsi_interaction",
            "oi_price_extreme",
        ),
    ),
}


def stamp(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts")


def show(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Comparable form: text timestamps and rounded doubles."""
    return df.select("symbol", stamp(), *[tidy(c, digits).alias(c) for c in columns])


def family(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    groups, features = FAMILIES[name]
    feeds = Feeds.read(spark, sf_dir)
    base = _inputs(feeds, groups)
    return show(feature_frame(base, groups, output=["symbol", "ts", *features]), *features)


def _inputs(feeds: Feeds, groups: tuple[str, ...]) -> DataFrame:
    """Join only the feeds the groups read."""
    funding = "funding" in groups
    base = join_all(
        feeds.ohlcv(),
        feeds.open_interest() if "oi" in groups else None,
        feeds.funding() if funding else None,
        feeds.liquidations() if "liquidation" in groups else None,
        feeds.ls_ratio() if "ls_ratio" in groups else None,
        feeds.series,
    )
    return ffill(base, ["funding_rate"], feeds.series) if funding else base
