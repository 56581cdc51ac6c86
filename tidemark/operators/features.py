"""The 160-feature table, built as a few layers of window expressions.

Each layer is one projection; layers exist only where a feature reads another
windowed value.  All layers share one shuffle by (symbol, segment).  Windows
count rows, not time, and are undefined until they are full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Rolling, divergence
from ..functions.scalar import fdiv, flag, ratio, sign
from . import indicators as ind
from .ewm import add_ewm, memory
from .prefix import BUCKET, DEFAULT, Series, bucket_prefix
from .segments import RN, Segmented, segment

GROUPS = ("oi", "price", "volume", "funding", "liquidation", "ls_ratio", "time", "interaction")

# columns of the joined frame that are inputs, not features
BASE_COLUMNS = (
    "symbol",
    "ts",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "open_interest",
    "funding_rate",
    "longShortRatio",
)

# columns that exist before the first layer of sliding frames
_TRACKED = (
    "open_interest",
    "close",
    "high",
    "low",
    "volume",
    "funding_rate",
    "liq_volume",
    "liq_count",
    "net_liquidation",
    "log_return_1",
    "_ratio",
    "_gain",
    "_loss",
    "_tr",
    "_plus_dm",
    "_minus_dm",
    "_mfv",
    "_flow_in",
    "_flow_out",
)

# rows of history behind the longest window (672) plus its own lag
HALO = 704
_EWM_BLOCK = memory(26)

# input column each group needs
_NEEDS = {
    "oi": "open_interest",
    "funding": "funding_rate",
    "liquidation": "liq_volume",
    "ls_ratio": "longShortRatio",
}


def available_groups(columns: Iterable[str]) -> tuple[str, ...]:
    have = set(columns)
    return tuple(g for g in GROUPS if _NEEDS.get(g, "close") in have)


def _obv_before(df: DataFrame, series: Series) -> DataFrame:
    """Signed volume accumulated before each bucket, from narrow rows."""
    rows = series.bucketed(df).select(*series.keys, BUCKET, series.order, *series.ties, "close", "volume")
    step = F.coalesce(sign(F.col("close") - F.lag("close").over(series.in_bucket())), F.lit(0.0))
    stepped = rows.withColumn("_step", step * F.col("volume"))
    t = F.expr(series.position)
    edges = stepped.groupBy(*series.keys, BUCKET).agg(
        F.sum("_step").alias("_inner"),
        F.min_by(F.struct("close", "volume"), t).alias("_head"),
        F.max_by(F.struct("close"), t).alias("_tail"),
    )
    edges = bucket_prefix(edges, series.keys, lasts=["_tail"], bounded=series.bounded)
    came_from = F.col("_tail__before")
    entry = F.coalesce(sign(F.col("_head.close") - came_from["close"]), F.lit(0.0))
    entering = F.when(came_from.isNull(), F.col("_head.volume")).otherwise(
        entry * F.col("_head.volume")
    )
    totals = edges.select(
        *series.keys,
        BUCKET,
        (F.coalesce("_inner", F.lit(0.0)) + F.coalesce(entering, F.lit(0.0))).alias("_obv"),
        came_from["close"].alias("_close__before"),
    )
    before = bucket_prefix(totals, series.keys, sums=["_obv"], bounded=series.bounded)
    return before.drop("_obv")


class _Layers:
    """Collects expressions per layer, then applies them in order."""

    def __init__(self) -> None:
        self.steps: dict[str, dict[str, Column]] = {}

    def put(self, layer: str, **columns: Column) -> None:
        self.steps.setdefault(layer, {}).update(columns)

    def get(self, layer: str) -> dict[str, Column]:
        return self.steps.get(layer, {})


def feature_frame(
    base: DataFrame,
    groups: Iterable[str] | None = None,
    series: Series = DEFAULT,
    output: Iterable[str] | None = None,
) -> DataFrame:
    """Features of the joined frame before the final fill.

    ``groups`` limits the families (default: all the inputs allow).  ``output``
    prunes to some features; Catalyst then drops the unused expressions.
    """
    have = available_groups(base.columns)
    wanted = tuple(groups) if groups is not None else have
    missing = [g for g in wanted if g not in have]
    if missing:
        raise ValueError(f"inputs of {missing} are absent")

    flow = "volume" in wanted
    padded = ["close"]
    padded += ["volume"] if flow else []
    padded += ["open_interest"] if "oi" in wanted else []
    padded += ["longShortRatio"] if "ls_ratio" in wanted else []
    tpv = (F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume")
    seg = segment(
        base,
        halo=HALO,
        series=series,
        lasts=padded,
        sums={"_tpv": tpv, "_vol": F.col("volume")} if flow else None,
        extra=_obv_before(base, series) if flow else None,
        block_rows=_EWM_BLOCK,
    )
    layers = _Layers()
    ewm1: dict[str, tuple[str, int]] = {}
    ewm2: dict[str, tuple[str, int]] = {}
    given = set(base.columns)
    roll = Rolling(seg, _TRACKED)
    names: list[str] = []
    for group in GROUPS:
        if group in wanted:
            built = _BUILDERS[group](roll, layers, ewm1, ewm2, wanted)
            names += [n for n in built if n not in given]

    at = F.row_number().over(seg.window)  # position inside the segment
    seg = seg.add({"_at": at, **layers.get("inputs")})
    seg = seg.add(layers.get("lags"))
    seg = seg.add(layers.get("steps"))
    first = {o: v for o, v in ewm1.items() if o not in given}
    if first:
        seg = add_ewm(seg, first)
    seg = seg.add(roll.runs() | roll.totals())
    seg = seg.add(layers.get("windows"))
    seg = seg.add(layers.get("level1"))
    if ewm2:
        seg = add_ewm(seg, ewm2)
    seg = seg.add(layers.get("windows2"))
    seg = seg.add(layers.get("windows3"))
    for layer in ("final1", "final2", "final3"):
        seg = seg.add(layers.get(layer))
    extras = [n for n in names if n in seg.df.columns]
    assert len(extras) == len(names), set(names) - set(extras)
    kept = [c for c in base.columns if c not in names]
    picked = list(output) if output is not None else [*kept, *names]
    return seg.finish(*dict.fromkeys(picked))


def feature_names(df: DataFrame) -> list[str]:
    """The columns that are features rather than inputs."""
    return [c for c in df.columns if c not in BASE_COLUMNS]


# ----------------------------------------------------------------- groups
def _oi(r: Rolling, layers: _Layers, ewm1, ewm2, wanted) -> list[str]:
    x = "open_interest"
    layers.put("inputs", _oi_pad=r.ffill(x), _close_pad=r.ffill("close"))
    changes = {
        "oi_change_abs": r.diff(x),
        "oi_pct_change_1": r.pct("_oi_pad", 1),
        "oi_pct_change_5": r.pct("_oi_pad", 5),
        "oi_pct_change_20": r.pct("_oi_pad", 20),
        "oi_log_return": r.log_return(x),
    }
    for name, k in {"1h": 12, "4h": 48, "24h": 288}.items():
        changes[f"oi_velocity_{name}"] = fdiv(r.diff(x, k), r.lag(x, k))
    for k in (20, 48, 288):
        changes[f"oi_price_divergence_{k}"] = divergence(r.diff(x, k), r.diff("close", k))
    ewm1.update({"oi_ema_12": (x, 12), "oi_ema_26": (x, 26)})
    windows = {f"oi_sma_{n}": r.mean(x, n) for n in (20, 50)}
    windows["oi_sma_200"] = r.long_mean(x, 200)
    windows |= {f"oi_trend_slope_{n}": r.slope(x, n) for n in (20, 50)}
    windows |= {f"oi_std_{n}": r.std(x, n) for n in (20, 50)}
    windows["oi_r_squared_20"] = r.r_squared(x, 20)
    windows["oi_percentile_100"] = r.percentile_rank(x, 100)
    windows["_oi_max_100"] = r.max(x, 100)
    windows["_oi_min_100"] = r.min(x, 100)
    layers.put("lags", **changes)
    layers.put("windows", **windows, oi_acceleration=r.diff("oi_velocity_1h"))
    c = F.col
    level1 = {
        "oi_macd": c("oi_ema_12") - c("oi_ema_26"),
        "oi_bb_upper": c("oi_sma_20") + 2 * c("oi_std_20"),
        "oi_bb_lower": c("oi_sma_20") - 2 * c("oi_std_20"),
        "oi_cv": ratio("oi_std_20", "oi_sma_20"),
        "oi_zscore": ratio(c(x) - c("oi_sma_50"), "oi_std_50"),
        "oi_dist_from_high": ratio(c(x) - c("_oi_max_100"), "_oi_max_100"),
        "oi_dist_from_low": ratio(c(x) - c("_oi_min_100"), "_oi_min_100"),
    }
    layers.put("level1", **level1)
    ewm2["oi_macd_signal"] = ("oi_macd", 9)
    band = c("oi_bb_upper") - c("oi_bb_lower")
    final = {
        "oi_macd_histogram": c("oi_macd") - c("oi_macd_signal"),
        "oi_bb_position": ratio(c(x) - c("oi_bb_lower"), band),
        "oi_bb_width": ratio(band, "oi_sma_20"),
    }
    layers.put("final1", **final)
    visible = [n for n in windows if not n.startswith("_")]
    emas = ["oi_ema_12", "oi_ema_26", "oi_macd_signal", "oi_acceleration"]
    return [*changes, *visible, *emas, *level1, *final]


def _price(r: Rolling, layers: _Layers, ewm1, ewm2, wanted) -> list[str]:
    c = F.col
    layers.put("inputs", _close_pad=r.ffill("close"), **ind.bar_steps(r))
    changes = {f"return_{k}": r.pct("_close_pad", k) for k in (1, 5, 10, 20, 50, 100)}
    changes |= {f"log_return_{k}": r.log_return("close", k) for k in (1, 5, 20)}
    changes |= {f"roc_{k}": ind.roc(r, "close", k) for k in (10, 30)}
    layers.put("lags", **changes)
    layers.put("steps", **ind.directional_moves())
    ewm1.update({"ema_12": ("close", 12), "ema_26": ("close", 26), "_ema_20": ("close", 20)})
    windows = {f"sma_{n}": r.mean("close", n) for n in (10, 20)}
    windows |= {f"sma_{n}": r.long_mean("close", n) for n in (50, 200)}
    windows |= {f"rsi_{n}": ind.rsi_from_moves(r, n) for n in (14, 50)}
    windows |= {"atr_14": r.mean("_tr", 14), "atr_50": r.long_mean("_tr", 50)}
    windows["willr_14"] = ind.willr(r, 14)
    windows["market_structure"] = ind.market_structure(r, 20)
    windows["realized_vol_20"] = r.std("log_return_1", 20) * math.sqrt(288)
    hidden = {
        "_close_std_20": r.std("close", 20),
        "_stoch_raw": ind.stoch_raw(r, 14),
        "_pdm_14": r.mean("_plus_dm", 14),
        "_mdm_14": r.mean("_minus_dm", 14),
    }
    layers.put("windows", **windows, **hidden)
    mid, wide = c("sma_20"), 2 * c("_close_std_20")
    level1 = {
        "MACD_12_26_9": c("ema_12") - c("ema_26"),
        "DMP_14": 100 * fdiv("_pdm_14", "atr_14"),
        "DMN_14": 100 * fdiv("_mdm_14", "atr_14"),
        "BBL_20_2": mid - wide,
        "BBM_20_2": mid,
        "BBU_20_2": mid + wide,
        "natr": ratio("atr_14", "close"),
        "sma_cross_20_50": sign(c("sma_20") - c("sma_50")),
        "kc_upper": c("_ema_20") + 2 * c("atr_14"),
        "kc_lower": c("_ema_20") - 2 * c("atr_14"),
    }
    level1 |= {
        f"price_vs_sma{n}": ratio(c("close") - c(f"sma_{n}"), f"sma_{n}") for n in (10, 20, 50, 200)
    }
    layers.put("level1", **level1)
    ewm2["MACDs_12_26_9"] = ("MACD_12_26_9", 9)
    # DX is an input of the next window layer, so it is part of its expressions
    dx = 100 * fdiv(F.abs(c("DMP_14") - c("DMN_14")), c("DMP_14") + c("DMN_14"))
    second = {"STOCHk_14_3_3": r.mean("_stoch_raw", 3), "ADX_14": r.mean(dx, 14)}
    layers.put("windows2", **second)
    layers.put("windows3", STOCHd_14_3_3=r.mean("STOCHk_14_3_3", 3))
    band = c("BBU_20_2") - c("BBL_20_2")
    final = {
        "MACDh_12_26_9": c("MACD_12_26_9") - c("MACDs_12_26_9"),
        "BBB_20_2": fdiv(band, "BBM_20_2"),
        "BBP_20_2": fdiv(c("close") - c("BBL_20_2"), band),
        "bb_width": ratio(band, "BBM_20_2"),
        "bb_position": ratio(c("close") - c("BBL_20_2"), band),
        "kc_width": ratio(c("kc_upper") - c("kc_lower"), "_ema_20"),
    }
    layers.put("final1", **final)
    rest = ["ema_12", "ema_26", "MACDs_12_26_9", "STOCHd_14_3_3"]
    return [*changes, *windows, *level1, *second, *rest, *final]


def _volume(r: Rolling, layers: _Layers, ewm1, ewm2, wanted) -> list[str]:
    c = F.col
    layers.put(
        "inputs",
        _volume_pad=r.ffill("volume"),
        _prev_close=F.coalesce(r.lag("close"), F.col("_close__carry")),
        typical_price=(c("high") + c("low") + c("close")) / 3.0,
    )
    changes = {
        "volume_change": r.pct("_volume_pad", 1),
        "volume_change_20": r.pct("_volume_pad", 20),
        "volume_roc_10": ind.roc(r, "volume", 10),
        "_flow": c("typical_price") * c("volume"),
        "_tp_move": r.diff("typical_price"),
        "_obv_step": F.when(F.col(RN) == 0, c("volume")).otherwise(
            F.coalesce(sign(c("close") - c("_prev_close")), F.lit(0.0)) * c("volume")
        ),
        "_mfv": ind.money_flow_multiplier() * c("volume"),
    }
    layers.put("lags", **changes)
    layers.put("steps", **ind.signed_flows())
    ewm1["volume_ema_20"] = ("volume", 20)

    def total(x: str, carry: str) -> Column:
        return F.coalesce(r.running_sum(c(x)), F.lit(0.0)) + F.coalesce(carry, F.lit(0.0))

    windows = {
        "volume_sma_20": r.mean("volume", 20),
        "volume_sma_50": r.long_mean("volume", 50),
        "volume_trend_20": r.slope("volume", 20),
        "volume_std_20": r.std("volume", 20),
        "obv": total("_obv_step", "_obv__carry"),
        "cmf": fdiv(r.sum("_mfv", 20), r.sum("volume", 20)),
        "mfi": ind.mfi_from_flows(r, 14),
        "price_volume_corr_20": r.corr("close", "volume", 20),
        "volume_percentile_100": r.percentile_rank("volume", 100),
    }
    hidden = {
        "_cum_flow": F.when(c("_flow").isNotNull(), total("_flow", "_tpv__carry")),
        "_cum_volume": F.when(c("volume").isNotNull(), total("volume", "_vol__carry")),
    }
    layers.put("windows", **windows, **hidden)
    level1 = {
        "volume_ratio": ratio("volume", "volume_sma_20"),
        "volume_cv": ratio("volume_std_20", "volume_sma_20"),
        "vwap": ratio("_cum_flow", "_cum_volume"),
    }
    layers.put("level1", **level1)
    layers.put("windows2", obv_sma_20=r.mean("obv", 20))
    gap = c("obv") - c("obv_sma_20")
    final = {
        "obv_divergence": ratio(gap, F.abs("obv_sma_20")),
        "price_vs_vwap": ratio(c("close") - c("vwap"), "vwap"),
    }
    layers.put("final1", **final)
    shown = [n for n in changes if not n.startswith("_")]
    rest = ["typical_price", "volume_ema_20", "obv_sma_20"]
    return [*shown, *windows, *level1, *rest, *final]


def _funding(r: Rolling, layers: _Layers, ewm1, ewm2, wanted) -> list[str]:
    x, c = "funding_rate", F.col
    changes = {"funding_change": r.diff(x), "funding_change_24h": r.diff(x, 288)}
    layers.put("lags", **changes)
    windows = {
        "cumulative_funding_7d": r.long_sum(x, 168),
        "cumulative_funding_30d": r.long_sum(x, 672),
        "funding_mean_100": r.mean(x, 100),
        "funding_std_100": r.std(x, 100),
        "funding_percentile": r.percentile_rank(x, 100),
        "funding_momentum": r.slope(x, 10),
    }
    layers.put("windows", **windows)
    final = {
        "funding_zscore": ratio(c(x) - c("funding_mean_100"), "funding_std_100"),
        "funding_extreme_positive": flag(c(x) > 0.05),
        "funding_extreme_negative": flag(c(x) < -0.02),
    }
    layers.put("final1", **final)
    return [*changes, *windows, *final]


def _liquidation(r: Rolling, layers: _Layers, ewm1, ewm2, wanted) -> list[str]:
    c = F.col
    layers.put("inputs", net_liquidation=c("short_liq_volume") - c("long_liq_volume"))
    layers.put("lags", liq_momentum=r.pct("liq_volume", 12))
    windows = {
        "liq_volume_1h": r.sum("liq_volume", 12),
        "liq_volume_4h": r.long_sum("liq_volume", 48),
        "liq_count_1h": r.sum("liq_count", 12),
        "net_liquidation_1h": r.sum("net_liquidation", 12),
        "liq_spike": flag(c("liq_volume") > 2 * r.mean("liq_volume", 24)),
    }
    layers.put("windows", **windows)
    return ["net_liquidation", "liq_momentum", *windows]


def _ls_ratio(r: Rolling, layers: _Layers, ewm1, ewm2, wanted) -> list[str]:
    x, c = "_ratio", F.col
    layers.put("inputs", _ratio=r.ffill("longShortRatio"))
    changes = {
        f"ls_ratio_change_{name}": r.diff(x, k) for name, k in {"1h": 12, "4h": 48, "24h": 288}.items()
    }
    layers.put("lags", **changes)
    ewm1["ls_ratio_ema_20"] = (x, 20)
    windows = {
        "ls_ratio_sma_20": r.mean(x, 20),
        "ls_ratio_percentile": r.percentile_rank(x, 100),
    }
    hidden = {"_ratio_mean_100": r.mean(x, 100), "_ratio_std_100": r.std(x, 100)}
    layers.put("windows", **windows, **hidden)
    final = {
        "ls_ratio_extreme_long": flag(c(x) > 1.5),
        "ls_ratio_extreme_short": flag(c(x) < 0.7),
        "ls_ratio_zscore": ratio(c(x) - c("_ratio_mean_100"), "_ratio_std_100"),
        "longShortRatio": c(x),
    }
    layers.put("final1", **final)
    shown = [n for n in final if n != "longShortRatio"]
    return [*changes, *windows, "ls_ratio_ema_20", *shown]


def time_columns(ts: str = "ts") -> tuple[dict[str, Column], dict[str, Column]]:
    """Calendar parts (H1-H4) and what is derived from them."""
    t = F.col(ts)
    parts = {
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "day_of_month": F.dayofmonth(t),
        "month": F.month(t),
    }
    h, d, m = F.col("hour"), F.col("day_of_week"), F.col("month")
    derived: dict[str, Column] = {}
    for name, value, period in (
        ("hour", h, 24),
        ("day", d, 7),
        ("month", m, 12),
        ("funding_cycle", h % 8, 8),
    ):
        angle = 2 * math.pi * value / F.lit(float(period))
        derived[f"{name}_sin"] = F.sin(angle)
        derived[f"{name}_cos"] = F.cos(angle)
    derived |= {
        "is_asia_session": flag((h >= 0) & (h < 8)),
        "is_europe_session": flag((h >= 7) & (h < 16)),
        "is_us_session": flag((h >= 13) & (h < 22)),
        "is_weekend": flag(d >= 5),
    }
    return parts, derived


def _time(r: Rolling, layers: _Layers, ewm1, ewm2, wanted) -> list[str]:
    parts, derived = time_columns(r.seg.series.order)
    layers.put("inputs", **parts)
    layers.put("final1", **derived)
    return [*parts, *derived]


def _interaction(r: Rolling, layers: _Layers, ewm1, ewm2, wanted) -> list[str]:
    c, have = F.col, set(wanted)
    rows: list[tuple[set[str], str, Callable[[], Column]]] = [
        ({"oi", "volume"}, "oi_volume_ratio", lambda: ratio("open_interest", "volume_sma_20")),
        (
            {"oi", "volume"},
            "oi_volume_divergence",
            lambda: sign("oi_pct_change_1") - sign("volume_change"),
        ),
        (
            {"price", "funding"},
            "rsi_funding_interaction",
            lambda: c("rsi_14") * c("funding_rate"),
        ),
        ({"price", "oi"}, "oi_price_momentum", lambda: c("oi_pct_change_20") * c("return_20")),
        ({"price", "volume"}, "volume_volatility", lambda: c("volume_ratio") * c("natr")),
        (
            {"price", "funding"},
            "funding_price_momentum",
            lambda: c("funding_rate") * c("return_20"),
        ),
        (
            {"price", "oi"},
            "oi_price_macd_interaction",
            lambda: c("oi_macd") * c("MACD_12_26_9"),
        ),
        (
            {"price", "liquidation"},
            "liq_volatility",
            lambda: c("liq_volume_1h") * c("realized_vol_20"),
        ),
        (
            {"price", "ls_ratio"},
            "ls_rsi_interaction",
            lambda: c("_ratio") * (c("rsi_14") - 50),
        ),
        (
            {"price", "oi"},
            "oi_price_extreme",
            lambda: c("oi_zscore") * (c("bb_position") - 0.5),
        ),
    ]
    built = {name: make() for needs, name, make in rows if needs <= have}
    layers.put("final2", **built)
    return list(built)


_BUILDERS = {
    "oi": _oi,
    "price": _price,
    "volume": _volume,
    "funding": _funding,
    "liquidation": _liquidation,
    "ls_ratio": _ls_ratio,
    "time": _time,
    "interaction": _interaction,
}
