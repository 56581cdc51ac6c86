"""Comparison SQL by query name."""

from __future__ import annotations

from tidemark.plans.families import FAMILIES

from . import features as f
from .build import feeds
from .operators import SQL, feature_table_sql

_STEPS = {
    "oi": (f.oi,),
    "price": (f.price,),
    "volume": (f.volume,),
    "funding": (f.funding,),
    "liquidation": (f.liquidation,),
    "ls_ratio": (f.ls_ratio,),
    "time": (f.time,),
    "interaction": (f.interaction,),
}
_SMOOTHED = {
    "feat_oi_trend": (("oi_ema_12", "oi_ema_26", "oi_macd_signal"), (f.oi_ewm,)),
    "feat_price_trend": (("ema_12", "ema_26"), ()),
    "feat_price_momentum": (("ema_12", "ema_26", "ema20", "macds"), (f.price_ewm,)),
    "feat_price_volatility": (("ema_12", "ema_26", "ema20", "macds"), (f.price_ewm,)),
    "feat_volume_stats": (("volume_ema_20",), ()),
    "feat_ls_ratio": (("ls_ratio_ema_20",), ()),
    "feat_interaction": (("oi_ema_12", "oi_ema_26", "ema_12", "ema_26"), ()),
}


def family_sql() -> dict[str, str]:
    out = {}
    for name, (groups, columns) in FAMILIES.items():
        names, after = _SMOOTHED.get(name, ((), ()))
        q = f.smoothed(feeds(), *names) if names else feeds()
        for g in groups:
            for step in _STEPS[g]:
                q = step(q)
        for step in after:
            q = step(q)
        out[name] = q.rows(*columns)
    return out


def all_sql() -> dict[str, str]:
    names = sorted({c for _, columns in FAMILIES.values() for c in columns})
    return {**family_sql(), **SQL, "feature_table": feature_table_sql(names)}
