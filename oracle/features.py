"""Comparison SQL of the feature families."""

from __future__ import annotations

from .build import (
    Query,
    diff,
    fdiv,
    feeds,
    flag,
    frame,
    full,
    high,
    lag,
    log_return,
    low,
    mean,
    pct,
    percentile,
    ratio,
    sgn,
    slope,
    std,
    total,
    with_ewm,
)

EWMS = {
    "oi_ema_12": ("open_interest", 12),
    "oi_ema_26": ("open_interest", 26),
    "ema_12": ("close", 12),
    "ema_26": ("close", 26),
    "ema20": ("close", 20),
    "volume_ema_20": ("volume", 20),
    "ls_ratio_ema_20": ("ratio", 20),
}
SIGNALS = {"oi_macd_signal": ("oi_ema_12", "oi_ema_26"), "macds": ("ema_12", "ema_26")}


def divergence(x: str, n: int) -> str:
    d1, d2 = f"sign({diff(x, n)})", f"sign({diff('close', n)})"
    return (
        f"CASE WHEN ({d1}) IS DISTINCT FROM ({d2}) AND ({d2}) > 0 THEN -1 "
        f"WHEN ({d1}) IS DISTINCT FROM ({d2}) AND ({d2}) < 0 THEN 1 ELSE 0 END"
    )


def oi(q: Query) -> Query:
    x = "open_interest"
    q = q.add(
        oi_change_abs=diff(x),
        oi_pct_change_1=pct(x, 1),
        oi_pct_change_5=pct(x, 5),
        oi_pct_change_20=pct(x, 20),
        oi_log_return=log_return(x),
        oi_velocity_1h=fdiv(diff(x, 12), lag(x, 12)),
        oi_velocity_4h=fdiv(diff(x, 48), lag(x, 48)),
        oi_velocity_24h=fdiv(diff(x, 288), lag(x, 288)),
        oi_sma_20=mean(x, 20),
        oi_sma_50=mean(x, 50),
        oi_sma_200=mean(x, 200),
        oi_trend_slope_20=slope(x, 20),
        oi_trend_slope_50=slope(x, 50),
        oi_r_squared_20=full(
            x,
            20,
            f"CASE WHEN min({x}) OVER {frame(20)} = max({x}) OVER {frame(20)} THEN 0.0 ELSE regr_r2({x}, rn) OVER {frame(20)} END",
        ),
        oi_std_20=std(x, 20),
        oi_std_50=std(x, 50),
        oi_price_divergence_20=divergence(x, 20),
        oi_price_divergence_48=divergence(x, 48),
        oi_price_divergence_288=divergence(x, 288),
        oi_percentile_100=percentile(x, 100),
        hi100=high(x, 100),
        lo100=low(x, 100),
    )
    return q.add(
        oi_acceleration=diff("oi_velocity_1h"),
        oi_bb_upper="oi_sma_20 + 2 * oi_std_20",
        oi_bb_lower="oi_sma_20 - 2 * oi_std_20",
        oi_bb_position=ratio(f"{x} - (oi_sma_20 - 2 * oi_std_20)", "4 * oi_std_20"),
        oi_bb_width=ratio("4 * oi_std_20", "oi_sma_20"),
        oi_cv=ratio("oi_std_20", "oi_sma_20"),
        oi_zscore=ratio(f"{x} - oi_sma_50", "oi_std_50"),
        oi_dist_from_high=ratio(f"{x} - hi100", "hi100"),
        oi_dist_from_low=ratio(f"{x} - lo100", "lo100"),
    )


def oi_ewm(q: Query) -> Query:
    return q.add(
        oi_macd="oi_ema_12 - oi_ema_26",
        oi_macd_histogram="oi_ema_12 - oi_ema_26 - oi_macd_signal",
    )


def rsi(n: int) -> str:
    return f"100 - {fdiv('100.0', '1 + ' + fdiv('(' + mean('gain', n) + ')', '(' + mean('loss', n) + ')'))}"


def price(q: Query) -> Query:
    q = q.add(
        **{f"return_{k}": pct("close", k) for k in (1, 5, 10, 20, 50, 100)},
        **{f"log_return_{k}": log_return("close", k) for k in (1, 5, 20)},
        **{f"sma_{n}": mean("close", n) for n in (10, 20, 50, 200)},
        roc_10=f"100 * {fdiv(diff('close', 10), lag('close', 10))}",
        roc_30=f"100 * {fdiv(diff('close', 30), lag('close', 30))}",
        gain=f"CASE WHEN {diff('close')} > 0 THEN {diff('close')} ELSE 0 END",
        loss=f"CASE WHEN {diff('close')} < 0 THEN -{diff('close')} ELSE 0 END",
        tr=f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))",
        up=diff("high"),
        dn=f"-{diff('low')}",
        hh14=high("high", 14),
        ll14=low("low", 14),
        sd20=std("close", 20),
    )
    q = q.add(
        rsi_14=rsi(14),
        rsi_50=rsi(50),
        atr_14=mean("tr", 14),
        atr_50=mean("tr", 50),
        willr_14=fdiv("-100 * (hh14 - close)", "hh14 - ll14"),
        stoch=fdiv("100 * (close - ll14)", "hh14 - ll14"),
        realized_vol_20=f"({std('log_return_1', 20)}) * sqrt(288)",
        pdm="CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END",
        mdm="CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END",
        market_structure=(
            "CASE WHEN rn <= 20 THEN 0 "
            f"WHEN high > max(high) OVER p AND low > max(low) OVER p THEN 1 "
            f"WHEN high < min(high) OVER p AND low < min(low) OVER p THEN -1 ELSE 0 END"
        ).replace(
            "OVER p",
            "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
        ),
    )
    q = q.add(
        natr=ratio("atr_14", "close"),
        sma_cross_20_50="sign(sma_20 - sma_50)",
        **{f"price_vs_sma{n}": ratio(f"close - sma_{n}", f"sma_{n}") for n in (10, 20, 50, 200)},
        bbl_20_2="sma_20 - 2 * sd20",
        bbm_20_2="sma_20",
        bbu_20_2="sma_20 + 2 * sd20",
        stochk_14_3_3=mean("stoch", 3),
        dmp_14=f"100 * {fdiv(mean('pdm', 14), 'atr_14')}",
        dmn_14=f"100 * {fdiv(mean('mdm', 14), 'atr_14')}",
    )
    return q.add(
        stochd_14_3_3=mean("stochk_14_3_3", 3),
        dx=f"100 * {fdiv('abs(dmp_14 - dmn_14)', 'dmp_14 + dmn_14')}",
        bbb_20_2=fdiv("bbu_20_2 - bbl_20_2", "bbm_20_2"),
        bbp_20_2=fdiv("close - bbl_20_2", "bbu_20_2 - bbl_20_2"),
        bb_width=ratio("bbu_20_2 - bbl_20_2", "bbm_20_2"),
        bb_position=ratio("close - bbl_20_2", "bbu_20_2 - bbl_20_2"),
    ).add(adx_14=mean("dx", 14))


def price_ewm(q: Query) -> Query:
    return q.add(
        macd_12_26_9="ema_12 - ema_26",
        macds_12_26_9="macds",
        macdh_12_26_9="ema_12 - ema_26 - macds",
        kc_upper="ema20 + 2 * atr_14",
        kc_lower="ema20 - 2 * atr_14",
        kc_width=ratio("4 * atr_14", "ema20"),
    )


def volume(q: Query) -> Query:
    q = q.add(
        volume_change=pct("volume", 1),
        volume_change_20=pct("volume", 20),
        volume_sma_20=mean("volume", 20),
        volume_sma_50=mean("volume", 50),
        volume_trend_20=slope("volume", 20),
        volume_std_20=std("volume", 20),
        volume_roc_10=f"100 * {fdiv(diff('volume', 10), lag('volume', 10))}",
        typical_price="(high + low + close) / 3.0",
        step=f"CASE WHEN rn = 1 THEN volume ELSE coalesce(sign({diff('close')}), 0) * volume END",
        mfm=f"coalesce({fdiv('(close - low) - (high - close)', 'high - low')}, 0)",
        volume_percentile_100=percentile("volume", 100),
        price_volume_corr_20=full(
            "close",
            20,
            f"CASE WHEN min(close) OVER {frame(20)} < max(close) OVER {frame(20)} AND min(volume) OVER {frame(20)} < max(volume) OVER {frame(20)} "
            f"THEN covar_pop(close, volume) OVER {frame(20)} / (stddev_pop(close) OVER {frame(20)} * stddev_pop(volume) OVER {frame(20)}) END",
        ),
    )
    q = q.add(
        obv="sum(step) OVER (PARTITION BY symbol ORDER BY ts)",
        tpmove=diff("typical_price"),
        flow="typical_price * volume",
        vwap=ratio(
            "sum(typical_price * volume) OVER (PARTITION BY symbol ORDER BY ts)",
            "sum(volume) OVER (PARTITION BY symbol ORDER BY ts)",
        ),
        mfv="mfm * volume",
        volume_ratio=ratio("volume", "volume_sma_20"),
        volume_cv=ratio("volume_std_20", "volume_sma_20"),
    )
    q = q.add(
        obv_sma_20=mean("obv", 20),
        cmf=fdiv(total("mfv", 20), total("volume", 20)),
        posf="CASE WHEN tpmove > 0 THEN flow ELSE 0 END",
        negf="CASE WHEN tpmove < 0 THEN flow ELSE 0 END",
        price_vs_vwap=ratio("close - vwap", "vwap"),
    )
    return q.add(
        obv_divergence=ratio("obv - obv_sma_20", "abs(obv_sma_20)"),
        mfi=f"100 - {fdiv('100.0', '1 + ' + fdiv('(' + total('posf', 14) + ')', '(' + total('negf', 14) + ')'))}",
    )


def funding(q: Query) -> Query:
    x = "funding_rate"
    q = q.add(
        funding_change=diff(x),
        funding_change_24h=diff(x, 288),
        cumulative_funding_7d=total(x, 168),
        cumulative_funding_30d=total(x, 672),
        funding_mean_100=mean(x, 100),
        funding_std_100=std(x, 100),
        funding_percentile=percentile(x, 100),
        funding_extreme_positive=flag(f"{x} > 0.05"),
        funding_extreme_negative=flag(f"{x} < -0.02"),
        funding_momentum=slope(x, 10),
    )
    return q.add(funding_zscore=ratio(f"{x} - funding_mean_100", "funding_std_100"))


def liquidation(q: Query) -> Query:
    q = q.add(net_liquidation="short_liq_volume - long_liq_volume")
    return q.add(
        liq_momentum=pct("liq_volume", 12),
        liq_volume_1h=total("liq_volume", 12),
        liq_volume_4h=total("liq_volume", 48),
        liq_count_1h=total("liq_count", 12),
        net_liquidation_1h=total("net_liquidation", 12),
        liq_spike=flag(f"liq_volume > 2 * ({mean('liq_volume', 24)})"),
    )


def ls_ratio(q: Query) -> Query:
    x = "ratio"
    q = q.add(
        ls_ratio_change_1h=diff(x, 12),
        ls_ratio_change_4h=diff(x, 48),
        ls_ratio_change_24h=diff(x, 288),
        ls_ratio_sma_20=mean(x, 20),
        ls_ratio_percentile=percentile(x, 100),
        ls_ratio_extreme_long=flag(f"{x} > 1.5"),
        ls_ratio_extreme_short=flag(f"{x} < 0.7"),
        m100=mean(x, 100),
        s100=std(x, 100),
    )
    return q.add(ls_ratio_zscore=ratio(f"{x} - m100", "s100"))


def time(q: Query) -> Query:
    q = q.add(
        hour="extract(hour FROM ts)",
        day_of_week="extract(isodow FROM ts) - 1",
        day_of_month="extract(day FROM ts)",
        month="extract(month FROM ts)",
    )
    return q.add(
        hour_sin="sin(2 * pi() * hour / 24)",
        hour_cos="cos(2 * pi() * hour / 24)",
        day_sin="sin(2 * pi() * day_of_week / 7)",
        day_cos="cos(2 * pi() * day_of_week / 7)",
        month_sin="sin(2 * pi() * month / 12)",
        month_cos="cos(2 * pi() * month / 12)",
        funding_cycle_sin="sin(2 * pi() * (hour % 8) / 8)",
        funding_cycle_cos="cos(2 * pi() * (hour % 8) / 8)",
        is_asia_session=flag("hour >= 0 AND hour < 8"),
        is_europe_session=flag("hour >= 7 AND hour < 16"),
        is_us_session=flag("hour >= 13 AND hour < 22"),
        is_weekend=flag("day_of_week >= 5"),
    )


def interaction(q: Query) -> Query:
    return q.add(
        oi_volume_ratio=ratio("open_interest", "volume_sma_20"),
        oi_volume_divergence=f"{sgn('oi_pct_change_1')} - {sgn('volume_change')}",
        rsi_funding_interaction="rsi_14 * funding_rate",
        oi_price_momentum="oi_pct_change_20 * return_20",
        volume_volatility="volume_ratio * natr",
        funding_price_momentum="funding_rate * return_20",
        oi_price_macd_interaction="(oi_ema_12 - oi_ema_26) * (ema_12 - ema_26)",
        liq_volatility="liq_volume_1h * realized_vol_20",
        ls_rsi_interaction="ratio * (rsi_14 - 50)",
        oi_price_extreme="oi_zscore * (bb_position - 0.5)",
    )


def smoothed(q: Query, *names: str) -> Query:
    """Add the recursive averages some family needs."""
    cols = {k: EWMS[k] for k in names if k in EWMS}
    sig = {k: SIGNALS[k] for k in names if k in SIGNALS}
    return with_ewm(q, cols, sig)


def everything() -> Query:
    q = with_ewm(feeds(), EWMS, SIGNALS)
    for step in (oi, oi_ewm, price, price_ewm, volume, funding, liquidation, ls_ratio, time, interaction):
        q = step(q)
    return q
