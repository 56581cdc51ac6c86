"""Technical indicators (TA1-TA13) as expressions and as table operators.

The table operators take a bar table of any origin; column names can be
overridden.  Simple-mean smoothing is used throughout (no Wilder smoothing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import Rolling
from ..functions.scalar import fdiv, sign
from .ewm import add_ewm, ewm, memory
from .prefix import DEFAULT, Series, running_sum
from .segments import RN, Segmented, segment


# ------------------------------------------------------------ expressions
def bar_steps(r: Rolling) -> dict[str, Column]:
    """First-order inputs shared by RSI, ATR and ADX."""
    c = F.col
    move = r.diff("close")
    prev = r.lag("close")
    return {
        "_gain": F.when(move > 0, move).otherwise(0.0),
        "_loss": F.when(move < 0, -move).otherwise(0.0),
        "_tr": F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)),
        "_up": r.diff("high"),
        "_down": -r.diff("low"),
    }


def directional_moves() -> dict[str, Column]:
    up, down = F.col("_up"), F.col("_down")
    return {
        "_plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    }


def rsi_from_moves(r: Rolling, n: int) -> Column:
    return 100 - fdiv(F.lit(100.0), 1 + fdiv(r.mean("_gain", n), r.mean("_loss", n)))


def roc(r: Rolling, x: str, n: int) -> Column:
    return 100 * fdiv(r.diff(x, n), r.lag(x, n))


def stoch_raw(r: Rolling, n: int) -> Column:
    low, high = r.min("low", n), r.max("high", n)
    return fdiv(100 * (F.col("close") - low), high - low)


def willr(r: Rolling, n: int) -> Column:
    low, high = r.min("low", n), r.max("high", n)
    return fdiv(-100 * (high - F.col("close")), high - low)


def market_structure(r: Rolling, n: int) -> Column:
    """+1 above both extremes of the previous n bars' highs and lows' maxima,
    -1 below both minima, else 0; 0 until n bars precede."""
    frame = r.seg.previous(n)
    h, low = F.col("high"), F.col("low")
    up = (h > F.max("high").over(frame)) & (low > F.max("low").over(frame))
    down = (h < F.min("high").over(frame)) & (low < F.min("low").over(frame))
    state = F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0))
    return F.when(F.col(RN) < n, F.lit(0)).otherwise(state)


def money_flow_multiplier() -> Column:
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    return F.coalesce(fdiv((c - low) - (h - c), h - low), F.lit(0.0))


def signed_flows() -> dict[str, Column]:
    move = F.col("_tp_move")
    return {
        "_flow_in": F.when(move > 0, F.col("_flow")).otherwise(0.0),
        "_flow_out": F.when(move < 0, F.col("_flow")).otherwise(0.0),
    }


def mfi_from_flows(r: Rolling, n: int) -> Column:
    balance = fdiv(r.sum("_flow_in", n), r.sum("_flow_out", n))
    return 100 - fdiv(F.lit(100.0), 1 + balance)


# -------------------------------------------------------- table operators
def _named(df: DataFrame, **names: str) -> DataFrame:
    """Expose user columns under the roles the expressions read."""
    return df.withColumns({role: F.col(src) for role, src in names.items() if role != src})


def _finish(seg: Segmented, df: DataFrame, outputs: dict[str, str]) -> DataFrame:
    """Original columns plus ``{output name: computed column}``."""
    kept = [F.col(c) for c in df.columns if c not in outputs]
    return seg.finish(*kept, *[F.col(v).alias(k) for k, v in outputs.items()])


def _start(df: DataFrame, series: Series, halo: int, spans=()) -> tuple[Segmented, Rolling]:
    block = max([memory(s) for s in spans], default=1 << 20)
    halo = max([halo, *[memory(s) for s in spans]])
    seg = segment(df, halo=halo, series=series, block_rows=block)
    return seg, Rolling(seg)


def sma(df: DataFrame, column: str, length: int, out: str = "sma", series: Series = DEFAULT):
    seg, r = _start(df, series, length)
    return _finish(seg.add({"_v": r.mean(column, length)}), df, {out: "_v"})


def ema(df: DataFrame, column: str, length: int, out: str = "ema", series: Series = DEFAULT):
    """Gap-aware exponential average."""
    return ewm(df, {out: (column, length)}, series)


def rsi(df: DataFrame, column: str = "close", length: int = 14, series: Series = DEFAULT):
    seg, r = _start(df, series, length + 2)
    move = r.diff(column)
    seg = seg.add(
        {
            "_gain": F.when(move > 0, move).otherwise(0.0),
            "_loss": F.when(move < 0, -move).otherwise(0.0),
        }
    )
    return _finish(seg.add({"_v": rsi_from_moves(r, length)}), df, {f"rsi_{length}": "_v"})


def macd(
    df: DataFrame,
    column: str = "close",
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    series: Series = DEFAULT,
    gaps: bool | None = None,
):
    """MACD line, signal and histogram.

    A column with interior gaps (looked up, unless ``gaps`` says so) takes its
    two averages from the gap-aware scan.  They are carried over gaps, so the
    signal's input has none.
    """
    if gaps is None:
        t, x = F.col(series.order), F.col(column)
        spans = df.groupBy(*series.keys).agg(
            F.min(F.when(x.isNotNull(), t)).alias("_from"), F.max(F.when(x.isNull(), t)).alias("_miss")
        )
        gaps = not spans.where(F.col("_miss") > F.col("_from")).isEmpty()
    source = ewm(df, {"_fast": (column, fast), "_slow": (column, slow)}, series) if gaps else df
    seg, _ = _start(source, series, memory(slow) + memory(signal), (fast, slow, signal))
    if not gaps:
        seg = add_ewm(seg, {"_fast": (column, fast), "_slow": (column, slow)})
    seg = seg.add({"_macd": F.col("_fast") - F.col("_slow")})
    seg = add_ewm(seg, {"_signal": ("_macd", signal)})
    seg = seg.add({"_hist": F.col("_macd") - F.col("_signal")})
    tag = f"{fast}_{slow}_{signal}"
    outputs = {f"MACD_{tag}": "_macd", f"MACDs_{tag}": "_signal", f"MACDh_{tag}": "_hist"}
    return _finish(seg, df, outputs)


def stoch(df: DataFrame, k: int = 14, d: int = 3, smooth_k: int = 3, series: Series = DEFAULT):
    seg, r = _start(df, series, k + d + smooth_k)
    seg = seg.add({"_raw": stoch_raw(r, k)}).add({"_k": r.mean("_raw", smooth_k)})
    seg = seg.add({"_d": r.mean("_k", d)})
    tag = f"{k}_{d}_{smooth_k}"
    return _finish(seg, df, {f"STOCHk_{tag}": "_k", f"STOCHd_{tag}": "_d"})


def rate_of_change(df: DataFrame, column: str, length: int = 10, series: Series = DEFAULT):
    seg, r = _start(df, series, length + 1)
    return _finish(seg.add({"_v": roc(r, column, length)}), df, {f"roc_{length}": "_v"})


def williams_r(df: DataFrame, length: int = 14, series: Series = DEFAULT):
    seg, r = _start(df, series, length)
    return _finish(seg.add({"_v": willr(r, length)}), df, {f"willr_{length}": "_v"})


def atr(df: DataFrame, length: int = 14, series: Series = DEFAULT):
    seg, r = _start(df, series, length + 2)
    seg = seg.add({"_tr": bar_steps(r)["_tr"]})
    return _finish(seg.add({"_v": r.mean("_tr", length)}), df, {f"atr_{length}": "_v"})


def bbands(
    df: DataFrame, column: str = "close", length: int = 20, std: int = 2, series: Series = DEFAULT
):
    seg, r = _start(df, series, length)
    seg = seg.add({"_m": r.mean(column, length), "_w": r.std(column, length) * std})
    seg = seg.add({"_l": F.col("_m") - F.col("_w"), "_u": F.col("_m") + F.col("_w")})
    band = F.col("_u") - F.col("_l")
    seg = seg.add({"_b": fdiv(band, "_m"), "_p": fdiv(F.col(column) - F.col("_l"), band)})
    tag = f"{length}_{std}"
    letters = {"L": "_l", "M": "_m", "U": "_u", "B": "_b", "P": "_p"}
    return _finish(seg, df, {f"BB{k}_{tag}": v for k, v in letters.items()})


def adx(df: DataFrame, length: int = 14, series: Series = DEFAULT):
    seg, r = _start(df, series, 2 * length + 2)
    steps = bar_steps(r)
    seg = seg.add({k: steps[k] for k in ("_tr", "_up", "_down")}).add(directional_moves())
    seg = seg.add({"_a": r.mean("_tr", length)} | {
        "_pm": r.mean("_plus_dm", length), "_mm": r.mean("_minus_dm", length)
    })
    seg = seg.add({"_p": 100 * fdiv("_pm", "_a"), "_m": 100 * fdiv("_mm", "_a")})
    dx = 100 * fdiv(F.abs(F.col("_p") - F.col("_m")), F.col("_p") + F.col("_m"))
    seg = seg.add({"_dx": dx}).add({"_v": r.mean("_dx", length)})
    return _finish(
        seg, df, {f"ADX_{length}": "_v", f"DMP_{length}": "_p", f"DMN_{length}": "_m"}
    )


def obv(df: DataFrame, close: str = "close", volume: str = "volume", series: Series = DEFAULT):
    """On-balance volume: an exact running sum over the whole series."""
    seg, r = _start(df, series, 1)
    move = F.coalesce(sign(r.diff(close)), F.lit(0.0))
    stepped = seg.add(
        {"_step": F.when(F.col(RN) == 0, F.col(volume)).otherwise(move * F.col(volume))}
    ).finish(*df.columns, "_step")
    return running_sum(stepped, {"obv": "_step"}, series).drop("_step")


def cmf(df: DataFrame, length: int = 20, series: Series = DEFAULT):
    seg, r = _start(df, series, length)
    seg = seg.add({"_mfv": money_flow_multiplier() * F.col("volume")})
    seg = seg.add({"_v": fdiv(r.sum("_mfv", length), r.sum("volume", length))})
    return _finish(seg, df, {"cmf": "_v"})


def mfi(df: DataFrame, length: int = 14, series: Series = DEFAULT):
    seg, r = _start(df, series, length + 2)
    c = F.col
    seg = seg.add({"_tp": (c("high") + c("low") + c("close")) / 3.0})
    seg = seg.add({"_flow": c("_tp") * c("volume"), "_tp_move": r.diff("_tp")})
    seg = seg.add(signed_flows()).add({"_v": mfi_from_flows(r, length)})
    return _finish(seg, df, {"mfi": "_v"})
