"""Segments, prefixes, fills and averages against pandas, on awkward data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fill as fills
from tidemark.operators import indicators
from tidemark.operators.balance import balance_classes, hash_rank
from tidemark.operators.ewm import add_ewm, ewm, memory
from tidemark.operators.features import feature_frame, feature_names
from tidemark.operators.prefix import DEFAULT, row_index, running_sum
from tidemark.operators.segments import segment
from tidemark.operators.stats import kendall_tau
from tidemark.plans.derived import FIVE_MINUTES, Feeds
from tidemark.plans.feature_table import engineer_all, features_unfilled
from tidemark.session import stored

SMALL = DEFAULT.with_(segment_rows=300)


def frame(seed: int = 0) -> pd.DataFrame:
    """One long symbol with gaps, one short, one with a single row."""
    rng = np.random.default_rng(seed)
    parts = []
    for symbol, n, start in (("A", 2500, "2024-01-01"), ("B", 40, "2024-01-03"), ("C", 1, "2024-02-01")):
        ts = pd.date_range(start, periods=n, freq="5min")
        x = 100 + rng.normal(size=n).cumsum()
        g = np.where(rng.random(n) > 0.5, x, np.nan)
        parts.append(pd.DataFrame({"symbol": symbol, "ts": ts, "x": x, "g": g}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[900:1700, "g"] = np.nan
    pdf.loc[:30, "g"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def pdf():
    return frame()


@pytest.fixture(scope="module")
def df(spark, pdf):
    out = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))
    return stored(out.withColumn("g", F.nanvl("g", F.lit(None))).repartition(5), "t")


def back(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def same(a, b, tol=1e-9):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.nanmax(np.abs(a - b)) < tol


def test_row_index_and_running_sum(df, pdf):
    out = back(running_sum(row_index(df, SMALL, "rn", "n"), {"s": "x"}, SMALL))
    by = pdf.groupby("symbol")
    assert (out["rn"] == by.cumcount()).all()
    assert (out["n"] == by["x"].transform("size")).all()
    same(out["s"], by["x"].cumsum(), 1e-6)


@pytest.mark.parametrize("rows", [300, 100_000])
def test_ewm_dense(df, pdf, rows):
    seg = segment(df, memory(26), DEFAULT.with_(segment_rows=rows), block_rows=memory(26))
    out = back(add_ewm(seg, {"a": ("x", 26), "b": ("x", 9)}).finish("symbol", "ts", "a", "b"))
    by = pdf.groupby("symbol")["x"]
    for c, span in (("a", 26), ("b", 9)):
        same(out[c], by.transform(lambda v, s=span: v.ewm(span=s, adjust=False).mean()))


def test_ewm_with_gaps(df, pdf):
    out = back(ewm(df, {"a": ("g", 26), "b": ("g", 3), "c": ("g", 1)}, SMALL))
    by = pdf.groupby("symbol")["g"]
    for c, span in (("a", 26), ("b", 3), ("c", 1)):
        same(out[c], by.transform(lambda v, s=span: v.ewm(span=s, adjust=False).mean()))


@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_fill(df, pdf, method):
    out = back(fills.fill(df, ["g"], method, SMALL))
    same(out["g"], getattr(pdf.groupby("symbol")["g"], method)())


def test_interpolate(df, pdf):
    out = back(fills.fill(df, ["g"], "interpolate", SMALL))
    want = pd.concat(
        [d.set_index("ts")["g"].interpolate(method="time") for _, d in pdf.groupby("symbol")]
    )
    same(out["g"], want.to_numpy())


def test_fill_all(df, pdf):
    by = pdf.groupby("symbol")["g"]
    same(back(fills.fill_all(df, ["g"], SMALL))["g"], by.transform(lambda v: v.ffill().bfill().fillna(0)))
    same(
        back(fills.fill_all(df, ["g"], SMALL, "causal"))["g"],
        by.transform(lambda v: v.ffill().fillna(0)),
    )
    with pytest.raises(ValueError):
        fills.fill_all(df, ["g"], SMALL, "other")


def test_rolling_indicators_cross_segments(df, pdf):
    by = pdf.groupby("symbol")["x"]
    same(back(indicators.sma(df, "x", 50, series=SMALL))["sma"], by.transform(lambda v: v.rolling(50).mean()))
    d = by.diff()
    gain = d.where(d > 0, 0).groupby(pdf["symbol"]).transform(lambda v: v.rolling(14).mean())
    loss = (-d.where(d < 0, 0)).groupby(pdf["symbol"]).transform(lambda v: v.rolling(14).mean())
    same(back(indicators.rsi(df, "x", series=SMALL))["rsi_14"], 100 - 100 / (1 + gain / loss))


def test_constant_series(spark):
    pdf = pd.DataFrame(
        {
            "symbol": "A",
            "ts": pd.date_range("2024-01-01", periods=60, freq="5min"),
            **{c: 5.0 for c in ("open", "high", "low", "close")},
            "volume": 0.0,
            "open_interest": 7.0,
        }
    )
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))
    last = back(feature_frame(df)).iloc[-1]
    # 0/0 is missing, never an error and never NaN turned into a value
    for c in ("rsi_14", "STOCHk_14_3_3", "ADX_14", "cmf", "price_volume_corr_20", "volume_change"):
        assert pd.isna(last[c]), c
    assert last["oi_r_squared_20"] == 0 and last["oi_trend_slope_20"] == 0
    assert last["bb_width"] == 0 and last["obv"] == 0


@pytest.fixture(scope="module")
def feeds(spark):
    return Feeds.read(spark, "/root/testdata/sf0.001")


def _joined(feeds):
    return stored(feeds.joined(), "joined")


def test_feature_count_and_segment_independence(feeds):
    joined = _joined(feeds)
    few = back(feature_frame(joined))
    many = back(feature_frame(joined, series=DEFAULT.with_(segment_rows=64)))
    names = feature_names(feature_frame(joined))
    assert len(names) == 160
    for c in names:
        a, b = few[c].to_numpy(dtype=float), many[c].to_numpy(dtype=float)
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)


def test_gapped_open_interest_uses_gap_aware_average(feeds):
    joined = _joined(feeds)
    holes = joined.withColumn(
        "open_interest", F.when(F.hour("ts") % 3 > 0, F.col("open_interest"))
    )
    got = back(features_unfilled(stored(holes, "holes")))
    want = got.groupby("symbol")["open_interest"].transform(
        lambda v: v.ewm(span=12, adjust=False).mean()
    )
    same(got["oi_ema_12"], want, 1e-6)


def test_causal_mode_does_not_look_ahead(feeds):
    """Cutting the future off must not change the past."""
    cut = "2024-01-20"
    args = [feeds.ohlcv(), feeds.open_interest(), feeds.funding(), feeds.liquidations(), feeds.ls_ratio()]
    whole = engineer_all(*args, fill_mode="causal").where(F.col("ts") < cut)
    past = engineer_all(*[a.where(F.col("ts") < cut) for a in args], fill_mode="causal")
    a, b = back(whole), back(past)
    assert len(a) == len(b) > 0
    for c in a.columns[2:]:
        np.testing.assert_allclose(
            a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float), rtol=1e-9, atol=1e-9, err_msg=c
        )


def test_windows_are_partitioned_by_segment(feeds):
    plan = feature_frame(_joined(feeds))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_seg" in line]
    assert len(wide) == 1


def test_hash_rank_and_balance(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 == 0, 0).when(F.col("id") % 10 == 1, 2).otherwise(1).alias("y")
    )
    ranked = hash_rank(df, ["y"], ["id"], 42, "r", "n").toPandas()
    for _, g in ranked.groupby("y"):
        assert sorted(g["r"]) == list(range(len(g))) and (g["n"] == len(g)).all()
    under = balance_classes(df, "y", "undersample", ["id"]).groupBy("y").count().toPandas()
    assert set(under["count"]) == {500}
    over = balance_classes(df, "y", "oversample", ["id"])
    assert set(over.groupBy("y").count().toPandas()["count"]) == {4000}
    per_row = over.groupBy("y", "id").count().toPandas()
    assert per_row.groupby("y")["count"].agg(lambda s: s.max() - s.min()).max() <= 1


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, 400), rng.integers(0, 9, 400)
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    scale = np.sqrt(np.abs(np.sign(x[:, None] - x)).sum() * np.abs(np.sign(y[:, None] - y)).sum())
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert abs(kendall_tau(df, "x", "y").first()[0] - s.sum() / scale) < 1e-12


def test_five_minute_bars_keep_every_tick(spark, sf_dir):
    f = Feeds.read(spark, sf_dir, FIVE_MINUTES)
    assert f.ohlcv().agg(F.sum("volume")).first()[0] == f.ticks.agg(F.sum("qty")).first()[0]
