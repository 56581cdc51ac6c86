"""Cases beyond the driver tables: brackets, missing values, options."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import balance, fill, importance, metrics, models, quantiles, ranges, stats, trees
from tidemark.operators.indicators import macd
from tidemark.operators.prefix import Series, row_index
from tidemark.plans.feature_table import features_unfilled
from tidemark.sources.feeds import MarketSource
from tidemark.sources.model_store import load_trained, save_trained


@pytest.mark.parametrize("digit", [16, 9, 3])
@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_equal_numpy(spark, monkeypatch, digit, by):
    monkeypatch.setattr(quantiles, "DIGIT", digit)
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({
        "g": rng.choice(["a", "b"], 4000),
        "x": rng.lognormal(0, 8, 4000) * rng.choice([-1, 1], 4000),
        "y": rng.integers(-2, 3, 4000).astype(float) * rng.choice([-1.0, 1.0], 4000),
        "z": np.where(rng.random(4000) < 0.9, -0.0, rng.normal(0, 1e-300, 4000)),
    })
    frame.loc[frame.index % 7 == 0, "x"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g string, x double, y double, z double")
    df = df.withColumn("none", F.lit(None).cast("double"))
    rows = quantiles.exact_quantiles(df, ["x", "y", "z", "none"], [0.0, 0.25, 0.9, 1.0], by).collect()
    got = {(r["g"] if by else None, r["feature"]): r["q"] for r in rows}
    assert len(rows) == 3 * (2 if by else 1)
    for g, part in frame.groupby("g") if by else [(None, frame)]:
        for c in "xyz":
            for p in (0.0, 0.25, 0.9, 1.0):
                assert got[g, c][p] == pytest.approx(np.quantile(part[c].dropna(), p), rel=1e-12)


def test_doubles_keep_their_order():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 2.0, 1e300, np.inf])
    keys = quantiles.ordered(x)
    assert (np.diff(keys) > 0).all() and (quantiles.doubles(keys) == x).all() and quantiles.ordered(np.array([-0.0]))[0] == 0


@pytest.mark.parametrize("rows", [1 << 17, 40])
@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_correlations_with_hot_and_missing_values(spark, monkeypatch, rows, method):
    monkeypatch.setattr(ranges, "ROWS", rows)
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(0, 1, (400, 5)), columns=list("abcde"))
    frame["b"] = np.where(rng.random(400) < 0.8, 0.0, frame["a"].round(1))  # most rows have one value
    frame["c"] = (frame["a"] + frame["c"]).round(1)
    frame.loc[rng.random(400) < 0.3, "c"] = None
    frame.loc[rng.random(400) < 0.3, "d"] = None
    frame["e"] = frame["d"].where(frame["d"].isna(), frame["e"])
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in "abcde"))
    got = stats.correlation_pairs(df, list("abcde"), method).collect()
    assert len(got) == 10
    for r in got:
        part = frame[[r["feature_1"], r["feature_2"]]].dropna()
        if method == "spearman":
            want = part.corr("spearman").iloc[0, 1]
        else:
            x, y = (np.sign(part[c].to_numpy()[:, None] - part[c].to_numpy()) for c in part)
            want = (x * y).sum() / np.sqrt(np.abs(x).sum() * np.abs(y).sum())
        assert r["correlation"] == pytest.approx(want, abs=1e-12)
    assert [r["correlation"] for r in stats.correlation_pairs(df.limit(0), ["a", "b"], method).collect()] == [None]


def test_rank_correlations_need_no_job_a_pair(spark):
    df = spark.range(200).selectExpr(*[f"IF(id % {k + 2} = 0, NULL, hash(id, {k}) % 50) AS c{k}" for k in range(8)])
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for k in (3, 8):
        for method in ("spearman", "kendall"):
            spark.sparkContext.setJobGroup(f"{method}-{k}", "")
            stats.correlation_pairs(df, [f"c{i}" for i in range(k)], method).collect()
            jobs[method, k] = len(tracker.getJobIdsForGroup(f"{method}-{k}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(jobs[m, 8] <= jobs[m, 3] + 3 for m in ("spearman", "kendall")), jobs


def test_curve_ranges_follow_crowded_scores(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 100)
    df = spark.range(5000).selectExpr("CAST(id % 3 = 0 AS INT) AS label", "0.33 + id / 500000 AS score")
    df = df.selectExpr("label", "array(1 - score, score) AS probabilities")
    counts = metrics._score_counts(df, "label", "probabilities", (1,), None)
    sizes = [r["count"] for r in ranges.in_ranges(counts, ["class"], [F.desc("score")]).groupBy("_range").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 300
    points = metrics.roc_points(df, classes=(1,)).orderBy(F.desc("threshold")).toPandas()
    rows = df.selectExpr("label", "probabilities[1] AS score").toPandas().sort_values("score", ascending=False)
    assert points["tp"].tolist() == rows["label"].cumsum().tolist()
    assert points["fpr"].iloc[-1] == 1.0 and points["tpr"].iloc[-1] == 1.0


def test_correlation_uses_the_rows_of_each_pair(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(1e6, 1, (200, 4)), columns=list("abcd"))
    frame["b"] += frame["a"]
    frame.loc[frame.index % 3 == 0, "c"] = None
    frame.loc[frame.index % 5 == 0, "d"] = None
    frame["flat"] = 7.25
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, d double, flat double")
    for method in ("pearson", "spearman"):
        want = frame.corr(method)
        for r in stats.correlation_pairs(df, list(frame.columns), method).collect():
            w = want.loc[r["feature_1"], r["feature_2"]]
            assert (r["correlation"] is None) if np.isnan(w) else r["correlation"] == pytest.approx(w, abs=1e-9)


def test_regression_metrics_use_known_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (-3.0, -3.0), (4.0, None), (None, 1.0)], "label double, prediction double")
    r = metrics.regression_metrics(df).first()
    assert (r["n"], r["mse"], r["directional_accuracy"]) == (3, 0.0, 1.0) and r["correlation"] == pytest.approx(1.0)


def test_unbounded_jdbc_read_is_refused(spark):
    with pytest.raises(ValueError, match="one task"):
        MarketSource(spark, format="jdbc", options={"url": "jdbc:none"}).table("ohlcv")


def test_averages_of_columns_with_gaps(spark):
    rng = np.random.default_rng(3)
    n = 400
    close = 100 + rng.normal(0, 1, n).cumsum()
    frame = pd.DataFrame({
        "symbol": "A",
        "ts": pd.date_range("2024-01-01", periods=n, freq="h"),
        "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": rng.uniform(1, 9, n),
    })
    frame.loc[[50, 51, 52, 200], "close"] = None
    frame.loc[[3, 80, 81, 300], "volume"] = None
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    rows = [(a, t.to_pydatetime(), *[None if np.isnan(x) else x for x in rest]) for a, t, *rest in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, schema)
    ewm = lambda x, span: x.ewm(span=span, adjust=False).mean()
    fast, slow = ewm(frame["close"], 12), ewm(frame["close"], 26)
    signal = ewm(fast - slow, 9)

    out = features_unfilled(df).orderBy("ts").toPandas()
    assert "_ema_20" not in out.columns
    for name, want in (("ema_12", fast), ("ema_26", slow), ("MACD_12_26_9", fast - slow), ("MACDs_12_26_9", signal),
                       ("volume_ema_20", ewm(frame["volume"], 20))):
        assert np.allclose(out[name].astype(float), want, equal_nan=True), name
    single = macd(df).orderBy("ts").toPandas()
    assert np.allclose(single["MACDs_12_26_9"].astype(float), signal, equal_nan=True)
    plain = features_unfilled(df.fillna(5.0)).columns
    assert sorted(plain) == sorted(out.columns)


def test_a_loaded_model_predicts_the_same(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [("A", i, float(rng.integers(0, 3)), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "symbol string, ts long, label double, a double, b double")
    df = models.assemble(df, ["a", "b"], ["symbol", "ts", "label"]).cache()
    small = lambda: models.BoostedClassifier(max_iter=2, max_depth=2)
    forest = lambda: models.ForestClassifier(trees=3, max_depth=2)
    regressor = lambda: models.BoostedRegressor(max_iter=2, max_depth=2)
    trained = [small(), regressor(), models.StackedClassifier([small, forest], folds=2), models.StackedRegressor([regressor], folds=2)]
    for i, model in enumerate(trained):
        model.fit(df)
        save_trained(spark, model, str(tmp_path / str(i)))
        again = load_trained(spark, str(tmp_path / str(i)))
        pick = lambda m: [r["prediction"] for r in m.predict(df).orderBy("ts").collect()]
        assert type(again) is type(model) and pick(again) == pick(model)


def test_dense_series_are_cut_by_rows(spark):
    n = 200_000  # ticks of one symbol and day, a third of them at one time
    df = spark.range(n).selectExpr(
        "IF(id % 1000 = 0, 'B', 'A') AS symbol",
        "CAST(1704067200 + IF(id % 3 = 0, 4000, (id * 7919) % 80000) AS TIMESTAMP) AS ts",
        "id",
        "IF(hash(id) % 4 = 0, CAST(id AS DOUBLE), NULL) AS x",
    )
    ticks = Series(dense=10_000, ties=("id",))
    sizes = [r["count"] for r in ticks.bucketed(df).groupBy("symbol", "_bucket").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 30_000
    frame = df.toPandas().sort_values(["symbol", "ts", "id"])
    want = frame.assign(
        rn=frame.groupby("symbol").cumcount(), f=frame.groupby("symbol")["x"].ffill(), b=frame.groupby("symbol")["x"].bfill()
    ).sort_values("id")
    got = row_index(df, ticks, "rn", "size").select("id", "rn", "size")
    got = got.join(fill.ffill(df, ["x"], ticks).select("id", F.col("x").alias("f")), "id").join(fill.bfill(df, ["x"], ticks).select("id", F.col("x").alias("b")), "id")
    got = got.toPandas().sort_values("id")
    assert (got["rn"].to_numpy() == want["rn"].to_numpy()).all() and set(got["size"]) == {n // 1000, n - n // 1000}
    for c in "fb":
        assert np.array_equal(got[c].to_numpy(), want[c].to_numpy(), equal_nan=True)


@pytest.mark.parametrize("cut", [16, 4])
def test_capped_rows_are_those_of_the_smallest_hashes(spark, monkeypatch, cut):
    monkeypatch.setattr(balance, "_CUT", cut)
    df = spark.range(3000).selectExpr("id", "id % 100 AS k")
    by_hash = [r["id"] for r in df.orderBy(F.xxhash64(F.lit(42), "id")).collect()]
    for n in (0, 1, 17, 1500, 2999, 3000, 5000):
        assert {r["id"] for r in balance.cap_rows(df, n, ["id"]).collect()} == set(by_hash[:n])
    assert balance.cap_rows(df, 45, ["k"]).count() == 45  # 30 rows of one hash, 15 of the next
    plan = balance.cap_rows(df, 500, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan


def _labelled_vectors(spark, n: int, k: int = 5):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (n, k)).astype(float)
    label = (x[:, 0] + x[:, 1] > 1).astype(float) + (x[:, 2] > 2)
    frame = pd.DataFrame(x, columns=[f"x{i}" for i in range(k)]).assign(
        symbol="a", ts=np.arange(n), label=label, target=x[:, 0] * x[:, -1]
    )
    columns = [f"x{i}" for i in range(k)]
    schema = ", ".join(f"{c} double" for c in columns) + ", symbol string, ts long, label double, target double"
    return models.assemble(spark.createDataFrame(frame, schema), columns, ["symbol", "ts", "label", "target"]), columns, x


@pytest.mark.parametrize("kind", ["boosted", "forest", "regressor"])
def test_walk_equals_a_score_of_every_step(spark, kind):
    df, columns, x = _labelled_vectors(spark, 300)
    make, y, output = {
        "boosted": (models.BoostedClassifier(4, 3, leaf_rows=2), "label", "probabilities"),
        "forest": (models.ForestClassifier(6, 5, column_share=0.5), "label", "probabilities"),
        "regressor": (models.BoostedRegressor(4, 4, gain=0.01), "target", "prediction"),
    }[kind]
    model = make.fit(df, y)
    rng = np.random.default_rng(4)
    k = len(columns)
    z = x[rng.permutation(len(x))]
    enters = rng.random(x.shape).argsort(axis=1).argsort(axis=1) + 1
    got = trees.walk(trees.read_trees(spark, model), x, z, enters)
    steps = [np.where(enters <= j, x, z) for j in range(k + 1)]
    flat = pd.DataFrame(np.concatenate(steps), columns=columns).assign(at=np.arange((k + 1) * len(x)))
    scored = model.predict(models.assemble(spark.createDataFrame(flat), columns, ["at"]))
    found = scored.select("at", output).toPandas().sort_values("at")[output].to_numpy()
    want = np.stack([np.atleast_1d(v) for v in found]).reshape(k + 1, len(x), -1)
    assert np.allclose(got, want.transpose(1, 0, 2), atol=1e-9)


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_shapley_values_of_few_rows(spark, n):
    df, columns, _ = _labelled_vectors(spark, 300)
    model = models.BoostedRegressor(3, 3).fit(df, "target")
    some = df.where(F.col("ts") < n)
    out = importance.shapley_values(model, model.predict(some), columns, keep=["prediction"]).collect()
    assert len(out) == n
    for r in out:
        assert r["value"][0] == pytest.approx(r["prediction"], abs=1e-9)
        assert sum(v[0] for v in r["phi"]) == pytest.approx(r["value"][0] - r["base"][0], abs=1e-9)
    if n == 1:
        assert out[0]["value"] == out[0]["base"]
    again = importance.shapley_values(model, some.repartition(3), columns).collect()
    assert {r["ts"]: r["phi"] for r in again} == {r["ts"]: r["phi"] for r in out}


def test_a_stack_is_explained_by_steps(spark):
    df, columns, _ = _labelled_vectors(spark, 60, 3)
    stack = models.StackedClassifier([lambda: models.ForestClassifier(3, 3)], folds=2).fit(df, "label")
    rows = importance.shapley_importance(stack, df, columns, permutations=1).collect()
    assert {r["feature"] for r in rows} == set(columns) and all(r["importance"] >= 0 for r in rows)


def test_growth_limits_reach_the_trees(spark):
    df, _, _ = _labelled_vectors(spark, 300)
    wide = models.ForestClassifier(3, 6).fit(df).model
    assert sum(t.numNodes for t in models.ForestClassifier(3, 6, leaf_rows=40).fit(df).model.trees) < sum(t.numNodes for t in wide.trees)
    assert all(t.numNodes == 1 for t in models.BoostedRegressor(2, 4, gain=1e6).fit(df, "target").model.trees)
