"""Stores, artifacts and the end-to-end job."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scaling, splits, targets
from tidemark.operators.models import ForestClassifier, assemble
from tidemark.plans.derived import Feeds
from tidemark.plans.pipeline import run_all
from tidemark.session import stored
from tidemark.sources import artifacts
from tidemark.sources.store import FeatureStore, as_map


@pytest.fixture(scope="module")
def bars(spark):
    return stored(Feeds.read(spark, "/root/testdata/sf0.001").ohlcv(), "bars")


def test_store_upsert_is_idempotent(spark, bars, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    rows = as_map(bars, ["close"]).withColumn("write_seq", F.lit(1).cast("bigint"))
    store.save(rows)
    store.save(rows)
    assert store.read().count() == bars.count()
    older = rows.withColumns(
        {"write_seq": F.lit(0).cast("bigint"), "features": F.create_map(F.lit("close"), F.lit(-1.0))}
    )
    store.save(older)
    assert store.read().where(F.col("features")["close"] < 0).count() == 0
    total = store.info().agg(F.sum("keys")).first()[0]
    assert total == bars.count()
    gone = store.delete("S0")
    assert gone == bars.where("symbol = 'S0'").count() > 0
    assert store.latest("S0").count() == 0 and store.latest("S1").count() == 1
    assert store.delete("S0") == 0
    meta = spark.createDataFrame([("close", "double", True)], "feature string, type string, selected boolean")
    store.save_metadata("v1", meta)
    assert store.metadata("v1").first()["feature"] == "close"


def test_datasets_round_trip(spark, bars, tmp_path):
    path = str(tmp_path)
    df = splits.ratio_split(targets.classification_target(bars, 4, 0.5))
    artifacts.export_datasets(df, path, "abc", ["close", "volume"], created_at="2024-01-01", tags={"a": "b"})
    artifacts.export_datasets(df, path, "xyz", ["close"], created_at="2024-02-01")
    loaded = artifacts.load_datasets(spark, path, "abc")
    assert loaded.count() == df.count()
    train = artifacts.load_datasets(spark, path, "abc", "train")
    assert train.count() == df.where("split = 'train'").count()
    assert [r[0] for r in artifacts.list_datasets(spark, path).collect()] == ["xyz", "abc"]


def test_feature_sets_round_trip(spark, tmp_path):
    path = str(tmp_path)
    one = artifacts.feature_set_record(spark, ["b", "a"], '{"w":1}', "2024-01-01")
    two = artifacts.feature_set_record(spark, ["c"], None, "2024-02-01")
    id1, id2 = (artifacts.save_feature_set(r, path) for r in (one, two))
    again = artifacts.feature_set_record(spark, ["a", "b"], '{"w":1}').first()["feature_set_id"]
    assert id1 == again != id2 and len(id1) == 12
    assert artifacts.load_feature_set(spark, path, id1).first()["features"] == ["a", "b"]
    listed = artifacts.list_feature_sets(spark, path).collect()
    assert [r["feature_set_id"] for r in listed] == [id2, id1]


def test_scaler_fits_on_train_only(bars, spark, tmp_path):
    df = splits.ratio_split(bars)
    out, scaler = scaling.scale_splits(df, ["close", "volume"])
    stats = out.where("split = 'train'").agg(F.avg("close"), F.stddev_pop("close")).first()
    assert abs(stats[0]) < 1e-9 and abs(stats[1] - 1) < 1e-9
    scaling.save_scaler(scaler, str(tmp_path / "z"))
    assert scaling.load_scaler(spark, str(tmp_path / "z")).count() == 2


def test_splits_are_disjoint_and_ordered(bars):
    df = splits.ratio_split(bars)
    edges = df.groupBy("symbol", "split").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    e = {(r["symbol"], r["split"]): r for r in edges}
    for s in ("S0", "S1", "S2", "S3"):
        assert e[s, "train"]["b"] < e[s, "val"]["a"] and e[s, "val"]["b"] < e[s, "test"]["a"]
    with pytest.raises(ValueError):
        splits.ratio_split(bars, 0.6, 0.6, 0.2)


def test_horizon_longer_than_series_is_empty(bars):
    assert targets.classification_target(bars, 10_000).count() == 0


def test_forest_probabilities(bars):
    df = targets.classification_target(bars, 4, 0.5).withColumn("label", F.col("target").cast("double"))
    rows = assemble(df, ["close", "volume"], ["label"])
    out = ForestClassifier(trees=5, max_depth=3).fit(rows).predict(rows)
    sums = out.select(F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_end_to_end(spark, tmp_path):
    f = Feeds.read(spark, "/root/testdata/sf0.001")
    feeds = {"ohlcv": f.ohlcv(), "open_interest": f.open_interest(), "ls_ratio": f.ls_ratio()}
    result = run_all(
        feeds,
        str(tmp_path),
        horizon=4,
        threshold=0.5,
        n_features=8,
        trees=5,
        classifiers={"forest": lambda: ForestClassifier(trees=5, max_depth=3)},
        regressor=None,
        stack_folds=2,
    )
    assert {r["model"] for r in result.scores.collect()} == {"forest", "stacked"}
    assert artifacts.list_datasets(spark, str(tmp_path)).count() == 1
    assert spark.read.parquet(f"{tmp_path}/selection_report").count() == 4
