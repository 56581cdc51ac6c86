"""Training and end-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import importance, metrics, scaling, splits, targets
from ..operators.features import feature_names
from ..operators.models import (
    BoostedClassifier,
    BoostedRegressor,
    ForestClassifier,
    StackedClassifier,
    StackedRegressor,
    assemble,
)
from ..operators.prefix import DEFAULT, Series
from ..session import stored
from ..sources.artifacts import export_datasets, feature_set_record, save_feature_set
from ..sources.artifacts import save_comparison
from ..sources.model_store import save_trained
from .feature_table import engineer_all


@dataclass
class TrainingResult:
    models: dict[str, object]
    scores: DataFrame
    importance: DataFrame
    scaler: DataFrame
    predictions: dict[str, DataFrame] = field(default_factory=dict)
    regression: DataFrame | None = None
    explanation: DataFrame | None = None


def default_classifiers() -> dict[str, Callable[[], object]]:
    return {
        "boosted": BoostedClassifier,
        "boosted_early": lambda: BoostedClassifier(500, 5, validation="is_val"),
        "forest": ForestClassifier,
    }


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str = "target",
    target: str = "target_return",
    classifiers: dict[str, Callable[[], object]] | None = None,
    regressor: Callable[[], object] | None = BoostedRegressor,
    stack: bool = True,
    stack_folds: int = 5,
    method: str = "standard",
    explain: bool = True,
    permutations: int = 4,
) -> TrainingResult:
    """Scale on train, fit and stack classifiers and regressors, evaluate on test, rank
    features, explain the first classifier's test predictions by mean absolute Shapley values.

    ``df`` carries ``split``.  The scaled and assembled rows are stored once
    and read by every fit.
    """
    classifiers = default_classifiers() if classifiers is None else classifiers
    scaled, scaler = scaling.scale_splits(df, features, method)
    keep = ["symbol", "ts", "split", label, target]
    rows = assemble(scaled, features, keep).withColumn("is_val", F.col("split") == "val")
    rows = stored(rows.withColumn(label, F.col(label).cast("double")), "assembled")
    fit_rows = rows.where("split = 'train'")
    with_val = rows.where("split IN ('train', 'val')")
    test = rows.where("split = 'test'")

    models: dict[str, object] = {}
    for name, make in classifiers.items():
        model = make()
        uses_val = getattr(model, "validation", None)
        models[name] = model.fit(with_val if uses_val else fit_rows, label)
    if stack:
        # bases without early stopping: a fold has no validation rows
        bases = [m for n, m in classifiers.items() if not getattr(m(), "validation", None)]
        models["stacked"] = StackedClassifier(bases, folds=stack_folds).fit(fit_rows, label)

    predictions = {name: m.predict(test) for name, m in models.items()}
    score = [
        metrics.accuracy(p, label, "prediction").withColumn("model", F.lit(n))
        for n, p in predictions.items()
    ]
    scores = reduce(DataFrame.unionByName, score)
    regression = None
    if regressor is not None:
        regressors = {"regressor": regressor().fit(fit_rows, target)}
        if stack:
            regressors["stacked_regressor"] = StackedRegressor([regressor], folds=stack_folds).fit(fit_rows, target)
        forecasts = {name: m.predict(test) for name, m in regressors.items()}
        models |= regressors
        predictions |= forecasts
        fit = [
            metrics.regression_metrics(p, target, "prediction").withColumn("model", F.lit(n))
            for n, p in forecasts.items()
        ]
        regression = reduce(DataFrame.unionByName, fit)
    first = next(iter(classifiers))
    ranking = importance.importance_table(df.sparkSession, features, models[first].importance())
    explanation = None
    if explain:
        explanation = importance.shapley_importance(models[first], test, features, permutations=permutations)
    ranking = ranking.orderBy(F.desc("importance"))
    return TrainingResult(models, scores, ranking, scaler, predictions, regression, explanation)


def save_models(result: TrainingResult, path: str) -> None:
    """Every model whole (a stack with its bases) and the scaler table."""
    spark = result.scores.sparkSession
    for name, model in result.models.items():
        save_trained(spark, model, f"{path}/{name}")
    scaling.save_scaler(result.scaler, f"{path}/scaler")


def run_all(
    feeds: dict[str, DataFrame | None],
    path: str,
    horizon: int = 48,
    threshold: float = 0.005,
    n_features: int = 50,
    series: Series = DEFAULT,
    trees: int = 100,
    created_at: str = "",
    **train_args,
) -> TrainingResult:
    """Feeds to trained models, with every artifact saved under ``path``."""
    table = engineer_all(
        feeds["ohlcv"],
        feeds.get("open_interest"),
        feeds.get("funding"),
        feeds.get("liquidations"),
        feeds.get("ls_ratio"),
        series,
        fill_mode="causal",
        clean_inf=True,
    )
    names = feature_names(table)
    labelled = targets.classification_target(stored(table, "table"), horizon, threshold, 3, series)
    labelled = targets.with_return_target(labelled).dropna()
    split = stored(splits.ratio_split(labelled, series=series), "split")
    chosen, report = importance.select_combined(
        split.where("split = 'train'"), names, "target", n_features, trees=trees
    )
    spark = split.sparkSession
    record = feature_set_record(spark, chosen, created_at=created_at)
    set_id = save_feature_set(record, path)
    export_datasets(split, path, set_id, chosen, "target", created_at)
    report.write.mode("overwrite").parquet(f"{path}/selection_report")
    result = train(split, chosen, **train_args)
    save_models(result, f"{path}/models")
    save_comparison(result.scores, f"{path}/comparison")
    if result.explanation is not None:
        result.explanation.write.mode("overwrite").parquet(f"{path}/explanation")
    return result
