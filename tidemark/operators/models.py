"""Signal and price models on spark.ml.

Every model adds ``prediction`` and, for classifiers, ``probabilities`` (array
by class) to a table with a ``features`` vector.  Fitting and scoring stay
distributed; the driver holds models and small result tables.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

CLASSES = (0, 1, 2)


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One ``features`` vector per row plus the ``keep`` columns."""
    typed = df.select(*keep, *[F.col(c).cast("double").alias(f"_f_{c}") for c in columns])
    vector = VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol="features")
    return vector.transform(typed).select(*keep, "features")


def _argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("double")


def _growth(model) -> dict:
    """Limits of a tree's growth: share of columns a node tries, rows of a leaf, least gain."""
    share = model.column_share
    strategy = "auto" if share is None else "all" if share >= 1 else str(share)
    return {
        "featureSubsetStrategy": strategy,
        "minInstancesPerNode": model.leaf_rows,
        "minInfoGain": model.gain,
    }


@dataclass
class BoostedClassifier:
    """K1/K2: one boosted binary model per class, probabilities normalised.

    With ``validation`` (a boolean column) boosting stops when the validation
    rows stop improving.
    """

    max_iter: int = 300
    max_depth: int = 6
    step: float = 0.05
    subsample: float = 0.8
    seed: int = 42
    column_share: float = 1.0
    leaf_rows: int = 1
    gain: float = 0.0
    validation: str | None = None
    models: list = field(default_factory=list)

    def fit(self, df: DataFrame, label: str = "label") -> "BoostedClassifier":
        def one(k: int):
            gbt = GBTClassifier(
                labelCol="_y",
                maxIter=self.max_iter,
                maxDepth=self.max_depth,
                stepSize=self.step,
                subsamplingRate=self.subsample,
                seed=self.seed,
                **_growth(self),
            )
            if self.validation:
                gbt = gbt.setValidationIndicatorCol(self.validation)
            return gbt.fit(df.withColumn("_y", (F.col(label) == k).cast("double")))

        with ThreadPoolExecutor(len(CLASSES)) as pool:
            self.models = list(pool.map(one, CLASSES))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        for k, m in enumerate(self.models):
            m = m.copy().setProbabilityCol(f"_p{k}").setRawPredictionCol("").setPredictionCol("")
            out = m.transform(out)
        raw = [vector_to_array(f"_p{k}")[1] for k in range(len(self.models))]
        total = reduce(lambda a, b: a + b, raw)
        probs = F.array(*[p / total for p in raw])
        out = out.withColumn("probabilities", probs).drop(*[f"_p{k}" for k in range(len(raw))])
        return out.withColumn("prediction", _argmax(F.col("probabilities")))

    def importance(self) -> list[float]:
        """K5: importances averaged over the class models."""
        arrays = [m.featureImportances.toArray() for m in self.models]
        return list(sum(arrays) / len(arrays))


@dataclass
class ForestClassifier:
    """K3: a random forest, for a different bias than the boosted models."""

    trees: int = 100
    max_depth: int = 6
    seed: int = 42
    column_share: float | None = None
    leaf_rows: int = 1
    gain: float = 0.0
    model: object = None

    def fit(self, df: DataFrame, label: str = "label") -> "ForestClassifier":
        forest = RandomForestClassifier(
            labelCol=label, numTrees=self.trees, maxDepth=self.max_depth, seed=self.seed, **_growth(self)
        )
        self.model = forest.fit(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df).drop("rawPrediction", "prediction")
        p = vector_to_array("probability")
        # a class absent from training gets probability 0
        padded = F.slice(F.concat(p, F.array(*[F.lit(0.0)] * len(CLASSES))), 1, len(CLASSES))
        out = out.withColumn("probabilities", padded).drop("probability")
        return out.withColumn("prediction", _argmax(F.col("probabilities")))

    def importance(self) -> list[float]:
        return list(self.model.featureImportances.toArray())


@dataclass
class BoostedRegressor:
    """K4."""

    max_iter: int = 300
    max_depth: int = 5
    step: float = 0.05
    subsample: float = 0.8
    seed: int = 42
    column_share: float = 1.0
    leaf_rows: int = 1
    gain: float = 0.0
    model: object = None

    def fit(self, df: DataFrame, label: str = "label") -> "BoostedRegressor":
        gbt = GBTRegressor(
            labelCol=label,
            maxIter=self.max_iter,
            maxDepth=self.max_depth,
            stepSize=self.step,
            subsamplingRate=self.subsample,
            seed=self.seed,
            **_growth(self),
        )
        self.model = gbt.fit(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def importance(self) -> list[float]:
        return list(self.model.featureImportances.toArray())


def _with_fold(df: DataFrame, key: Sequence[str], folds: int, seed: int) -> DataFrame:
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(folds)))


def _out_of_fold(
    df: DataFrame,
    bases: Sequence[Callable[[], object]],
    outputs: Callable[[DataFrame, int], DataFrame],
    label: str,
    folds: int,
) -> DataFrame:
    """Predictions of each base for rows it was not trained on."""
    parts = []
    for k in range(folds):
        train, held = df.where(F.col("_fold") != k), df.where(F.col("_fold") == k)
        for i, make in enumerate(bases):
            held = outputs(make().fit(train, label).predict(held), i)
        parts.append(held)
    return reduce(DataFrame.unionByName, parts)


@dataclass
class StackedClassifier:
    """K6: out-of-fold base probabilities feed a logistic regression."""

    bases: Sequence[Callable[[], object]]
    key: Sequence[str] = ("symbol", "ts")
    folds: int = 5
    seed: int = 42
    fitted: list = field(default_factory=list)
    meta: object = None

    @staticmethod
    def _keep(df: DataFrame, i: int) -> DataFrame:
        return df.withColumn(f"_b{i}", F.col("probabilities")).drop("probabilities", "prediction")

    def _stack(self, df: DataFrame) -> DataFrame:
        joined = F.concat(*[F.col(f"_b{i}") for i in range(len(self.bases))])
        return df.withColumn("_meta", array_to_vector(joined))

    def fit(self, df: DataFrame, label: str = "label") -> "StackedClassifier":
        folded = _with_fold(df, self.key, self.folds, self.seed)
        oof = _out_of_fold(folded, self.bases, self._keep, label, self.folds)
        lr = LogisticRegression(featuresCol="_meta", labelCol=label, maxIter=1000)
        self.meta = lr.fit(self._stack(oof))
        self.fitted = [make().fit(df, label) for make in self.bases]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.fitted):
            out = self._keep(m.predict(out), i)
        out = self.meta.transform(self._stack(out)).drop("rawPrediction", "_meta")
        out = out.withColumn("probabilities", vector_to_array("probability"))
        return out.drop("probability", *[f"_b{i}" for i in range(len(self.bases))])


@dataclass
class StackedRegressor:
    """K7: out-of-fold base predictions feed a ridge regression."""

    bases: Sequence[Callable[[], object]]
    key: Sequence[str] = ("symbol", "ts")
    folds: int = 5
    alpha: float = 1.0
    seed: int = 42
    fitted: list = field(default_factory=list)
    meta: object = None

    @staticmethod
    def _keep(df: DataFrame, i: int) -> DataFrame:
        return df.withColumnRenamed("prediction", f"_b{i}")

    def _stack(self, df: DataFrame) -> DataFrame:
        columns = [f"_b{i}" for i in range(len(self.bases))]
        return VectorAssembler(inputCols=columns, outputCol="_meta").transform(df)

    def fit(self, df: DataFrame, label: str = "label") -> "StackedRegressor":
        folded = _with_fold(df, self.key, self.folds, self.seed)
        oof = self._stack(_out_of_fold(folded, self.bases, self._keep, label, self.folds))
        n = max(df.count(), 1)
        ridge = LinearRegression(
            featuresCol="_meta",
            labelCol=label,
            elasticNetParam=0.0,
            regParam=self.alpha / n,
            standardization=False,
        )
        self.meta = ridge.fit(oof)
        self.fitted = [make().fit(df, label) for make in self.bases]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.fitted):
            out = self._keep(m.predict(out), i)
        out = self.meta.transform(self._stack(out)).drop("_meta")
        return out.drop(*[f"_b{i}" for i in range(len(self.bases))])


# ---------------------------------------------------------------- validation
def walk_forward(
    make: Callable[[], object],
    folds: DataFrame,
    label: str = "label",
    task: str = "classification",
) -> DataFrame:
    """K9: fit and test per fold of a ``(fold, role, features, label)`` table.

    The loop runs over the k folds; each fit and score is a Spark job.
    """
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    rows = []
    for k in numbers:
        part = folds.where(F.col("fold") == k)
        model = make().fit(part.where("role = 'train'"), label)
        scored = model.predict(part.where("role = 'test'"))
        score = metrics.accuracy if task == "classification" else metrics.regression_metrics
        rows.append(score(scored, label, "prediction").withColumn("fold", F.lit(k)))
    return reduce(DataFrame.unionByName, rows)


def fold_summary(results: DataFrame) -> DataFrame:
    """Mean and deviation of every metric over the folds."""
    names = [c for c in results.columns if c not in ("fold", "n")]
    return results.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in names],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in names],
    )


# -------------------------------------------------------------------- search
Space = dict[str, tuple]

# Search ranges (low, high[, "log"]); integers stay integers.
CLASSIFIER_SPACE: Space = {
    "max_iter": (100, 500),
    "max_depth": (3, 10),
    "step": (0.01, 0.3, "log"),
    "subsample": (0.6, 1.0),
    "column_share": (0.6, 1.0),
    "leaf_rows": (1, 10),
    "gain": (0.0, 0.5),
}
FOREST_SPACE: Space = {
    "trees": (100, 500),
    "max_depth": (3, 10),
    "column_share": (0.6, 1.0),
    "leaf_rows": (5, 50),
}


def draw(space: Space, rng: random.Random) -> dict:
    """One seeded draw per parameter."""
    out = {}
    for name, (low, high, *kind) in space.items():
        if kind:
            out[name] = low * (high / low) ** rng.random()
        elif isinstance(low, int):
            out[name] = rng.randint(low, high)
        else:
            out[name] = rng.uniform(low, high)
    return out


def search(
    make: Callable[..., object],
    space: Space,
    train: DataFrame,
    val: DataFrame,
    label: str = "label",
    task: str = "classification",
    trials: int = 50,
    seed: int = 42,
    parallel: int = 2,
    accuracy_only: bool = False,
) -> DataFrame:
    """Seeded random search, best first.

    Classifiers score 0.7 accuracy + 0.3 directional accuracy (or accuracy
    alone), regressors directional accuracy - 10 mse.
    """
    rng = random.Random(seed)
    draws = [draw(space, rng) for _ in range(trials)]

    def run(params: dict) -> float:
        scored = make(**params).fit(train, label).predict(val)
        if task == "classification":
            m = metrics.accuracy(scored, label, "prediction").first()
            acc = m["accuracy"] or 0.0
            return acc if accuracy_only else 0.7 * acc + 0.3 * m["directional_accuracy"]
        m = metrics.regression_metrics(scored, label, "prediction").first()
        return m["directional_accuracy"] - 10 * m["mse"]

    with ThreadPoolExecutor(parallel) as pool:
        scores = list(pool.map(run, draws))
    rows = [
        (i, float(s), {k: float(v) for k, v in d.items()})
        for i, (s, d) in enumerate(zip(scores, draws))
    ]
    table = train.sparkSession.createDataFrame(
        rows, "trial int, score double, params map<string,double>"
    )
    return table.orderBy(F.desc("score"), "trial")


def search_all(
    train: DataFrame,
    val: DataFrame,
    label: str,
    target: str,
    trials: int = 20,
    seed: int = 42,
    spaces: dict[str, Space] | None = None,
) -> DataFrame:
    """Every model family; best trial of each.  ``spaces`` replaces ranges by family."""
    spaces = spaces or {}
    jobs = {
        "boosted_classifier": (BoostedClassifier, CLASSIFIER_SPACE, label, "classification"),
        "forest_classifier": (ForestClassifier, FOREST_SPACE, label, "classification"),
        "boosted_regressor": (BoostedRegressor, CLASSIFIER_SPACE, target, "regression"),
    }
    best = []
    for name, (make, space, y, task) in jobs.items():
        found = search(make, spaces.get(name, space), train, val, y, task, trials, seed)
        best.append(found.limit(1).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, best)
