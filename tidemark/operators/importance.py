"""Model-based feature importance and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .balance import cap_rows
from .models import assemble
from .trees import has_trees, read_trees, shapley_walks

_PARTNERS = 1024  # expected rows per permutation group


def importance_table(spark, columns: Sequence[str], values: Sequence[float]) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def forest(task: str, label: str, trees: int = 100, depth: int = 10, seed: int = 42):
    cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return cls(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def forest_importance(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    task: str = "classification",
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Random-forest importances, most important first."""
    model = forest(task, label, trees, depth, seed).fit(assemble(df, columns, [label]))
    table = importance_table(df.sparkSession, columns, model.featureImportances.toArray())
    return table.orderBy(F.desc("importance"), "feature")


def top_features(scores: DataFrame, n: int, column: str = "importance") -> list[str]:
    rows = scores.orderBy(F.desc(column), "feature").limit(n).collect()
    return [r["feature"] for r in rows]


def _shuffled(df: DataFrame, key: Sequence[str], repeats: int, seed: int, rows: int) -> DataFrame:
    """Each row with the feature array of another row, per repeat.

    Rows fall into random groups by a seeded hash and take the values of their
    neighbour in a second hash order: a random permutation without a global
    sort, in groups of bounded size.
    """
    groups = max(rows // _PARTNERS, 1)
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    each = each.withColumn(
        "_g", F.pmod(F.xxhash64(F.lit(seed), "repeat", *key), F.lit(groups))
    )
    order = F.xxhash64(F.lit(seed + 1), "repeat", *key)
    w = Window.partitionBy("repeat", "_g").orderBy(order, *key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.coalesce(F.lag("_x").over(w), F.last("_x").over(whole))
    return each.withColumn("_z", other).drop("_g")


def permutation_importance(
    model,
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    key: Sequence[str] = ("symbol", "ts"),
    task: str = "classification",
    repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Mean and deviation of the score drop when one feature is shuffled.

    All (feature, repeat) variants are scored in one pass.  ``df`` has a
    ``features`` vector; ``model`` a ``predict`` adding ``prediction``.
    """
    base = df.select(*key, label, vector_to_array("features").alias("_x"))
    n = base.count()
    variants = _shuffled(base, key, repeats, seed, n).withColumn(
        "_f", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1)))
    )
    mixed = F.transform(
        "_x", lambda v, i: F.when(i == F.col("_f"), F.col("_z")[i]).otherwise(v)
    )
    scored = model.predict(
        variants.select(label, "repeat", "_f", array_to_vector(mixed).alias("features"))
    )
    y, p = F.col(label), F.col("prediction")
    if task == "classification":
        score = F.avg(F.when(y == p, 1.0).otherwise(0.0))
    else:
        score = 1 - F.avg((y - p) * (y - p)) / F.var_pop(y)
    scores = scored.groupBy("_f", "repeat").agg(score.alias("score"))
    whole = Window.partitionBy("repeat")
    plain = F.max(F.when(F.col("_f") == -1, F.col("score"))).over(whole)
    drops = scores.withColumn("drop", plain - F.col("score")).where("_f >= 0")
    names = F.array(*[F.lit(c) for c in columns])
    out = drops.groupBy(names[F.col("_f")].alias("feature")).agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std")
    )
    return out.orderBy(F.desc("importance"), "feature")


def _backgrounds(df: DataFrame, key: Sequence[str], number: int, seed: int, rows: int) -> DataFrame:
    """``number`` other rows' feature arrays, joined in one array ``_z``.

    They are the neighbours in a seeded hash order inside random groups of
    bounded size.  A table of fewer rows repeats a neighbour; a single row is its own.
    """
    groups = max(rows // _PARTNERS, 1)
    w = Window.partitionBy("_g").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)
    near = [F.lag("_x").over(w), F.lead("_x").over(w), F.col("_x")]
    others = [
        F.coalesce(F.lag("_x", i).over(w), F.lead("_x", i).over(w), *near) for i in range(1, number + 1)
    ]
    grouped = df.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(groups)))
    return grouped.withColumn("_z", F.concat(*others)).drop("_g")


def shapley_values(
    model,
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str] = ("symbol", "ts"),
    max_rows: int | None = None,
    permutations: int = 4,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Monte-Carlo Shapley values of every row, for models made of trees.

    Features enter in a random order, replacing those of a random background
    row; each step's change of the output belongs to the entering feature.
    Returns key and ``keep``, ``value`` (the model's output for the row), ``base``
    (its mean over the backgrounds) and ``phi``, an array of outputs per feature,
    whose sum over the features is ``value`` - ``base``.  All rows are explained;
    ``max_rows`` asks for a seeded sample of them.  An empty table gives an empty one.
    """
    k = len(columns)
    base = df.select(*key, *keep, vector_to_array("features").alias("_x"))
    if max_rows is not None:
        base = cap_rows(base, max_rows, key, seed)
    rows = _backgrounds(base, key, permutations, seed, base.count())
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed + 7), *key))
    ensemble = read_trees(df.sparkSession, model)
    outputs = ensemble.value.shape[1]
    out = shapley_walks(ensemble, rows, [*key, *keep], permutations, k)
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice("phi", i * outputs + 1, outputs)
    )
    return out.withColumn("phi", parts)


def shapley_importance(
    model,
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str] = ("symbol", "ts"),
    max_rows: int | None = None,
    permutations: int = 4,
    seed: int = 42,
    output: str = "probabilities",
) -> DataFrame:
    """Mean absolute Shapley value per feature, over rows and outputs.

    Models made of trees are walked in blocks of rows (:func:`shapley_values`).
    Any other model is scored at every step, each a row of its own.
    """
    names = F.array(*[F.lit(c) for c in columns])
    if has_trees(model):
        values = shapley_values(model, df, columns, key, max_rows, permutations, seed)
        phi = values.select(F.posexplode("phi").alias("_f", "_v")).select("_f", F.explode("_v").alias("phi"))
    else:
        phi = _scored_steps(model, df, columns, key, max_rows, permutations, seed, output)
    out = phi.groupBy(names[F.col("_f")].alias("feature")).agg(
        F.avg(F.abs("phi")).alias("importance")
    )
    return out.orderBy(F.desc("importance"), "feature")


def _scored_steps(
    model,
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    max_rows: int | None,
    permutations: int,
    seed: int,
    output: str,
) -> DataFrame:
    """``phi`` by key, feature number and output, from a score of every step."""
    k = len(columns)
    base = df.select(*key, vector_to_array("features").alias("_x"))
    if max_rows is not None:
        base = cap_rows(base, max_rows, key, seed)
    rows = _shuffled(base, key, permutations, seed, base.count())
    indices = F.sequence(F.lit(0), F.lit(k - 1))
    order = F.transform(
        F.array_sort(
            F.transform(
                indices,
                lambda f: F.struct(
                    F.xxhash64(F.lit(seed + 7), "repeat", *key, f).alias("h"), f.alias("f")
                ),
            )
        ),
        lambda s: s["f"],
    )
    steps = rows.withColumn("_o", order).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(k)))
    )
    entered = F.slice("_o", F.lit(1), F.col("_j"))
    mixed = F.transform(
        "_x",
        lambda v, i: F.when(F.array_contains(entered, i), v).otherwise(F.col("_z")[i]),
    )
    feature = F.when(F.col("_j") > 0, F.element_at("_o", F.greatest(F.col("_j"), F.lit(1))))
    scored = model.predict(
        steps.select(*key, "repeat", "_j", feature.alias("_f"), array_to_vector(mixed).alias("features"))
    )
    value = F.col(output) if output == "probabilities" else F.array(F.col(output))
    w = Window.partitionBy(*key, "repeat").orderBy("_j")
    moved = scored.select(*key, "repeat", "_j", "_f", value.alias("_v")).withColumn(
        "_d", F.zip_with("_v", F.lag("_v").over(w), lambda a, b: a - b)
    )
    effects = moved.where("_j > 0").select(*key, "_f", F.posexplode("_d").alias("_c", "_e"))
    return effects.groupBy(*key, "_f", "_c").agg(F.avg("_e").alias("phi"))


class _Predictor:
    """A bare spark.ml model with the ``predict`` the functions above use."""

    def __init__(self, model):
        self.model = model

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        if "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability"))
        return out


def importance_summary(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    task: str = "classification",
    repeats: int = 10,
    trees: int = 100,
    depth: int = 10,
    key: Sequence[str] = ("symbol", "ts"),
) -> DataFrame:
    """Tree and permutation importance with average-tie ranks."""
    data = assemble(df, columns, [*key, label])
    model = forest(task, label, trees, depth).fit(data)
    tree = importance_table(df.sparkSession, columns, model.featureImportances.toArray())
    perm = permutation_importance(_Predictor(model), data, columns, label, key, task, repeats)
    perm = perm.select("feature", F.col("importance").alias("permutation_importance"))
    both = tree.withColumnRenamed("importance", "tree_importance").join(perm, "feature", "full")
    ranked = stats.average_rank(both, "tree_importance", "tree_rank")
    ranked = stats.average_rank(ranked, "permutation_importance", "permutation_rank")
    mean = (F.col("tree_rank") + F.col("permutation_rank")) / 2.0
    return ranked.withColumn("mean_rank", mean).orderBy("mean_rank", "feature")


def select_combined(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    n: int = 50,
    task: str = "classification",
    corr: float = 0.9,
    variance: float = 0.01,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
) -> tuple[list[str], DataFrame]:
    """Variance filter, correlation filter, forest importance.

    Returns the chosen features and a report of counts per step.
    """
    flat = set(stats.low_variance(df, columns, variance))
    kept = [c for c in columns if c not in flat]
    twins = set(stats.highly_correlated(df, kept, corr))
    candidates = [c for c in kept if c not in twins]
    scores = forest_importance(df, candidates, label, task, trees, depth, seed)
    chosen = top_features(scores, n)
    report = df.sparkSession.createDataFrame(
        [
            ("initial", len(columns)),
            ("low_variance_removed", len(flat)),
            ("correlated_removed", len(twins)),
            ("selected", len(chosen)),
        ],
        "step string, features int",
    )
    return chosen, report


def feature_report(
    df: DataFrame, columns: Sequence[str], label: str, task: str = "classification", **forest_args
) -> dict[str, DataFrame]:
    """Importance, correlations, distributions, target correlation (for
    numeric targets), outliers."""
    importance = forest_importance(df, columns, label, task, **forest_args)
    report = {
        "importance": stats.cumulative_importance(importance),
        "correlations": stats.correlation_report(df, columns, 0.7),
        "distributions": stats.distributions(df, columns),
        "outliers": stats.outliers(df, columns, "iqr"),
    }
    numeric = task == "regression" or df.select(label).distinct().limit(11).count() > 10
    if numeric:
        report["target_correlations"] = stats.target_correlation(df, columns, label)
    return report
