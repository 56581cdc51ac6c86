"""Evaluation tables.

Inputs carry label and prediction columns; every metric is a partial
aggregation, reshaped on a table whose size depends on the number of classes
or bins, not on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fdiv, sign
from .ranges import running_sums

NEUTRAL = 1  # fixed value: 0 short, 1 neutral, 2 long
CLASS_NAMES = ("SHORT", "NEUTRAL", "LONG")


def decisions(df: DataFrame, probabilities: str, predicted_return: str | None = None) -> DataFrame:
    """K8: class of the highest probability, and that probability."""
    p = F.col(probabilities)
    best = F.array_max(p)
    columns = {
        "signal": (F.array_position(p, best) - 1).cast("int"),
        "confidence": best,
    }
    if predicted_return:
        columns["predicted_return"] = F.col(predicted_return)
    return df.withColumns(columns)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, and accuracy where neither side is neutral (else 0)."""
    y, p = F.col(label), F.col(prediction)
    hit = y == p
    moved = (y != NEUTRAL) & (p != NEUTRAL)
    return df.agg(
        (F.count_if(hit) / F.count(F.lit(1))).alias("accuracy"),
        F.coalesce(
            F.try_divide(F.count_if(moved & hit), F.count_if(moved)), F.lit(0.0)
        ).alias("directional_accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts and the share within each true class."""
    counts = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count")
    )
    row = Window.partitionBy("actual")
    return counts.withColumn("share", F.col("count") / F.sum("count").over(row))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class plus macro and
    weighted rows, all from the confusion counts."""
    c = confusion(df, label, prediction)
    sides = c.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("class"),
                    F.col("count").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted_n"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("count"))
                    .otherwise(0)
                    .alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("count").alias("predicted_n"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    totals = sides.groupBy("class").agg(
        F.sum("support").alias("support"),
        F.sum("predicted_n").alias("predicted_n"),
        F.sum("hits").alias("hits"),
    )
    zero = F.lit(0.0)
    per = totals.select(
        F.col("class").cast("string").alias("class"),
        F.coalesce(F.try_divide(F.col("hits"), F.col("predicted_n")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("hits"), F.col("support")), zero).alias("recall"),
        F.coalesce(
            F.try_divide(2 * F.col("hits"), F.col("predicted_n") + F.col("support")), zero
        ).alias("f1"),
        "support",
    )
    measures = ("precision", "recall", "f1")
    macro = per.agg(
        F.lit("macro").alias("class"),
        *[F.avg(m).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    weighted = per.agg(
        F.lit("weighted").alias("class"),
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return per.unionByName(macro).unionByName(weighted)


# ------------------------------------------------------------------------ ROC
def _score_counts(
    df: DataFrame, label: str, probabilities: str, classes: Sequence[int], bins: int | None
) -> DataFrame:
    """Positives and negatives per (class, score).  With ``bins`` scores are
    rounded down to a grid, which bounds the table."""
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("class"),
                    F.element_at(F.col(probabilities), k + 1).alias("score"),
                    (F.col(label) == k).cast("int").alias("pos"),
                )
                for k in classes
            ]
        )
    )
    long = df.select(each.alias("_e")).select("_e.*")
    if bins:
        long = long.withColumn("score", F.floor(F.col("score") * bins) / F.lit(float(bins)))
    return long.groupBy("class", "score").agg(
        F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")
    )


def roc_points(
    df: DataFrame,
    label: str = "label",
    probabilities: str = "probabilities",
    classes: Sequence[int] = (0, 1, 2),
    bins: int | None = None,
) -> DataFrame:
    """One-vs-rest curve points, one per distinct score (ties grouped).

    Cumulative counts run over ranges that follow the scores, so a class with very
    many distinct scores, however close together, is not sorted in one task.
    """
    counts = _score_counts(df, label, probabilities, classes, bins)
    out = running_sums(counts, ["class"], [F.desc("score")], ["pos", "neg"], label="curve")
    tp = F.col("pos__before") + F.col("pos")
    fp = F.col("neg__before") + F.col("neg")
    return out.select(
        "class",
        F.col("score").alias("threshold"),
        fdiv(fp, "neg__total").alias("fpr"),
        fdiv(tp, "pos__total").alias("tpr"),
        "pos",
        "neg",
        tp.alias("tp"),
        F.col("pos__total").alias("positives"),
        F.col("neg__total").alias("negatives"),
    )


def roc_auc(
    df: DataFrame,
    label: str = "label",
    probabilities: str = "probabilities",
    classes: Sequence[int] = (0, 1, 2),
    bins: int | None = None,
) -> DataFrame:
    """Area per class; each point adds a trapezoid from its own counts."""
    points = roc_points(df, label, probabilities, classes, bins)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    size = F.max(F.col("positives").cast("double") * F.col("negatives"))
    return points.groupBy("class").agg(
        fdiv(area, size).alias("auc"), F.max("positives").alias("support")
    )


def weighted_auc(auc: DataFrame) -> DataFrame:
    return auc.agg(
        (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("roc_auc")
    )


# ----------------------------------------------------------------- regression
def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Error, fit, direction and correlation in one pass, over the rows that know both."""
    df = df.where(F.col(prediction).isNotNull() & F.col(label).isNotNull())
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    n = F.count(e)
    mse = F.avg(e * e)
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    return df.agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - fdiv(F.sum(e * e), F.var_pop(y) * n)).alias("r2"),
        F.avg(F.when(sign(y) == sign(p), 1.0).otherwise(0.0)).alias("directional_accuracy"),
        fdiv(F.covar_pop(y, p), spread).alias("correlation"),
        n.alias("n"),
    )


def forecast_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Regression metrics over the rows that have a forecast."""
    known = df.where(F.col(prediction).isNotNull() & F.col(label).isNotNull())
    return regression_metrics(known, label, prediction).select(
        "mse", "rmse", "mae", "directional_accuracy", "n"
    )


def residual_histogram(
    df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 50
) -> DataFrame:
    """Residual counts over equal bins from the smallest to the largest."""
    residual = (F.col(label) - F.col(prediction)).cast("double")
    rows = df.select(residual.alias("residual")).dropna()
    lo, hi = rows.agg(F.min("residual"), F.max("residual")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    width = (hi - lo) / bins or 1.0
    at = F.floor((F.col("residual") - F.lit(lo)) / F.lit(width)).cast("int")
    binned = rows.groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(binned, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def compare_models(metrics: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Models ordered by one metric."""
    known = metrics.where(F.col(metric).isNotNull())
    return known.select("model", metric).orderBy(F.desc(metric), "model")

