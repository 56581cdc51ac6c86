"""Feature statistics and model-free selection.

Every report is one aggregation pass over the table, reshaped from one wide
row to one row per feature on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fdiv
from ..session import stored
from .quantiles import exact_quantiles
from .ranges import look_up, running_sums


def per_feature(
    df: DataFrame,
    columns: Sequence[str],
    aggregates: dict[str, Callable[[str], str]],
    derived: dict[str, Column] | None = None,
) -> DataFrame:
    """Long table ``(feature, <aggregate>...)`` from SQL aggregate templates."""
    wide = df.agg(
        *[F.expr(f"{make(c)} AS `{c}__{a}`") for c in columns for a, make in aggregates.items()]
    )
    lines = ", ".join(
        "named_struct('feature', '{c}', {parts})".format(
            c=c, parts=", ".join(f"'{a}', `{c}__{a}`" for a in aggregates)
        )
        for c in columns
    )
    long = wide.selectExpr(f"inline(array({lines}))")
    return long.withColumns(derived) if derived else long


# ------------------------------------------------------------------ variance
def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_feature(df, columns, {"variance": lambda c: f"var_samp(CAST(`{c}` AS DOUBLE))"})


def low_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    """M1: features whose sample variance is below the threshold."""
    rows = variances(df, columns).where(F.coalesce("variance", F.lit(0.0)) < threshold).collect()
    return [r["feature"] for r in rows]


# --------------------------------------------------------------- correlation
#: Columns up to which all pairs are multiplied at once; pairs that are multiplied together beyond.
AT_ONCE, TOGETHER = 512, 128


def _pair_moments(rows: DataFrame, shift: Sequence[float], left: Sequence[int], right: Sequence[int]) -> DataFrame:
    """``pair, r``: Pearson correlation of the elements ``left`` and ``right`` of the arrays ``x``, where both are known.

    Each task multiplies matrices of its rows (values, squares and which are known),
    shifted by ``shift`` against cancellation, and sends one row a pair; the sums are
    added by Spark.
    """
    k, left, right, shift = len(shift), np.asarray(left), np.asarray(right), np.asarray(shift, dtype=float)
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(left)))
        for batch in batches:
            cells = batch.column("x").flatten()
            raw = cells.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, k)
            known = cells.is_valid().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, k)
            v = np.where(known > 0, raw - shift, 0.0)
            square = v * v
            of = ((known, known), (v, known), (known, v), (square, known), (known, square), (v, v))
            if k <= AT_ONCE:
                total += [(a.T @ b)[left, right] for a, b in of]
            else:
                for at in range(0, len(left), TOGETHER):
                    some = slice(at, at + TOGETHER)
                    total[:, some] += [np.einsum("ij,ij->j", a[:, left[some]], b[:, right[some]]) for a, b in of]
        pair = pa.array(np.arange(len(left), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pair, *(pa.array(t) for t in total)], ["pair", *names])

    schema = "pair int, " + ", ".join(f"{n} double" for n in names)
    sums = rows.select("x").mapInArrow(multiply, schema).groupBy("pair").agg(*[F.sum(n).alias(n) for n in names])
    cov = F.expr("sxy - sx * sy / n")
    spread = F.expr("greatest(sxx - sx * sx / n, 0D) * greatest(syy - sy * sy / n, 0D)")
    # what rounding leaves of a constant column is no spread
    flat = F.expr("sxx - sx * sx / n <= 1e-13 * sxx OR syy - sy * sy / n <= 1e-13 * syy")
    return sums.select("pair", F.when((F.col("n") > 1) & ~flat, cov / F.sqrt(spread)).alias("r"))


def _all_pairs(k: int) -> tuple[list[int], list[int]]:
    return tuple(x.tolist() for x in np.triu_indices(k, 1))


def _long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``_row, c, x``: the known values of each column, -0.0 as 0.0."""
    cells = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])
    return rows.select("_row", F.posexplode(cells).alias("c", "x")).where(F.col("x").isNotNull())


def _known_sets(rows: DataFrame, columns: Sequence[str]) -> list[int]:
    """For each column a number of the set of rows that know it: equal numbers, equal sets."""
    k = len(columns)
    pairs = list(zip(*_all_pairs(k)))
    known = [F.col(c).isNotNull() for c in columns]
    counts = rows.agg(
        *[F.count_if(x).alias(f"n{i}") for i, x in enumerate(known)], *[F.count_if(known[i] & known[j]).alias(f"b{i}_{j}") for i, j in pairs]
    ).first()
    out = list(range(k))
    for i, j in pairs:
        if out[j] == j and counts[f"b{i}_{j}"] == counts[f"n{i}"] == counts[f"n{j}"]:
            out[j] = out[i]
    return out


def _spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``pair, r``: correlation of the ranks of both columns among the rows that know both.

    One plan for all pairs.  A column has a rank for each set of rows that its
    partners know (columns known in the same rows share one): its *variants*.  Values
    are counted per variant, ranked by running sums over these counts, and looked up
    for the rows; an array of a row's ranks then goes through the moments.
    """
    rows = stored(df.select(*columns, F.monotonically_increasing_id().alias("_row")), "rank-rows")
    sets = _known_sets(rows, columns)
    left, right = _all_pairs(len(columns))
    # a variant is (column, set of the partner); with its own set it is the rank among all rows that know it
    variants = sorted({(i, sets[j]) for i, j in zip([*left, *right], [*right, *left])})
    place = {v: n for n, v in enumerate(variants)}
    of = F.array(*[F.array(*[F.lit(place[i, s]) for s in sorted(set(sets)) if (i, s) in place]).cast("array<int>") for i in range(len(columns))])
    partner = F.array(*[F.lit(s) for _, s in variants])
    seen = F.array(*[F.col(c).isNotNull() for c in columns])
    long = _long(rows, columns).join(rows.select("_row", seen.alias("seen")), "_row")
    long = long.select("_row", "x", "seen", F.explode(F.get(of, F.col("c"))).alias("v"))
    long = stored(long.where(F.get("seen", F.get(partner, F.col("v")))).select("_row", "v", "x"), "rank-values")
    counts = long.groupBy("v", "x").agg(F.count("*").alias("n"))
    placed = running_sums(counts, ["v"], [F.col("x")], ["n"], label="ranks")
    ranks = stored(placed.select("v", "x", "n", "n__total", (F.col("n__before") + (F.col("n") + 1) / 2).alias("rank")), "ranks")
    ranked = look_up(long, ranks, ["v", "x"], "rank", "n", long.count())
    sizes = {r["v"]: r["n"] for r in ranks.groupBy("v").agg(F.first("n__total").alias("n")).collect()}
    each = ranked.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("v", "rank"))).alias("m"))
    x = each.select(F.transform(F.sequence(F.lit(0), F.lit(len(variants) - 1)), lambda v: F.element_at("m", v)).alias("x"))
    middle = [(sizes.get(n, 0) + 1) / 2 for n in range(len(variants))]
    return _pair_moments(x, middle, [place[i, sets[j]] for i, j in zip(left, right)], [place[j, sets[i]] for i, j in zip(left, right)])


def _pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return _pair_moments(rows, [0.0 if m is None else m for m in means], *_all_pairs(len(columns)))


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], method: str = "pearson"
) -> DataFrame:
    """All (i < j) pairs with their correlation over the rows that know both values; null where one does not vary."""
    make = {"pearson": _pearson, "spearman": _spearman, "kendall": _kendall}
    if method not in make:
        raise ValueError(f"unknown correlation method {method!r}")
    schema = "pair int, i int, j int, feature_1 string, feature_2 string"
    named = [(n, i, j, columns[i], columns[j]) for n, (i, j) in enumerate(zip(*_all_pairs(len(columns))))]
    pairs = df.sparkSession.createDataFrame(named, schema)
    if not named:
        return pairs.select("i", "j", "feature_1", "feature_2", F.lit(None).cast("double").alias("correlation"))
    found = make[method](df, list(columns))
    return pairs.join(found, "pair", "left").select("i", "j", "feature_1", "feature_2", F.col("r").alias("correlation"))


def correlation_report(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.7, method: str = "pearson"
) -> DataFrame:
    """M3: pairs with |correlation| >= threshold, strongest first."""
    strength = F.abs("correlation")
    pairs = correlation_pairs(df, columns, method).where(strength >= threshold)
    pairs = pairs.select("feature_1", "feature_2", strength.alias("correlation"))
    return pairs.orderBy(F.desc("correlation"), "feature_1", "feature_2")


def highly_correlated(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.9, method: str = "pearson"
) -> list[str]:
    """M2: features correlated above the threshold with any earlier one."""
    pairs = correlation_pairs(df, columns, method).where(F.abs("correlation") > threshold)
    found = {r["feature_2"] for r in pairs.select("feature_2").distinct().collect()}
    return [c for c in columns if c in found]


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """M4: Pearson correlation with the target, strongest first.

    Built from moments, because ``corr`` raises on a constant column.
    """
    known = f"CASE WHEN `{{c}}` IS NOT NULL AND `{target}` IS NOT NULL THEN {{x}} END"
    x = lambda c: f"CAST({known.format(c=c, x=f'`{c}`')} AS DOUBLE)"
    y = lambda c: f"CAST({known.format(c=c, x=f'`{target}`')} AS DOUBLE)"
    stats = per_feature(
        df,
        columns,
        {
            "_cov": lambda c: f"covar_pop({x(c)}, {y(c)})",
            "_sx": lambda c: f"stddev_pop({x(c)})",
            "_sy": lambda c: f"stddev_pop({y(c)})",
        },
    )
    value = fdiv("_cov", F.col("_sx") * F.col("_sy"))
    out = stats.select("feature", value.alias("correlation"), F.abs(value).alias("abs_correlation"))
    return out.orderBy(F.desc_nulls_last("abs_correlation"), "feature")


def _kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M5, ``pair, r``: exact Kendall tau-b of every column pair, in one plan, by counting inversions bit by bit.

    Values become their places among the distinct ones of their column.  Two rows
    ordered by the first column are discordant when the first bit in which their
    places in the second differ is set in the earlier one: per bit, a running count
    inside the group of equal higher bits.  Cells of (pair, place, place) are
    counted first and all sums run over ranges of places, so that ties and skew
    stay distributed; rows are never paired.
    """
    rows = stored(df.select(*columns, F.monotonically_increasing_id().alias("_row")), "kendall-rows")
    long = stored(_long(rows, columns), "kendall-values")
    values = long.groupBy("c", "x").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    places = stored(running_sums(values, ["c"], [F.col("x")], ["one"], label="places").withColumnRenamed("one__before", "place"), "places")
    levels = max(int(places.agg(F.max("place")).first()[0] or 0).bit_length(), 1)
    placed = look_up(long, places, ["c", "x"], "place", "n", long.count())
    each = placed.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("c", "place"))).alias("m"))
    left, right = _all_pairs(len(columns))
    pairs = F.array(*[F.struct(F.lit(n).alias("pair"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, (i, j) in enumerate(zip(left, right))])
    met = each.select("m", F.explode(pairs).alias("p"))
    met = met.select("p.pair", F.element_at("m", F.col("p.i")).alias("x"), F.element_at("m", F.col("p.j")).alias("y"))
    cells = stored(met.where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count("*").alias("c")), "kendall-cells")

    bits = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    one = F.expr("CAST(shiftright(y, level) & 1 AS BIGINT)")
    merged = bits.groupBy("pair", "level", F.expr("shiftright(y, level + 1)").alias("g"), "x").agg(
        F.sum(F.col("c") * one).alias("set_"), F.sum(F.col("c") * (1 - one)).alias("clear_")
    )
    # a group without both kinds of bits has no inversion
    ahead = running_sums(merged, ["pair", "level", "g"], [F.col("x")], ["set_"], label="inversions")
    number = "decimal(38,0)"
    choose2 = lambda c: (F.col(c).cast("decimal(19,0)") * (F.col(c) - 1) / 2).cast(number)
    parts = [ahead.select("pair", F.lit("dis").alias("k"), (F.col("set___before") * F.col("clear_")).cast(number).alias("d"))]
    for name, by in (("tx", ["x"]), ("ty", ["y"]), ("txy", ["x", "y"]), ("all", [])):
        tied = cells.groupBy("pair", *by).agg(F.sum("c").alias("c"))
        parts.append(tied.select("pair", F.lit(name).alias("k"), choose2("c").alias("d")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("pair").agg(
        *[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("d"))), F.lit(0)).cast("double").alias(k) for k in ("dis", "tx", "ty", "txy", "all")]
    )
    concordant = F.col("all") - F.col("tx") - F.col("ty") + F.col("txy") - F.col("dis")
    scale = F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))
    return sums.select("pair", fdiv(concordant - F.col("dis"), scale).alias("r"))


def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """``tau``: Kendall tau-b of two columns, over the rows that know both."""
    return correlation_pairs(df, [a, b], "kendall").select(F.col("correlation").alias("tau"))


# -------------------------------------------------------------- distributions
def distributions(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """M6: moments, median, zero and missing shares per feature.

    Skewness and kurtosis are bias-corrected from the population moments.
    ``exact=False`` uses a bounded sketch for the median.
    """
    if exact:  # read twice
        df = stored(df.select(*columns), "distributions")
    median = "CAST(NULL AS DOUBLE)" if exact else "percentile_approx({c}, 0.5, 10000)"
    x = lambda c: f"CAST(`{c}` AS DOUBLE)"
    stats = per_feature(
        df,
        columns,
        {
            "_rows": lambda c: "count(1)",
            "_n": lambda c: f"count(`{c}`)",
            "mean": lambda c: f"avg({x(c)})",
            "std": lambda c: f"stddev_samp({x(c)})",
            "min": lambda c: f"min({x(c)})",
            "max": lambda c: f"max({x(c)})",
            "median": lambda c: median.format(c=x(c)),
            "_g1": lambda c: f"skewness({x(c)})",
            "_g2": lambda c: f"kurtosis({x(c)})",
            "_zero": lambda c: f"count_if(`{c}` = 0)",
        },
    )
    if exact:
        middle = exact_quantiles(df, columns, [0.5]).select("feature", F.col("q")[0.5].alias("median"))
        stats = stats.drop("median").join(middle, "feature", "left")
    n = F.col("_n").cast("double")
    flat = F.col("min") == F.col("max")
    skew = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * F.col("_g1")
    kurt = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    return stats.select(
        "feature",
        "mean",
        "std",
        "min",
        "max",
        "median",
        F.when(flat & (n > 2), F.lit(0.0)).otherwise(skew).alias("skew"),
        F.when(flat & (n > 3), F.lit(0.0)).otherwise(kurt).alias("kurtosis"),
        (F.col("_zero") * 100.0 / F.col("_rows")).alias("zeros_pct"),
        ((F.col("_rows") - F.col("_n")) * 100.0 / F.col("_rows")).alias("missing_pct"),
    )


def distribution_issues(stats: DataFrame) -> DataFrame:
    """M7: strongly skewed or often missing features."""
    flags = stats.select(
        "feature",
        F.coalesce(F.abs("skew") > 2, F.lit(False)).alias("high_skew"),
        (F.col("missing_pct") > 10).alias("high_missing"),
    )
    return flags.where("high_skew OR high_missing")


# ------------------------------------------------------------------- outliers
def outliers(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    threshold: float = 3.0,
    exact: bool = True,
) -> DataFrame:
    """M8/M9: values outside Q1-1.5 IQR .. Q3+1.5 IQR, or beyond ``threshold``
    deviations.  Two passes: bounds (two numbers per feature), then counts."""
    x = lambda c: f"CAST(`{c}` AS DOUBLE)"
    df = stored(df.select(*columns), "outliers")  # read twice
    if method == "iqr":
        pair = {
            "a": lambda c: f"percentile_approx({x(c)}, 0.25, 10000)",
            "b": lambda c: f"percentile_approx({x(c)}, 0.75, 10000)",
        }
    elif method == "zscore":
        pair = {"a": lambda c: f"avg({x(c)})", "b": lambda c: f"stddev_samp({x(c)})"}
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    if method == "iqr" and exact:
        quartiles = {r["feature"]: r["q"] for r in exact_quantiles(df, columns, [0.25, 0.75]).collect()}
        limits = {c: (quartiles[c][0.25], quartiles[c][0.75]) if c in quartiles else (None, None) for c in columns}
    else:
        limits = {r["feature"]: (r["a"], r["b"]) for r in per_feature(df, columns, pair).collect()}

    def outside(c: str) -> str:
        a, b = limits[c]
        if a is None or b is None:
            return "count_if(false)"
        if method == "iqr":
            low, high = a - 1.5 * (b - a), b + 1.5 * (b - a)
            return f"count_if({x(c)} < {low!r}D OR {x(c)} > {high!r}D)"
        if b == 0:
            return "count_if(false)"
        return f"count_if(abs(({x(c)} - {a!r}D) / {b!r}D) > {float(threshold)!r}D)"

    counts = per_feature(df, columns, {"outliers": outside, "_rows": lambda c: "count(1)"})
    share = F.col("outliers") * 100.0 / F.col("_rows")
    out = counts.select("feature", "outliers", share.alias("outlier_pct"))
    return out.orderBy(F.desc("outlier_pct"), "feature")


# ----------------------------------------------------------------- identities
def feature_set_hash(names: Column, config: Column | None = None) -> Column:
    """12 hex digits of the SHA-256 of the sorted names and the config."""
    text = F.array_join(F.array_sort(names), ",")
    if config is not None:
        text = F.when(config.isNotNull(), F.concat(text, F.lit("|"), config)).otherwise(text)
    return F.substring(F.sha2(text, 256), 1, 12)


def compare_sets(left: Column, right: Column) -> dict[str, Column]:
    """Common and exclusive names of two feature lists."""
    common = F.array_sort(F.array_intersect(left, right))
    only1 = F.array_sort(F.array_except(left, right))
    only2 = F.array_sort(F.array_except(right, left))
    return {
        "common_features": common,
        "only_in_1": only1,
        "only_in_2": only2,
        "n_features_1": F.size(left),
        "n_features_2": F.size(right),
        "n_common": F.size(common),
        "n_only_1": F.size(only1),
        "n_only_2": F.size(only2),
    }


def reduction(original: Column, selected: Column) -> dict[str, Column]:
    """U4: what a selection removed."""
    removed = F.array_sort(F.array_except(original, selected))
    return {
        "original_count": F.size(original),
        "selected_count": F.size(selected),
        "removed_count": F.size(removed),
        "reduction_pct": F.size(removed) * 100.0 / F.size(original),
        "removed_features": removed,
    }


def average_rank(scores: DataFrame, column: str, out: str) -> DataFrame:
    """Descending average-tie rank of a score table (one row per feature)."""
    order = Window.partitionBy().orderBy(F.desc_nulls_last(column))
    ties = F.count(F.lit(1)).over(Window.partitionBy(column))
    return scores.withColumn(out, F.rank().over(order) + (ties - 1) / 2.0)


def cumulative_importance(scores: DataFrame, column: str = "importance") -> DataFrame:
    """Importance with its running share, most important first."""
    order = Window.partitionBy().orderBy(F.desc(column), "feature")
    running = F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, 0))
    share = fdiv(running, F.sum(column).over(Window.partitionBy()))
    return scores.withColumn("cumulative", share)


def features_for_share(cumulative: DataFrame, shares: Sequence[float] = (0.8, 0.9, 0.95)) -> DataFrame:
    """Features needed to reach each share."""
    cols = [
        (F.count_if(F.col("cumulative") <= s) + 1).alias(f"n_{round(s * 100)}") for s in shares
    ]
    return cumulative.agg(*cols)
