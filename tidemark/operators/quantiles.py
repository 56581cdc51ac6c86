"""Exact quantiles by radix selection.

Doubles become 64-bit integers in the same order, and the value of a rank is found
some bits at a time: among the values that begin with the bits found so far, counts
by the next 16 bits tell which of them the rank falls on.  As soon as no more than
65 536 values are left to any rank, all their other bits are told apart at once.
So every rank is found exactly in four passes at most, whatever the values are,
and at most 65 536 counts a rank and pass are summed.  Tasks count all columns of
their rows with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_stored, stored

#: Bits of a pass; counts of a rank and pass are at most two to the power of these.
DIGIT = 16
_MOST = np.int64(2**63 - 1)


def ordered(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; -0.0 is 0.0."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _MOST, bits)


def doubles(keys: np.ndarray) -> np.ndarray:
    """The doubles of these integers."""
    return np.where(keys < 0, keys ^ _MOST, keys).view(np.float64)


def _digits(rows: DataFrame, features: int, asks: int, done: int, width: int, known: dict | None) -> DataFrame:
    """``g, f, ask, digit, n``: counts by the next ``width`` bits of the values that begin as ``prefix`` says.

    In the first pass all values count, for ask 0.  ``known`` holds the prefixes of
    the only group; else the rows carry those of their group.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, local = np.unique(batch.column("g").to_numpy(), return_inverse=True)
            cells = batch.column("x").flatten()
            shape = batch.num_rows, features
            there = cells.is_valid().to_numpy(zero_copy_only=False).reshape(shape)
            values = cells.to_numpy(zero_copy_only=False).astype(float).reshape(shape)
            if done and known is None:
                lists = batch.column("prefix").flatten()
                told = lists.is_valid().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                prefix = lists.fill_null(0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = []
            for f in range(features):
                some = np.flatnonzero(there[:, f])
                keys = ordered(np.ascontiguousarray(values[some, f]))
                for ask in range(asks if done else 1):
                    at = np.arange(len(some))
                    if done:
                        if known is None:
                            wanted, valid = prefix[some, f * asks + ask], told[some, f * asks + ask]
                        else:
                            wanted, valid = known.get((f, ask), 0), (f, ask) in known
                        at = np.flatnonzero((keys >> (64 - done) == wanted) & valid)
                    digit = keys[at] >> (64 - done - width)
                    if done:
                        digit &= (1 << width) - 1
                    own = local[some[at]]
                    order = np.lexsort((digit, own))
                    digit, own = digit[order], own[order]
                    new = np.flatnonzero(np.append(True, (np.diff(digit) != 0) | (np.diff(own) != 0))[: len(own)])
                    n = np.diff(np.append(new, len(own)))
                    out.append((groups[own[new]], np.full(len(new), f), np.full(len(new), ask), digit[new], n))
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, ["g", "f", "ask", "digit", "n"])

    found = rows.mapInArrow(count, "g long, f long, ask long, digit long, n long")
    return found.groupBy("g", "f", "ask", "digit").agg(F.sum("n").alias("n"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """``by..., feature, q``: map from probability to the linearly interpolated quantile.

    Features without a known value are absent.
    """
    spark, probabilities = df.sparkSession, [float(p) for p in probabilities]
    asks = 2 * len(probabilities)  # the ranks below and above each
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    if by:
        names = [f"_by{i}" for i in range(len(by))]
        rows = df.select(*[F.col(b).alias(n) for b, n in zip(by, names)], x)
        groups = stored(rows.select(*names).distinct().withColumn("g", F.monotonically_increasing_id()), "quantile-groups")
        same = [rows[n].eqNullSafe(groups[n]) for n in names]
        rows = rows.join(groups, same).select("g", "x")
    else:
        rows = df.select(F.lit(0).cast("long").alias("g"), x)
    rows = stored(rows, "quantile-rows")

    few = 1 << DIGIT
    state, known, done, most = None, None, 0, rows.count()
    while done < 64:
        width = 64 - done if most <= few else min(DIGIT, 64 - done)
        asked = rows
        if done and by:
            place = F.array(*[F.struct(F.lit(f).cast("long").alias("f"), F.lit(a).cast("long").alias("ask")) for f in range(len(columns)) for a in range(asks)])
            told = F.map_from_entries(F.collect_list(F.struct(F.struct("f", "ask"), "prefix"))).alias("m")
            prefix = F.transform(place, lambda p: F.element_at("m", p)).alias("prefix")
            asked = rows.join(state.groupBy("g").agg(told).select("g", prefix), "g", "left")
        counts = _digits(asked, len(columns), asks, done, width, known)
        key = ["g", "f"] if state is None else ["g", "f", "ask"]
        until = F.sum("n").over(Window.partitionBy(*key).orderBy("digit")).alias("until")
        if state is None:
            total = F.sum("n").over(Window.partitionBy(*key)).alias("total")
            each = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("ask"), F.lit(probabilities[a // 2]).alias("p")) for a in range(asks)]))
            met = counts.select(*key, "digit", "n", until, total).select("*", each.alias("a"))
            exact = (F.col("total") - 1) * F.col("a.p")
            rank = F.when(F.col("a.ask") % 2 == 0, F.floor(exact)).otherwise(F.ceil(exact)).cast("long")
            met = met.select(*key, "a.ask", "digit", "n", "until", exact.alias("exact"), rank.alias("rank"))
            longer = F.col("digit")
        else:
            met = counts.select(*key, "digit", "n", until).join(state.drop("left"), key)
            longer = F.shiftleft("prefix", width).bitwiseOR(F.col("digit"))
        # the rank falls on one digit; after the last pass the prefix is the value's integer
        ahead = F.col("until") - F.col("n")
        met = met.where((ahead <= F.col("rank")) & (F.col("rank") < F.col("until")))
        state = met.select("g", "f", "ask", longer.alias("prefix"), (F.col("rank") - ahead).alias("rank"), "exact", F.col("n").alias("left"))
        done += width
        if by:
            state = stored(state, "quantile-state")
            most = state.agg(F.max("left")).first()[0] or 0
        else:  # features times ranks
            found = state.collect()
            known = {(r["f"], r["ask"]): r["prefix"] for r in found}
            most = max((r["left"] for r in found), default=0)
            state = spark.createDataFrame(found, state.schema)
    drop_stored(rows)

    if not by:
        at = {k: float(doubles(np.array([v], dtype=np.int64))[0]) for k, v in known.items()}
        exact = {(r["f"], r["ask"]): r["exact"] for r in found}
        out = {}
        for f, ask in sorted(at):
            if ask % 2 == 0:
                out.setdefault(f, {})[probabilities[ask // 2]] = _between(at[f, ask], at[f, ask + 1], exact[f, ask] % 1)
        return spark.createDataFrame([(columns[f], q) for f, q in out.items()], "feature string, q map<double,double>")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(doubles(batch.column("prefix").to_numpy()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "f", "ask", "exact")), x], ["g", "f", "ask", "exact", "x"])

    met = state.mapInArrow(values, "g long, f long, ask long, exact double, x double")
    met = met.groupBy("g", "f", F.floor(F.col("ask") / 2).cast("long").alias("i")).agg(
        F.min("x").alias("lower"), F.max("x").alias("upper"), (F.first("exact") - F.floor(F.first("exact"))).alias("part")
    )
    between = F.col("lower") * (1 - F.col("part")) + F.col("upper") * F.col("part")
    value = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(between)
    p = F.get(F.array(*[F.lit(p) for p in probabilities]), F.col("i"))
    feature = F.get(F.array(*[F.lit(c) for c in columns]), F.col("f")).alias("feature")
    found = met.groupBy("g", "f").agg(F.map_from_entries(F.collect_list(F.struct(p.alias("p"), value.alias("x")))).alias("q")).select("g", feature, "q")
    return found.join(groups, "g").select(*[F.col(n).alias(b) for b, n in zip(by, names)], "feature", "q")


def _between(lower: float, upper: float, part: float) -> float:
    """As the interpolation of percentile: no arithmetic where both are one value."""
    return lower if lower == upper else lower * (1 - part) + upper * part
