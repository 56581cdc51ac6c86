"""Tree ensembles as arrays, and Shapley walks over them in blocks of rows.

A walk turns a background row into the explained one, a feature at a time.  A
leaf is reached during one stretch of the steps, as each condition on its path
is met always, never, from the step on at which its feature enters, or until
then.  So one descent that carries (first step, last step) gives the outputs of
all steps; no step is a row or a vector of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .models import CLASSES, BoostedClassifier, BoostedRegressor, ForestClassifier

_PATHS = 1 << 18  # (row, tree) pairs that descend together


@dataclass
class Ensemble:
    """Nodes of all trees; ``feature`` is -1 at a leaf, ``value`` has a column per output."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    share: bool = False  # outputs are margins of binary models that share one probability

    def finish(self, raw: np.ndarray) -> np.ndarray:
        if not self.share:
            return raw
        p = 1 / (1 + np.exp(-2 * raw))
        return p / p.sum(axis=-1, keepdims=True)


def has_trees(model) -> bool:
    return isinstance(model, (BoostedClassifier, BoostedRegressor, ForestClassifier))


def _nodes(spark, part) -> pd.DataFrame:
    """Nodes of a spark.ml ensemble, in order of tree and node.

    The model is saved in Spark's own format and read as a table, as its nodes
    cannot be had otherwise without a call for each; at most trees x 2^(depth + 1) rows.
    """
    path = f"{shared_dir(spark)}/trees-{uuid4().hex}"
    part.write().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["prediction"].alias("prediction"),
        node["impurityStats"].alias("stats"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"),
        split["leftCategoriesOrThreshold"].alias("threshold"),
        split["numCategories"].alias("categories"),
    )
    found = rows.toPandas().sort_values(["tree", "node"], ignore_index=True)
    if (found["categories"] >= 0).any():
        raise ValueError("trees with categorical splits are not read")
    return found


def read_trees(spark, model) -> Ensemble:
    """The trees of a boosted or forest model of :mod:`tidemark.operators.models`."""
    parts = model.models if isinstance(model, BoostedClassifier) else [model.model]
    outputs = 1 if isinstance(model, BoostedRegressor) else len(CLASSES)
    tables, values, start = [], [], 0
    for i, part in enumerate(parts):
        nodes = _nodes(spark, part)
        weight = np.asarray(part.treeWeights)[nodes["tree"]]
        value = np.zeros((len(nodes), outputs))
        if isinstance(model, ForestClassifier):
            counts = np.stack(nodes["stats"].to_numpy())
            share = counts / counts.sum(axis=1, keepdims=True) / part.getNumTrees
            known = min(outputs, share.shape[1])
            value[:, :known] = share[:, :known]
        else:
            value[:, i] = nodes["prediction"].to_numpy() * weight
        # node numbers count from 0 in each tree
        sizes = nodes.groupby("tree").size().to_numpy()
        roots = start + sizes.cumsum() - sizes
        offset = np.repeat(roots, sizes)
        tables.append(
            (
                roots,
                np.where(nodes["left"] >= 0, nodes["feature"], -1),
                np.array([t[0] if len(t) else 0.0 for t in nodes["threshold"]]),
                nodes["left"].to_numpy() + offset,
                nodes["right"].to_numpy() + offset,
            )
        )
        values.append(value)
        start += len(nodes)
    return Ensemble(
        *[np.concatenate(column) for column in zip(*tables)],
        np.concatenate(values),
        share=isinstance(model, BoostedClassifier),
    )


def walk(trees: Ensemble, x: np.ndarray, z: np.ndarray, enters: np.ndarray) -> np.ndarray:
    """Outputs (rows, features + 1, outputs) after each step from ``z`` to ``x``.

    ``enters`` is the step, from 1, at which a feature takes its value of ``x``.
    """
    n, k = x.shape
    width = k + 2
    moves = np.zeros((trees.value.shape[1], n * width))
    row = np.repeat(np.arange(n), len(trees.roots))
    node = np.tile(trees.roots, n)
    first, last = np.zeros(len(row), np.int64), np.full(len(row), k, np.int64)
    while len(row):
        leaf = trees.feature[node] < 0
        begins, ends = row[leaf] * width + first[leaf], row[leaf] * width + last[leaf] + 1
        for total, value in zip(moves, trees.value[node[leaf]].T):
            total += np.bincount(begins, value, n * width) - np.bincount(ends, value, n * width)
        row, node, first, last = (a[~leaf] for a in (row, node, first, last))
        f, cut = trees.feature[node], trees.threshold[node]
        step = enters[row, f]
        from_left, to_left = z[row, f] <= cut, x[row, f] <= cut
        same = from_left == to_left
        until = np.where(same, last, np.minimum(last, step - 1))
        since = np.maximum(first, step)
        stay, turn = first <= until, ~same & (since <= last)
        before = np.where(from_left, trees.left[node], trees.right[node])
        after = np.where(to_left, trees.left[node], trees.right[node])
        row = np.concatenate([row[stay], row[turn]])
        node = np.concatenate([before[stay], after[turn]])
        first, last = (
            np.concatenate([first[stay], since[turn]]),
            np.concatenate([until[stay], last[turn]]),
        )
    raw = moves.reshape(-1, n, width).cumsum(axis=2)[:, :, : k + 1]
    return trees.finish(np.moveaxis(raw, 0, 2))


def _orders(h: np.ndarray, repeats: int, k: int) -> np.ndarray:
    """Entering step (rows, repeats, features) by a seeded mix of each row's hash."""
    with np.errstate(over="ignore"):
        # fixed values: the public SplitMix64 generator
        at = h.astype(np.uint64)[:, None] + np.arange(1, repeats * k + 1, dtype=np.uint64) * np.uint64(
            0x9E3779B97F4A7C15
        )
        at = (at ^ (at >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        at = (at ^ (at >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    at = (at ^ (at >> np.uint64(31))).reshape(-1, repeats, k)
    return at.argsort(axis=2, kind="stable").argsort(axis=2, kind="stable") + 1


def shapley_walks(
    trees: Ensemble, df: DataFrame, keep: Sequence[str], repeats: int, k: int
) -> DataFrame:
    """``keep`` with ``value``, ``base`` and ``phi`` of every row.

    ``df`` has the row ``_x``, its ``repeats`` background rows in one array
    ``_z`` and a hash ``_h``.  ``phi`` holds the outputs of a feature side by side.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)
    size = max(_PATHS // max(len(trees.roots) * repeats, 1), 1)

    def explain(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for page in pages:
            for at in range(0, len(page), size):
                part = page.iloc[at : at + size]
                n = len(part)
                x = np.repeat(np.stack(part["_x"].to_numpy()), repeats, axis=0)
                z = np.stack(part["_z"].to_numpy()).reshape(n * repeats, k)
                enters = _orders(part["_h"].to_numpy(), repeats, k).reshape(n * repeats, k)
                outputs = walk(model, x, z, enters)
                phi = np.take_along_axis(np.diff(outputs, axis=1), enters[:, :, None] - 1, axis=1)
                out = part[list(keep)].copy()
                out["value"] = list(outputs[::repeats, -1])
                out["base"] = list(outputs[:, 0].reshape(n, repeats, -1).mean(axis=1))
                out["phi"] = list(phi.reshape(n, repeats, -1).mean(axis=1))
                yield out

    many = T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[c] for c in keep])
    for name in ("value", "base", "phi"):
        schema = schema.add(name, many)
    return df.select(*keep, "_x", "_z", "_h").mapInPandas(explain, schema)
