"""Approximate nearest neighbours with a hash-prefix forest (operator 1).

Every vector gets a long hash string of sign bits in each tree, and a tree is
the sorted array of the strings.  A query descends in all trees to the longest
prefix it shares with any string, and then ascends in all trees at once, one bit
at a time, until the ranges under its prefixes hold enough candidates: places in
all trees together of different vectors other than the query's own.  The ascent
can end inside a level, after some of the trees.  Copies of a vector stand next
to each other in a tree and count once, by differences of a running count; a vector
with many copies is a candidate of every query.  How long a prefix is used so
depends on how dense the data are around the query.
Candidates are scored exactly, on the original vectors in double precision.

Signs of random projections follow angles.  Largest inner products become
smallest angles by one more coordinate that gives every row the same length
(``sqrt(longest^2 - length^2)``; 0 for a query).

The index is cut into blocks of bounded size (:mod:`blocks`), each with a forest
that is built once and past which all queries stream.  A block gives the nearest of
its own to each query, and the nearest of all blocks are chosen by a window over
``k`` rows a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

from .blocks import block_counts, matrix, past_blocks

BITS = 32
#: A vector with so many copies is a candidate of every query: to miss it would cost many places.
REPEATED = 5
#: Queries that ascend together.
TOGETHER = 256


class Forest:
    """Sorted hash strings of the vectors of a block, for each tree."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int, seed: int):
        self.vectors, self.trees = vectors, trees
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * BITS))
        more = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        strings = self.strings(vectors, more)
        unique, first, name, copies = np.unique(vectors + 0.0, axis=0, return_index=True, return_inverse=True, return_counts=True)
        name = name.reshape(-1)  # equal vectors have one
        self.names = {v.tobytes(): i for i, v in enumerate(unique)}
        self.own = strings[first]  # the strings of each different vector
        self.repeated = copies[name] >= REPEATED
        self.order = np.stack([np.lexsort((name, strings[:, t])) for t in range(trees)], axis=1)
        self.sorted = np.take_along_axis(strings, self.order, axis=0)
        differs = np.diff(name[self.order], axis=0, prepend=-1) != 0
        # different vectors in front of each place; a range of strings begins with another vector than the one before it
        self.before = np.concatenate([np.zeros((1, trees), dtype=np.int64), np.cumsum(differs, axis=0)])

    def strings(self, vectors: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Hash strings ``[vector, tree]`` as integers, the first bit highest."""
        signs = np.column_stack([vectors, more]) @ self.planes > 0
        packed = np.packbits(signs.reshape(len(vectors), self.trees, BITS), axis=2)
        return packed.view(">u4")[:, :, 0].astype(np.uint64)

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of strings that share ``depth`` bits."""
        low = strings >> np.uint64(BITS - depth) << np.uint64(BITS - depth)
        high = low + np.uint64(1 << (BITS - depth))
        sides = [np.empty(strings.shape, dtype=np.int64) for _ in range(2)]
        for side, ends in zip(sides, (low, high)):
            for t in range(self.trees):
                side[:, t] = np.searchsorted(self.sorted[:, t], ends[:, t])
        return sides[0], sides[1]

    def longest_prefix(self, strings: np.ndarray) -> int:
        """The most bits that any of the queries shares with any other string than its own."""
        most = 0
        for t in range(self.trees):
            held = self.sorted[:, t]
            for side, step in (("left", -1), ("right", 0)):
                at = np.searchsorted(held, strings[:, t], side) + step
                there = (at >= 0) & (at < len(held))
                if there.any():
                    differ = int((held[at[there]] ^ strings[there, t]).min())
                    most = max(most, BITS - differ.bit_length())
        return most

    def candidates(self, queries: np.ndarray, wanted: float) -> Iterator[np.ndarray]:
        """The vectors (their places) of each query when the ascent has met ``wanted`` places, or all."""
        strings = self.strings(queries, np.zeros(len(queries)))
        name = np.array([self.names.get(q.tobytes(), -1) for q in queries + 0.0])
        start = np.zeros(strings.shape, dtype=np.int64)
        end = start.copy()
        held = np.zeros(strings.shape, dtype=np.int64)
        waiting = np.arange(len(queries))
        for depth in range(self.longest_prefix(strings), -1, -1):  # from the longest prefix upwards, all trees together
            low, high = self.ranges(strings[waiting], depth)
            trees = np.arange(self.trees)
            # a query that is in the index does not count where its string there shares the prefix
            apart = (self.own[name[waiting]] ^ strings[waiting]) >> np.uint64(BITS - depth)
            own = (name[waiting] >= 0)[:, None] & (apart == 0)
            places = self.before[high, trees] - self.before[low, trees] - own
            # the trees ascend in turn: the level may be left before all have
            total = held[waiting].sum(1, keepdims=True) + np.cumsum(places - held[waiting], axis=1)
            done = total >= wanted
            turn = np.where(done.any(1), done.argmax(1), self.trees - 1)
            up = trees <= turn[:, None]
            for side, new in ((start, low), (end, high), (held, places)):
                side[waiting] = np.where(up, new, side[waiting])
            waiting = waiting[~done.any(1)]
            if not len(waiting):
                break
        for q in range(len(queries)):
            met = self.repeated.copy()
            for t in range(self.trees):
                met[self.order[start[q, t] : end[q, t], t]] = True
            yield np.flatnonzero(met)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v`` of vectors that take part; of rows with one id the smallest vector."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    query_every: int = 20,
    k: int = 20,
    trees: int = 32,
    candidates: float = 1.1,
    least: int = 4096,
    rows_per_block: int = 65_536,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query.

    Queries are the rows whose id is divisible by ``query_every``.  The ascent in a
    block ends when the ranges of all trees together hold ``candidates`` times the
    different vectors of the block (some in several trees), and ``least`` places at
    least; ``trees`` and ``candidates`` set the recall.  Vectors that are null, empty,
    zero, or hold a null or non-finite component take no part; nor do those of
    another length than the query's.  Ties go to the smaller id.
    """
    rows = stored(usable(vectors, vec_id, embedding).withColumn("dims", F.size("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(square).alias("q")).collect()
    longest = {r["dims"]: float(r["q"]) ** 0.5 for r in sizes}
    # each length of vectors has blocks of its own, however rare it is
    blocks_of = block_counts({r["dims"]: r["n"] for r in sizes}, rows_per_block, min(rows_per_block, 4096))

    def build(block: pa.RecordBatch, dims: int):
        stack = matrix(block, "v", dims)
        return block.column("vec_id").to_numpy(), stack, Forest(stack, longest[dims], trees, seed)

    def answer(block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, stack, forest = block
        wanted = max(candidates * len(forest.names), least)
        names, asked = batch.column("vec_id").to_numpy(), matrix(batch, "v", stack.shape[1])
        for at in range(0, len(asked), TOGETHER):
            out = []
            for name, query, live in zip(names[at:], asked[at:], forest.candidates(asked[at : at + TOGETHER], wanted)):
                live = live[ids[live] != name]
                scores = stack[live] @ query
                if len(live) > k:  # all that may tie with the k-th, but for rounding
                    bound = np.partition(scores, -k)[-k]
                    live = live[scores >= bound - 1e-9 * abs(bound)]
                # in one order of summation, so that equal vectors score the same; then smaller ids first
                exact = (stack[live] * query).sum(1)
                best = np.argsort(-exact, kind="stable")[:k]
                out.append((np.full(len(best), name), ids[live[best]], exact[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    queries = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    found = past_blocks(rows, queries, blocks_of, build, answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
