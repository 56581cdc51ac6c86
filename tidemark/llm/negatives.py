"""Hard-negative mining by an exact residue-number-system product (operator 13).

Vectors are integers (``floor(scale * x)``), and scores are their inner products.
They are formed exactly from float32 matrix products: every component is taken
modulo several primes below 512, as a number of at most 255 in magnitude, so that
256 products add up to less than ``2^24``, where float32 is exact.  Longer vectors
are multiplied in parts, reduced after each.  The residues of a score are put
together by Chinese remaindering (mixed radix, in 64-bit integers); there are as
many primes as the largest possible score needs, by the largest component.

Two searches go past all rows, block by block (:mod:`blocks`): the first gives
each anchor its best rows of the same label, the positives; the second takes the
score window of each positive and keeps its best rows of other labels in it.
Both keep at most ``k`` rows a block, anchor (and positive); Spark ranks those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

from .blocks import block_counts, matrix, past_blocks

#: Products that may be added in float32 without rounding, for residues of 255 at most.
TERMS = 256
#: Cells of a score matrix that are held at a time.
CELLS = 1 << 21


def primes_below(limit: int) -> list[int]:
    """Largest first."""
    return [n for n in range(limit - 1, 2, -2) if all(n % d for d in range(3, int(n**0.5) + 1, 2))]


def primes_for(bound: int) -> list[int]:
    """Primes whose product tells all integers from ``-bound`` to ``bound`` apart."""
    out, product = [], 1
    for p in primes_below(2 * int((2**24 // TERMS) ** 0.5)):
        if product > 2 * bound and len(out) > 1:
            break
        out.append(p)
        product *= p
    if product >= 1 << 63:
        raise ValueError(f"scores up to {bound} do not fit: the components are too large for 64-bit scores")
    return out


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Integers modulo ``p`` as float32 between ``-p/2`` and ``p/2``."""
    low = np.mod(values, p)
    return np.where(low > p // 2, low - p, low).astype(np.float32)


def combine(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers with these residues."""
    value, product = parts[0].astype(np.int64), primes[0]
    for part, p in zip(parts[1:], primes[1:]):
        digit = (part - value % p) * pow(product, -1, p) % p
        value += product * digit
        product *= p
    return np.where(value > product // 2, value - product, value)


class ResidueMatrix:
    """Rows of integers, kept modulo each prime."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.primes = primes
        self.held = [np.ascontiguousarray(residues(rows, p).T) for p in primes]

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Exact inner products ``[query, row]``."""
        out = []
        for p, held in zip(self.primes, self.held):
            asked, total = residues(queries, p), np.zeros((len(queries), held.shape[1]), dtype=np.int64)
            for at in range(0, len(held), TERMS):
                total += (asked[:, at : at + TERMS] @ held[at : at + TERMS]).astype(np.int64)
            out.append(total % p)
        return combine(out, self.primes)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, largest first, ties by place."""
    if len(scores) > k:
        live = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        live = np.arange(len(scores))
    return live[np.argsort(-scores[live], kind="stable")[:k]]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """``vec_id, label, v, dims`` of the rows that take part, as integers; of rows with one id the smallest."""
    x = F.col(embedding).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    known = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull()
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(known & ~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.struct(F.col(label).cast("long").alias("label"), whole.alias("v")).alias("r")
    )
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v", F.size("r.v").alias("dims"))


def hard_negatives(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    is_anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    rows_per_block: int = 65_536,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``is_anchor`` holds (a condition on ``vec_id``;
    all that are divisible by 100 if none is given).  An anchor's positives are its
    best ``positives`` other rows of its label; for each, the best ``negatives`` rows
    of other labels with ``low`` to ``high`` per cent of the positive's score follow
    (none if that score is below zero).  Higher scores come first, ties by smaller
    id.  Rows with a null id, label or vector, or a null or non-finite component
    take no part; of rows with one id the smallest (label, then vector) does;
    only vectors of the anchor's length are met.  Scores beyond 64 bits raise.
    """
    rows = stored(usable(vectors, vec_id, embedding, label, scale), "integer-vectors")
    largest = F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0))
    told = {r["dims"]: (r["n"], r["m"]) for r in rows.groupBy("dims").agg(F.count("*").alias("n"), largest.alias("m")).collect()}
    primes = {d: primes_for(d * m * m) for d, (_, m) in told.items()}
    blocks_of = block_counts({d: n for d, (n, _) in told.items()}, rows_per_block)
    anchors = rows.where(F.pmod("vec_id", F.lit(100)) == 0 if is_anchor is None else is_anchor)

    def build(block: pa.RecordBatch, dims: int):
        return (
            block.column("vec_id").to_numpy(),
            block.column("label").to_numpy(),
            ResidueMatrix(matrix(block, "v", dims), primes[dims]),
            dims,
        )

    def score_rows(block, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        ids, _, held, dims = block
        asked, step = matrix(batch, "v", dims), max(1, CELLS // len(ids))
        for at in range(0, len(asked), step):
            yield from enumerate(held.scores(asked[at : at + step]), at)

    def same_label(block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels = block[:2]
        names, own = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        out = []
        for i, scores in score_rows(block, batch):
            live = np.flatnonzero((labels == own[i]) & (ids != names[i]))
            live = live[best(scores[live], positives)]
            out.append((np.full(len(live), names[i]), ids[live], scores[live]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "other_id", "score"])

    found = past_blocks(rows, anchors, blocks_of, build, same_label, "anchor_id long, other_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    chosen = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    chosen = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "other_id", "score"))).alias("p"))
    asked = anchors.join(chosen, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", "dims", F.col("p.other_id").alias("positive_ids"), F.col("p.score").alias("positive_scores")
    )

    def other_labels(block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels = block[:2]
        names, own = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        wanted = list(zip(batch.column("positive_ids").to_pylist(), batch.column("positive_scores").to_pylist()))
        out = [(np.empty(0, np.int64),) * 5]
        for i, scores in score_rows(block, batch):
            windows = [(p, s, -(-low * s // 100), high * s // 100) for p, s in zip(*wanted[i])]  # in whole numbers
            least, most = min(w[2] for w in windows), max(w[3] for w in windows)
            live = np.flatnonzero((labels != own[i]) & (scores >= least) & (scores <= most))
            live = live[np.argsort(-scores[live], kind="stable")]
            falling = -scores[live]
            for name, score, a, b in windows:
                some = live[np.searchsorted(falling, -b, "left") : np.searchsorted(falling, -a, "right")][:negatives]
                same = (np.full(len(some), x) for x in (names[i], name, score))
                out.append((*same, ids[some], scores[some]))
        columns = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], columns)

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    met = past_blocks(rows, stored(asked, "anchors"), blocks_of, build, other_labels, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
