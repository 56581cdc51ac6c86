"""Searches of a stated set of queries against all rows, block by block.

The rows searched (the index) are cut into blocks by a hash of their id, and each
query is sent to every block.  A task sorts its blocks so that the rows of one
come first and its queries behind them: it builds what it needs of the block
once and answers the queries as they stream in.  It never holds more than one
block and one batch of queries, whatever vectors repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_parts

#: Rows of a block at most, and the rows below which a table is not cut further to employ more tasks.
MOST, LEAST, TASKS = 65_536, 4096, 64


def block_counts(rows_by_dims: dict[int, int], most: int = MOST, least: int = LEAST) -> dict[int, int]:
    """How many blocks the vectors of each length are cut into."""
    return {d: max(bit_parts(n, most), min(bit_parts(n, least), TASKS)) for d, n in rows_by_dims.items()} or {0: 1}


def matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The lists of a column, all of length ``dims``, as rows of a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def past_blocks(
    index: DataFrame,
    queries: DataFrame,
    blocks_of: dict[int, int],
    build: Callable[[pa.RecordBatch, int], object],
    answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """The answers of every block to every query of vectors of its length.

    Both tables have ``vec_id``, ``dims`` and ``v``; of their other columns one
    that the other table lacks is null there.  ``build`` gets a block's rows by id
    and their length, ``answer`` what it built and some queries.
    """
    counts = F.create_map(*[F.lit(x) for pair in blocks_of.items() for x in pair])
    of_dims = F.element_at(counts, F.col("dims"))
    own: Column = F.pmod(F.xxhash64("vec_id"), of_dims).cast("int")
    every = F.explode(F.sequence(F.lit(0), of_dims - 1)).alias("block")
    rows = index.select("*", own.alias("block"), F.lit(0).alias("kind"))
    asked = queries.select("*", every, F.lit(1).alias("kind"))
    both = rows.unionByName(asked, allowMissingColumns=True)
    tasks = sum(blocks_of.values())
    parted = both.repartition(tasks, "dims", "block").sortWithinPartitions("dims", "block", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, made = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("dims", "block", "kind")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                dims, block, kind = keys[start].tolist()
                if at != (dims, block):
                    at, held, made = (dims, block), [], None
                if kind == 0:
                    held.append(batch.slice(start, end - start))
                elif held or made is not None:  # a block without rows has no answers
                    if made is None:
                        made, held = build(pa.Table.from_batches(held).combine_chunks().to_batches()[0], dims), []
                    yield from answer(made, batch.slice(start, end - start))

    return parted.mapInArrow(run, schema)
