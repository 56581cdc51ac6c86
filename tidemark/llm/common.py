"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the contracts that split at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def whole(text: str | Column) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_mod(doc_id: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null ids count as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def bit_parts(total: int, per_part: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many parts hold ``total`` at ``per_part`` each, within bounds."""
    return max(least, min(most, math.ceil(total / max(1, per_part))))


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of this session hold about ``most`` bytes, however long their rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def give_back() -> None:
    """Free memory of this Python process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def tidied(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A step of ``mapInArrow`` behind which its worker, which waits for more tasks, gives free memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def replace_column(df: DataFrame, name: str) -> DataFrame:
    """``df`` without a column of this name, so that an operator can add its own."""
    return df.drop(name) if name in df.columns else df
