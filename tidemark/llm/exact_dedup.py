"""Exact dedup by progressive refinement (operator 2).

Texts that differ in length, or in a hash of their first letters, differ.  A
first scan writes (length, prefix hash) of each text, sixteen bytes a row.  On
those rows lengths held by one text drop out, then (length, prefix hash) pairs
held by one text.  The second scan hashes the full content only of rows whose
pair survived.  Equal full hashes (SHA-256) are equal texts.

The second scan must know the surviving pairs without moving texts to them, and
their number grows with the data.  So it is given their hashes modulo
``coarse_keys``: at most that many integers, which is the proven bound of the
only broadcast.  A row let through by chance costs one more hash and nothing
else, because groups are formed on the full hash alone.

Counts and minima are combined on the map side, so a text with a third of all
copies sends one row a task.  The join back to the rows is left to adaptive
execution, which splits a skewed left side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

from .common import whole

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(whole(text), BLANKS, " ")


def shared_pairs(docs: DataFrame, text: str, prefix_chars: int) -> DataFrame:
    """``length, prefix`` of two texts or more: the rows whose content has to be read in full."""
    norm = normalised(text)
    rows = docs.select(
        F.octet_length(norm).alias("length"),
        F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("prefix"),
    )
    rows = stored(rows, "dedup-lengths")
    lengths = rows.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    pairs = rows.join(lengths, "length", "left_semi").groupBy("length", "prefix").agg(F.count("*").alias("n"))
    return pairs.where("n > 1").select("length", "prefix")


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] | None = None,
    prefix_chars: int = 64,
    coarse_keys: int = 1 << 16,
) -> DataFrame:
    """Every row with ``keep_id``, ``group_size`` and ``kept``.

    Of equal normalised texts the row with the smallest id stays; null ids come
    last, and of rows that repeat an id and a text one stays.  ``carry`` names
    the columns to keep (default: all); columns with the names added here are
    replaced.  An empty table gives an empty result.
    """
    added = {"keep_id", "group_size", "kept"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    coarse = F.pmod(F.xxhash64("length", "prefix"), F.lit(coarse_keys)).alias("__coarse")
    alive = shared_pairs(docs, text, prefix_chars).select(coarse).distinct()

    norm = normalised(text)
    rows = docs.select(
        *carry,
        F.col(doc_id).alias("__id"),
        norm.alias("__norm"),
        F.octet_length(norm).alias("length"),
        F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("prefix"),
    )
    rows = rows.select(*carry, "__id", "__norm", coarse)
    rows = rows.join(F.broadcast(alive.withColumn("__alive", F.lit(True))), "__coarse", "left")
    rows = rows.select(
        *carry,
        "__id",
        F.monotonically_increasing_id().alias("__row"),
        F.when(F.col("__alive"), F.unhex(F.sha2("__norm", 256))).alias("__full"),
    )
    rows = stored(rows, "dedup-rows")  # fixes __row, and hashes once

    shared = rows.where(F.col("__full").isNotNull())
    groups = (
        shared.groupBy("__full")
        .agg(
            F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("__first"),
            F.count("*").alias("__n"),
        )
        .where("__n > 1")
    )
    # rows that were told apart before their content was read take no part in the join
    rest = rows.where(F.col("__full").isNull())
    out = shared.join(groups, "__full", "left").unionByName(rest, allowMissingColumns=True)
    alone = F.col("__n").isNull()
    return out.select(
        *carry,
        F.when(alone, F.col("__id")).otherwise(F.col("__first.__id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__row") == F.col("__first.__row"))).alias("kept"),
    )
