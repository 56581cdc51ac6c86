"""Class balancing (T9, T10) without one task per class.

Rows are ranked by a seeded hash of their key.  The rank comes from hash
buckets and bucket counts, so a class of any size is spread over the cluster
and exactly the wanted number of rows is kept or repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import Series, row_index

_CUT = 16  # bits of the hash that are counted at a time
_BITS = 20  # a million buckets: one stays small up to 10^12 rows


def hash_rank(
    df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int, name: str, size: str
) -> DataFrame:
    """Exact position of each row in seeded hash order within ``by``."""
    h = F.xxhash64(F.lit(seed), *key)
    ranked = df.withColumn("_h", h)
    # the top bits of the hash are the bucket, so buckets are even and ordered
    bucket = F.shiftright(F.col("_h"), 64 - _BITS)
    order = Series(keys=tuple(by), order="_h")
    return row_index(ranked, order, name, size, bucket).drop("_h")


def balance_classes(
    df: DataFrame,
    column: str,
    method: str = "undersample",
    key: Sequence[str] = ("symbol", "ts"),
    seed: int = 42,
) -> DataFrame:
    """Equal class counts: the smallest class by dropping, or the largest by
    repeating every row evenly (the hash picks who gets the remainder)."""
    ranked = hash_rank(df, [column], key, seed, "_r", "_n")
    sizes = df.groupBy(column).count()
    extreme = sizes.agg(F.min("count").alias("lo"), F.max("count").alias("hi")).first()
    if method == "undersample":
        return ranked.where(F.col("_r") < F.lit(extreme["lo"])).drop("_r", "_n")
    if method != "oversample":
        raise ValueError(f"unknown balancing method {method!r}")
    most = F.lit(extreme["hi"])
    extra = (F.col("_r") < most % F.col("_n")).cast("bigint")
    copies = F.floor(most / F.col("_n")) + extra
    return ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop(
        "_r", "_n", "_copy"
    )


def cap_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``n`` rows, those of the smallest seeded hashes of their key (a sampling operator).

    Counts by the leading bits of the hash tell up to which hash all rows are in;
    only the rows that share the leading bits of the last one are looked at
    further, by the next bits.  Rows are filtered, never sorted.  Rows with one hash
    (repeated keys) are in or out by chance of their order, as many as fit.
    """
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), *key))
    low, left = 0, n  # of the hashes that begin as far as known: the first, and how many rows are to be had
    inside, done = rows, 0
    while done < 64:
        shift = 64 - done - _CUT
        # the first bits are signed, as the hash is
        digit = F.shiftright("_h", shift) if done == 0 else F.shiftright("_h", shift).bitwiseAND(F.lit((1 << _CUT) - 1))
        counts = sorted((r["_d"], r["count"]) for r in inside.groupBy(digit.alias("_d")).count().collect())
        for d, c in counts:
            if c > left:
                break
            left -= c
        else:  # all rows fit
            return df
        low = d if done == 0 else (low << _CUT) | d
        done += _CUT
        inside = rows.where(F.shiftright("_h", 64 - done) == low) if done < 64 else rows.where(F.col("_h") == low)
        if left == 0:
            break
    ahead = rows.where(F.shiftright("_h", 64 - done) < low) if done < 64 else rows.where(F.col("_h") < low)
    return (ahead if left == 0 else ahead.unionByName(inside.limit(left))).drop("_h")
