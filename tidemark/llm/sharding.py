"""Sharding by sampled splitters (operator 5).

The rows have an order: the hash of the text, then the hash of the id, so equal
texts lie side by side and the order says nothing about content.  A sample in
which a row's chance grows with its size gives keys; their quantiles cut the
order into ranges of about equal bytes, several for each shard.  Bytes of the
ranges are then counted over all rows.  A shard should end at a given byte, so
the ranges which hold such a byte are too coarse: they are sampled and
subdivided again, a constant factor each round, until they are small against a
shard.  The number of rounds does not depend on the table's size, and only the
sample and one row for each range reach the driver, both of bounded number.

Copies of one text stay in one shard unless their bytes exceed ``group_share``
of a shard; then the range is overfull in one key, and it is subdivided by id.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

from .common import bit_parts, whole

LOWEST = -(1 << 63)
#: Parts that an overfull range is cut into at each round.
FINER = 16
Bound = tuple[int, int]


def sized_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, size, text_crc32, key, tie``: what sharding needs to know of a row."""
    data = whole(text).cast("binary")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("key"),
        F.xxhash64(F.col(doc_id)).alias("tie"),
    )


def range_number(bounds: list[Bound], first: int = 0) -> Column:
    """How many of the sorted bounds are not above a row, by a tree of comparisons."""

    def sql(low: int, high: int) -> str:
        if low == high:
            return str(first + low)
        mid = (low + high) // 2
        key, tie = bounds[mid]
        at = f"key < {key}L" if tie == LOWEST else f"(key < {key}L OR (key = {key}L AND tie < {tie}L))"
        if tie == LOWEST and key == LOWEST:
            at = "false"
        return f"IF({at}, {sql(low, mid)}, {sql(mid + 1, high)})"

    return F.expr(sql(0, len(bounds)).replace(f"{LOWEST}L", f"(-{(1 << 63) - 1}L - 1L)"))


def weighted_sample(rows: DataFrame, wanted: int, total: int, seed: int) -> list[Bound]:
    """Keys of rows drawn with a chance in proportion to size: about ``wanted`` of them."""
    luck = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = rows.where(luck < F.col("size") * (wanted / max(1, total)))
    return sorted((r["key"], r["tie"]) for r in drawn.select("key", "tie").distinct().collect())


def splitters(
    rows: DataFrame,
    shards: int,
    ranges_per_shard: int = 8,
    sample_per_range: int = 8,
    precision: float = 0.002,
    group_share: float = 0.02,
    seed: int = 7,
) -> list[Bound]:
    """The bound in front of each shard but the first, in order."""
    total = rows.agg(F.sum("size").alias("total")).first()["total"] or 0
    if not total or shards < 2:
        return []
    share = total / shards
    goals = [share * i for i in range(1, shards)]
    sample = weighted_sample(rows, shards * ranges_per_shard * sample_per_range, total, seed)
    pieces = shards * ranges_per_shard
    starts = sorted({(sample[len(sample) * i // pieces][0], LOWEST) for i in range(1, pieces)}) if sample else []
    ranges = _bytes_from(rows, starts)

    for round_ in range(1, 8):
        wide = _overfull(ranges, goals, share * precision, share * group_share)
        if not wide:
            break
        edges = sorted({b for low, high, _ in wide for b in (low, high) if b})
        inside = range_number(edges).isin([bisect.bisect_right(edges, low) if low else 0 for low, _, _ in wide])
        open_rows = rows.where(inside) if edges else rows
        open_bytes = sum(ranges[low] for low, _, _ in wide)
        sample = weighted_sample(open_rows, len(wide) * FINER * sample_per_range, open_bytes, seed + round_)
        new: set[Bound] = set()
        for low, high, in_text in wide:
            mine = sample[bisect.bisect_left(sample, low) if low else 0 : bisect.bisect_left(sample, high) if high else None]
            for key, tie in [mine[len(mine) * j // FINER] for j in range(FINER)] if mine else []:
                # in front of a copy; or in front of and behind all copies of a text
                new |= {(key, tie)} if in_text else {(key, LOWEST), (min(key + 1, -LOWEST - 1), LOWEST)}
        if not new - ranges.keys():
            break
        finer = _bytes_from(open_rows, sorted(new.union(edges)))
        lows = {low for low, _, _ in wide}
        ranges |= {b: w for b, w in finer.items() if b in lows or (b in new and b not in ranges)}

    order = sorted(ranges, key=lambda b: (b is not None, b or ()))
    ends, at = [], 0
    for bound in order[:-1]:
        at += ranges[bound]
        ends.append(at)
    cuts = []
    for goal in goals:
        i = bisect.bisect_left(ends, goal)
        if near := [j for j in (i - 1, i) if 0 <= j < len(ends)]:
            cuts.append(order[1 + min(near, key=lambda j: abs(ends[j] - goal))])
    return sorted(cuts)


def _bytes_from(rows: DataFrame, starts: list[Bound]) -> dict[Bound | None, int]:
    """Bytes of the range behind each bound; None stands for the start of the order."""
    counted = rows.groupBy(range_number(starts).alias("range")).agg(F.sum("size").alias("bytes")).collect()
    held = {r["range"]: r["bytes"] for r in counted}
    return {b: held.get(i, 0) for i, b in enumerate([None, *starts])}


def _overfull(
    ranges: dict[Bound | None, int], goals: list[float], most: float, most_of_text: float
) -> list[tuple[Bound | None, Bound | None, bool]]:
    """Ranges ``low, high`` that hold a goal and too many bytes, and whether they lie inside one text."""
    order = sorted(ranges, key=lambda b: (b is not None, b or ()))
    found, at = [], 0
    for low, high in zip(order, [*order[1:], None]):
        bytes_, until = ranges[low], at + ranges[low]
        text = low is not None and high is not None and low[1] == LOWEST == high[1] and low[0] + 1 == high[0]
        part = any(b is not None and b[1] != LOWEST for b in (low, high))
        i = bisect.bisect_right(goals, at)
        if i < len(goals) and goals[i] < until and bytes_ > (most_of_text if text else most):
            found.append((low, high, text or part))
        at = until
    return found


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Size is the UTF-8 bytes of the text and 8; a null text has none and the
    checksum of nothing, 0.  Shards are near equal in size; slots count the rows
    of a shard from 0 without gaps.  Rows equal in id and text are not told
    apart and stay together.  An empty table gives an empty result.
    """
    rows = stored(sized_rows(docs, doc_id, text), "shard-rows")
    cuts = splitters(rows, shards)
    buckets = bit_parts(rows.count(), rows_per_bucket * shards)
    placed = rows.select(
        "*",
        range_number(cuts).alias("shard"),
        F.pmod(F.xxhash64("tie", "key", F.lit(1)), F.lit(buckets)).cast("int").alias("__bucket"),
    )
    # slots: rows in front in other buckets of the shard, then the place in the own bucket
    sizes = placed.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("key", "tie", "size")) - 1
    numbered = placed.withColumn("__place", place).join(offsets, ["shard", "__bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("__before") + F.col("__place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
