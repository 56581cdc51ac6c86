"""Mixing sources to target weights by capped water-filling (operator 9).

Every source has a weight and a cap, the most epochs of it that the mix may
hold.  Weights share the whole; a source above its cap is clamped to it and the
excess goes to the others by weight, until no source is above.  With sources in
order of cap over weight the clamped ones come first, so the fixed point is
read off running sums: the first source that fits its share sets the level.

A source is then taken ``target / size`` times: the whole part of that ratio is
so many repetitions of every document.  The rest is a sample: documents in the
order of a seeded hash, as long as their sizes fit.  The gap that is left is
closed by the one document whose size comes nearest to it.  Where the source is
then still not ``near`` its target, because a large document stopped the draw or
was all that could close the gap, its sample is drawn anew by size class, the
largest first and in the seeded order within a class; a document larger than the
gap is left out and stops nothing.  The better of both samples stays.

Running sums use buckets, prefixes of the hash: sums of the buckets in front,
then a window inside a bucket.  So no task holds a source, whatever its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

from .common import WORD, bit_parts, whole

WEIGHTS = (5, 2, 1)


def word_count(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def water_levels(sources: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = 3) -> DataFrame:
    """``source, source_size`` with ``weight`` and ``target``.

    Weights repeat over the sources by code point, null last.  There is one row
    a source, and this is the only place where all of them meet.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
    rows = rows.withColumn("cap", F.col("source_size") * float(epochs))
    rows = rows.withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("place"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("clamped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("sharing"),
        F.sum("source_size").over(everything).alias("total"),
    )
    rows = rows.withColumn("level", (F.col("total") - F.col("clamped")) / F.col("sharing"))
    fits = F.col("cap") >= F.col("weight") * F.col("level")
    rows = rows.withColumn("first", F.min(F.when(fits, F.struct("place", "level"))).over(everything))
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap"))
    target = target.otherwise(F.least("cap", F.col("weight") * F.col("first.level")))
    return rows.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _by_source(rows: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``others``, which has one row a source."""
    named = others.withColumnRenamed("source", "__s")
    return rows.join(named, F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def _best_fit(left: DataFrame, gaps: DataFrame) -> DataFrame:
    """``source, miss, row``: the document of ``left`` that fits the gap best, if it makes it smaller."""
    miss = F.abs(F.col("size") - F.col("gap"))
    rows = _by_source(left, gaps).where(miss < F.col("gap"))
    best = rows.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "hash", "row")).alias("best"))
    return best.select("source", "best.miss", "best.row")


def _draw_by_size(rows: DataFrame, gaps: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """``source, row`` of documents that fill the gaps, large before small, and ``source, miss`` that is left.

    Every round leaves out what is larger than the gap and draws at least one
    document of each source that has any, so the rounds come to an end.
    """
    size_class = F.lit(99) - F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    left = rows.where("size > 0").withColumn("place", F.concat(size_class.cast("string"), "hash"))
    drawn = left.select("source", "row").limit(0)
    while True:
        fits = _by_source(left, gaps).where(F.col("size") <= F.col("gap"))
        fits = fits.withColumn("bucket", F.substring("place", 1, 2 + digits))
        front = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = fits.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
        buckets = buckets.withColumn("before", F.coalesce(F.sum("held").over(front), F.lit(0)))
        buckets = buckets.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), "before")
        inner = Window.partitionBy("source", "bucket").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, 0)
        running = fits.withColumn("inside", F.sum("size").over(inner))
        running = running.join(buckets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
        running = running.withColumn("seen", F.col("before") + F.col("inside")).where(F.col("seen") <= F.col("gap"))
        now = stored(running.select("source", "row", "seen"), "mix-more")
        if not now.limit(1).count():
            break
        drawn = drawn.union(now.select("source", "row"))
        got = now.groupBy("source").agg(F.max("seen").alias("seen"))
        gap = F.col("gap") - F.coalesce("seen", F.lit(0))
        gaps = stored(_by_source(gaps, got, "left").select("source", gap.alias("gap")), "mix-gaps")
        left = stored(left.join(now.select("row"), "row", "left_anti"), "mix-left")
    best = stored(_best_fit(left, gaps), "mix-best")
    missed = _by_source(gaps, best, "left").select("source", F.coalesce("miss", "gap").alias("miss"))
    return drawn.union(best.select("source", "row")), missed


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    epochs: int = 3,
    seed: str = "mix-1",
    rows_per_bucket: int = 20_000,
    near: float = 0.05,
) -> DataFrame:
    """``doc_id, size, source_size, target, times, taken`` of every row, and ``carry``.

    ``times`` is how often the mix holds the document, ``taken`` its words there.
    Null texts have size 0; a null source is a source; rows that repeat an id
    count each.  An empty table gives an empty result.  A source further from its
    target than ``near`` of it is drawn anew by size class.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(text).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
        *[F.col(c).alias(f"__{c}") for c in carry],
    )
    rows = stored(rows, "mix-rows")  # sizes once, and a name for each row
    digits = len(f"{bit_parts(rows.count(), rows_per_bucket) - 1:x}")
    narrow = rows.select("source", "size", "hash", "row", "doc_id")
    narrow = narrow.withColumn("bucket", F.substring("hash", 1, digits))

    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    sources = buckets.groupBy("source").agg(F.sum("held").cast("long").alias("source_size"))
    levels = water_levels(sources, weights, epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    levels = levels.withColumn("whole", F.least(times, F.lit(epochs)).cast("long"))
    levels = levels.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    front = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("held").over(front), F.lit(0)))
    buckets = buckets.join(levels.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    inner = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    running = narrow.withColumn("inside", F.sum("size").over(inner))
    plan = buckets.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), "before", "source_size", "target", "whole", "rest")
    found = running.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    found = found.withColumn("drawn", F.col("before") + F.col("inside") <= F.col("rest"))
    found = stored(
        found.select("row", "source", "size", "hash", "before", "inside", "source_size", "target", "whole", "rest", "drawn"),
        "mix-drawn",
    )

    reach = F.max(F.when(F.col("drawn"), F.col("before") + F.col("inside")))
    got = found.groupBy("source").agg(reach.alias("got"), F.first("rest").alias("rest"), F.first("target").alias("target"))
    gaps = stored(got.select("source", "target", "rest", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap")), "mix-gaps")
    best = stored(_best_fit(found.where(~F.col("drawn")), gaps.select("source", "gap")), "mix-best")
    reached = _by_source(gaps, best, "left").withColumn("miss", F.coalesce("miss", "gap"))
    far = stored(reached.where(F.col("miss") > near * F.col("target")), "mix-far")

    sample = found.withColumn("drawn", F.col("drawn").cast("long"))
    extra = best.select("row", F.lit(1).alias("extra"))
    if far.limit(1).count():
        again = _by_source(found.select("row", "source", "size", "hash"), far.select("source"))
        anew, missed = _draw_by_size(again, far.select("source", F.col("rest").alias("gap")), digits)
        better = _by_source(far.select("source", F.col("miss").alias("first_miss")), missed)
        better = stored(better.where("miss < first_miss").select("source", F.lit(True).alias("better")), "mix-better")
        anew = stored(_by_source(anew, better).select("row", F.lit(1).alias("anew")), "mix-anew")
        sample = _by_source(sample, better, "left").join(anew, "row", "left")
        sample = sample.withColumn("drawn", F.when(F.col("better"), F.coalesce("anew", F.lit(0))).otherwise(F.col("drawn")))
        kept = best.join(better.select(F.col("source").alias("__s")), F.col("source").eqNullSafe(F.col("__s")), "left_anti")
        extra = kept.select("row", F.lit(1).alias("extra"))

    plan = sample.select("row", "source_size", "target", "whole", "drawn").join(extra, "row", "left")
    repeats = F.col("whole") + F.col("drawn") + F.coalesce("extra", F.lit(0))
    mixed = rows.join(plan.withColumn("times", F.least(repeats, F.lit(epochs))), "row")
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.col("times").cast("long").alias("times"),
        (F.col("times") * F.col("size")).cast("long").alias("taken"),
        *[F.col(f"__{c}").alias(c) for c in carry if c != "doc_id"],
    )
