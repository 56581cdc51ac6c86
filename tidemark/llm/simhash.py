"""SimHash near-dedup with covering locality-sensitive hashing (operator 7).

Fingerprints of 64 bits link when at most ``radius`` bits differ.  The bits are
given the nonzero vectors of GF(2)^(radius + 1) in turn.  Each nonzero ``v``
makes a mask: the bits whose vector has odd product with ``v``.  For any
``radius`` differing bits there is a ``v`` orthogonal to all their vectors, so
two linked fingerprints agree on that whole mask: they collide for certain in
one of the ``2^(radius + 1) - 1`` tables, and no link is missed.  A mask of 64
bits at radius 3 keeps 32 to 36 of them, so chance collisions are rare.

Rows with one fingerprint are one node.  In a bucket of two the pair is compared
as it is; members of a larger one are compared with numpy, in blocks of bounded
size when the bucket is large (every pair of blocks meets, whatever the number),
and only the closest links that connect the bucket leave the task: less than one
for each member, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored

from .bpe import _slices
from .common import bit_parts, whole
from .graph import components

SEED = 42
BLOCK = 2048


# ------------------------------------------------------------ fingerprints
def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words joined by a space; the whole sequence if there are fewer, none of none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def majority(features: list[bytes]) -> int:
    """A bit is 1 if it is set in over half of the features' hashes."""
    if not features:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(f, SEED) for f in features), dtype=np.uint64, count=len(features))
    bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(features)).view(">u8")[0])


def of_shingles(size: int) -> Callable[[str], int]:
    """Fingerprint of lower-cased word shingles, repeats included."""
    return lambda text: majority(shingles(text.encode().lower().split(), size))


def fingerprints(docs: DataFrame, doc_id: str, text: str, make: Callable[[str], int]) -> DataFrame:
    """``doc_id, fp`` of every row, ``fp`` as signed 64-bit integer; null and empty texts give 0."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for batch in _slices(full):
                found = np.array([make(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"]
                )

    return docs.select(doc_id, whole(text).alias("__text")).mapInArrow(run, schema)


# --------------------------------------------------------------- the links
def covering_masks(radius: int = 3) -> list[int]:
    """Masks of all tables as signed 64-bit integers."""
    vectors = 1 << (radius + 1)
    out = []
    for v in range(1, vectors):
        mask = sum(1 << i for i in range(64) if ((i % (vectors - 1) + 1) & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def closest_links(points: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links within ``most`` bits that connect what all such links connect, the closest first."""
    points = np.unique(points)
    chunk = max(1, (1 << 22) // max(1, len(points)))
    rows, cols, far = [], [], []
    for at in range(0, len(points), chunk):
        apart = np.bitwise_count(points[at : at + chunk, None] ^ points[None, :])
        i, j = np.nonzero((apart <= most) & (np.arange(len(points))[None, :] > np.arange(at, at + len(apart))[:, None]))
        rows.append(i + at)
        cols.append(j)
        far.append(apart[i, j])
        if sum(map(len, rows)) > 1 << 21:  # keep what matters so far
            kept = _forest(np.concatenate(rows), np.concatenate(cols), np.concatenate(far), len(points))
            rows, cols, far = ([x] for x in kept)
    if not rows:
        return []
    i, j, _ = _forest(np.concatenate(rows), np.concatenate(cols), np.concatenate(far), len(points))
    signed = points.view(np.int64)
    return list(zip(signed[i].tolist(), signed[j].tolist()))


def _forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest."""
    order = np.argsort(far, kind="stable")
    parent = list(range(n))
    kept = []
    for e, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(e)
    return i[kept], j[kept], far[kept]


def links(points: DataFrame, radius: int = 3, block: int = BLOCK, prints_per_task: int = 8000) -> DataFrame:
    """``a, b``: links of at most ``radius`` bits that connect the fingerprints ``fp`` as all such links do."""
    masks = covering_masks(radius)
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
    points = points.repartition(bit_parts(points.count(), prints_per_task), "fp")  # before each becomes a row a table
    rows = points.select("fp", F.explode(tables).alias("key"))  # a bucket of its own for each table and masked value
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    buckets = stored(buckets.where("n > 1"), "buckets")
    pairs = buckets.where("n = 2").select("a", "b").distinct()
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)

    # sizes are estimated without the tables' factor: never broadcast the exploded side
    large = rows.hint("merge").join(buckets.where("n > 2").select("key", "n"), "key")
    number = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), number).cast("int")
    large = large.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), number - 1)).alias("other"))
    groups = large.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    groups = groups.agg(F.collect_list("fp").alias("members"))  # of two blocks at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, ...]] = set()
        for batch in batches:
            lists = batch.column(0)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            found: set[tuple[int, int]] = set()
            for a, b in zip(ends[:-1], ends[1:]):
                members = np.unique(values[a:b])
                name = (len(members), *members[:8].tolist(), *members[-8:].tolist()) if len(members) <= 16 else None
                if name is None or name not in seen:  # small groups meet again in other tables
                    found.update(closest_links(members.view(np.uint64), radius))
                    if name and len(seen) < 200_000:
                        seen.add(name)
            a, b = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return pairs.union(groups.select("members").mapInArrow(run, "a long, b long")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest id that links of at most ``radius`` bits
    reach.  Null and empty texts have fingerprint 0 and link like others; null
    ids are ignored by the minimum; repeated rows share fingerprint and
    component.  Other columns are not read.
    """
    marked = stored(fingerprints(docs, doc_id, text, of_shingles(shingle)), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    labels = components(links(nodes.select("fp"), radius))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = labelled.select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = labelled.join(named, "label").select("fp", "component_id")
    return marked.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# ------------------------------------------------- near copies, verified
def band_count(threshold: float, rows: int, miss: float) -> int:
    """How many bands of ``rows`` minima leave a pair at the threshold unmet with a chance of ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(threshold, 1 - 1e-6) ** rows)))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted 32-bit hashes of the distinct word shingles; a text without words has the empty one."""
    names = set(shingles(text.encode().lower().split(), size)) or {b""}
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, names), dtype=np.uint32, count=len(names)))


def shingle_bands(docs: DataFrame, who: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """``who, bands``: a hash of each band, that is of the smallest shingles under ``rows`` orders."""
    schema = T.StructType([docs.schema[who], T.StructField("bands", T.ArrayType(T.LongType()))])
    odd = np.random.default_rng(SEED).integers(1, 1 << 32, size=(2, bands * rows), dtype=np.uint32) | np.uint32(1)

    def least(hashes: np.ndarray) -> np.ndarray:
        out = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(hashes), 2048):
            mixed = hashes[at : at + 2048, None] * odd[0]
            mixed ^= mixed >> np.uint32(15)  # products alone would order sets alike
            mixed *= odd[1]
            np.minimum(out, mixed.min(0), out=out)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for batch in _slices(full):
                out = []
                for t in batch.column(1).to_pylist():
                    mins = least(shingle_hashes(t, size)).reshape(bands, rows)
                    keys = [xxhash.xxh64_intdigest(m.tobytes(), b) for b, m in enumerate(mins)]
                    out.append(np.array(keys, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], [who, "bands"])

    return docs.select(who, whole(text).alias("__text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key, held``: sorted 32-bit hashes of the distinct word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for batch in _slices(full):
                held = [shingle_hashes(t, size).view(np.int32) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int32()))], ["key", "held"])

    return docs.select(key, whole(text).alias("__text")).mapInArrow(run, "key long, held array<int>")


def linked_sets(sets: list[np.ndarray], parts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of different ``parts`` with a similarity of ``threshold`` that connect what all such pairs connect."""
    n, sizes = len(sets), np.array(list(map(len, sets)), dtype=np.int64)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = held > 1  # what one set alone holds is in no intersection
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    step = 4096
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (at, at + step))
        dense = np.zeros((n, step), dtype=np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        common += dense @ dense.T
    i, j = np.nonzero(np.triu(parts[:, None] != parts[None, :], 1))
    both = common[i, j].astype(np.int64)
    near = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    i, j, _ = _forest(i[near], j[near], -both[near], n)
    return i, j


def print_groups(told: DataFrame, key: str, text: str, shingle: int, radius: int) -> DataFrame:
    """``group, key``: rows whose fingerprints links of at most ``radius`` bits connect; a group of its own for each component."""
    marked = near_duplicates(told, key, text, shingle, radius)
    return marked.select(F.xxhash64(F.lit("prints"), "component_id").alias("group"), F.col("doc_id").alias("key")).distinct()


def near_links(met: DataFrame, sets: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """``a, b``: links that connect the keys as all pairs of one ``group`` with a similarity of ``threshold`` do.

    ``met`` has ``group, key``, and ``sets`` has ``key, held``.  First the members
    of a group are compared with one of them.  Where that leaves a group in
    several parts, every member outside the largest part is compared with all
    members of other parts, in blocks of bounded size: work grows with the
    square of what the first comparisons left over, not of the group.
    """
    luck = F.struct(F.xxhash64("key", "group").alias("luck"), "key")  # another one in each group of a family
    first = met.groupBy("group").agg(F.min(luck).alias("first"), F.count("*").alias("n"))
    stars = met.join(first.where("n > 1"), "group").where(F.col("key") != F.col("first.key"))
    pairs = stars.select(F.least("key", "first.key").alias("a"), F.greatest("key", "first.key").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("held").alias(f"held_{side}")), side)
    common = F.size(F.array_intersect("held_a", "held_b"))
    alike = common >= threshold * (F.size("held_a") + F.size("held_b") - common) - 1e-9
    stars = stored(pairs.where(alike).select("a", "b"), "near-stars")

    part = components(stars).select(F.col("node").alias("key"), F.col("label").alias("part"))
    parts = stored(met.join(part, "key", "left").select("group", "key", F.coalesce("part", "key").alias("part")), "near-parts")
    sizes = parts.groupBy("group", "part").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("main"))
    left = parts.join(sizes.where("parts > 1 AND n > 2"), "group")  # the pair of a group of two was compared
    rest = F.ceil((F.col("n") - F.col("main.n")) / block).cast("int")
    main = F.ceil(F.col("main.n") / block).cast("int")
    outside = F.col("part") != F.col("main.part")
    luck = F.xxhash64("key", F.lit(1))
    own = F.when(outside, F.pmod(luck, rest)).otherwise(rest + F.pmod(luck, main)).cast("int")
    other = F.sequence(F.lit(0), F.when(outside, rest + main).otherwise(rest) - 1)
    left = left.select("group", "key", "part", own.alias("own"), F.explode(other).alias("other"))
    left = left.select("group", "key", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        held = table.column("held").combine_chunks()
        values, ends = held.values.to_numpy(), held.offsets.to_numpy()
        keys, own = table.column("key").to_numpy(), table.column("part").to_numpy()
        i, j = linked_sets([values[a:b] for a, b in zip(ends[:-1], ends[1:])], own, threshold)
        return pa.table({"a": pa.array(keys[i], pa.int64()), "b": pa.array(keys[j], pa.int64())})

    crossed = left.join(sets.select("key", "held"), "key").groupBy("group", "i", "j").applyInArrow(run, "a long, b long")
    return stars.union(crossed)


def among(docs: DataFrame, keys: DataFrame, coarse_keys: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that may have a ``key`` of ``keys``, and rows that have none.

    Decided by the key modulo ``coarse_keys``: that many integers at most are
    broadcast, whatever the number of keys, so the second part needs no shuffle.
    """
    coarse = F.pmod("key", F.lit(coarse_keys)).alias("__coarse")
    few = F.broadcast(keys.select(coarse).distinct())
    marked = docs.withColumn("__coarse", coarse)
    return marked.join(few, "__coarse", "left_semi").drop("__coarse"), marked.join(few, "__coarse", "left_anti").drop("__coarse")


def drop_near_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    rows: int = 4,
    miss: float = 1e-4,
    radius: int = 3,
) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies.

    Near copies have a Jaccard similarity of ``threshold`` or more between their
    sets of ``shingle``-word runs.  Texts meet if covering masks link their SimHash
    fingerprints at ``radius`` bits (``near_duplicates``).  As fingerprints of many
    pairs at the threshold lie farther apart, texts also meet if one of several bands of
    minima of these sets is equal; there are enough bands that a pair at the threshold
    is not met with a chance of ``miss`` at most, whatever kind of edit made it.
    Texts that meet are compared on the whole sets until all their links are found
    (``near_links``), so no text goes for its fingerprint alone.  Of verified links the row with the smallest id stays, null ids last;
    rows that repeat id and text are one text and stay or go together.
    """
    key = F.xxhash64(F.col(doc_id), whole(text))
    who = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), key.alias("key"))
    told = docs.select(who.alias("who"), F.col(text).alias("text"))
    bands = shingle_bands(told, "who", "text", shingle, band_count(threshold, rows, miss), rows)
    bands = stored(bands.dropDuplicates(["who"]), "near-bands")
    prints = told.select(F.col("who.key").alias("key"), "text")
    met = bands.select(F.explode("bands").alias("group"), F.col("who.key").alias("key"))
    met = met.unionByName(print_groups(prints, "key", "text", shingle, radius))
    several = met.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    met = stored(met.join(several, "group"), "near-met")
    members = stored(met.select("key").distinct(), "near-members")

    texts, _ = among(docs.select(key.alias("key"), F.col(text).alias("text")), members)
    sets = texts.join(members, "key", "left_semi")
    sets = stored(shingle_sets(sets, "key", "text", shingle).dropDuplicates(["key"]), "near-sets")
    found = components(near_links(met, sets, threshold))
    found = found.select(F.col("node").alias("key"), F.col("label").alias("copy_of"))

    linked = bands.select("who", F.col("who.key").alias("key")).join(found, "key")
    kept = linked.groupBy("copy_of").agg(F.min("who").alias("kept"))
    dropped = linked.join(kept, "copy_of").where(F.col("key") != F.col("kept.key")).select("key")
    dropped = stored(dropped, "near-dropped")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"))
    suspects, others = among(keyed, dropped)
    return suspects.join(dropped, "key", "left_anti").select("doc.*").union(others.select("doc.*"))
