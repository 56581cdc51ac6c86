"""Phrase collocation mining with broadcast double-array tries (operator 11).

Everything is counted per group (language).  Frequent words get numbers, one for
each word and group, and texts become shards of such numbers in which 0 stands for
the end of a piece and for every word that is not frequent: no frequent phrase
reaches over a 0, and none of two groups look alike.

Phrases are mined level by level, two words first.  Candidates of ``k`` words are
Apriori-safe: both phrases of ``k - 1`` words in them are frequent, and they occur
often enough.  Tasks sort the phrases they meet and send each different one once, with
its occurrences, to the task of its hash slice, which adds them; slices are as many as
the input asks for.  Candidates are numbered, cut by their hash into parts of bounded
size, and each part is broadcast as a double-array trie.  A task follows the trie from
all positions of a shard whose phrase is of the part, at the same time, one level after
the other, and counts the accepting states with ``bincount``; Spark adds the counts of
the shards.

The same pass marks the positions where a phrase begins in the shards, for the next
level.  Cuts, containment and ranks are joins and aggregates over the frequent
phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import drop_stored, stored

from .common import bit_parts, bound_batches, give_back, tidied
from .trie import DoubleArray, digits_for
from .words import Words, kinds, slices

#: Blanks between words, and bytes that no phrase reaches over.
SIGNS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Words or candidates of a broadcast part at most.
PART = 1 << 20
#: Positions whose phrases a task sorts at a time, and of a hash slice of all phrases; slices at least.
SORTED, SLICE, LEAST_SLICES = 1 << 21, 1 << 20, 32
#: Parts that one pass over the shards follows, and positions that a task holds for them.
TOGETHER, HELD = 8, 3 << 20
#: Counts that a task sends in one row.
BLOCK = 1 << 16
#: Bytes of a group's texts that are numbered at a time, and groups with texts that wait for more.
TEXTS, GROUPS = 2 << 20, 8
#: Positions of a shard, unless one piece is longer; its bytes stay below what the JVM keeps apart as a large object.
SHARD = 1 << 16
#: Phrases that one task ranks.
RANKED = 50_000


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    """The words of each group's texts, some texts at a time."""
    for part in slices(batch, "text"):
        groups = part.column("group").dictionary_encode()
        for i, group in enumerate(groups.dictionary.to_pylist()):
            yield group, Words(part.column("text").filter(pc.equal(groups.indices, i)), SIGNS)


def count_words(texts: DataFrame) -> DataFrame:
    """``group, word, n``, words as bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, words in by_group(batch):
                coded = words.strings.dictionary_encode()
                n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
                columns = [pa.array([group] * len(n), pa.string()), coded.dictionary, pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["group", "word", "n"])

    return texts.mapInArrow(tidied(count), "group string, word binary, n long").groupBy("group", "word").agg(F.sum("n").alias("n"))


def numbered(rows: DataFrame, keys: list[str], label: str, per_part: int, dealt: Column | None = None) -> tuple[DataFrame, list[int]]:
    """``rows`` with ``part`` and ``place``, its row number by ``keys`` in the part from 0; and the parts' sizes.

    Parts are dealt by a hash of the keys, or by the whole number ``dealt``.
    """
    rows = stored(rows, label)
    parts = bit_parts(rows.count(), per_part)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*keys) if dealt is None else dealt, F.lit(parts)).cast("int"))
    order = Window.partitionBy("part").orderBy(*keys)
    rows = stored(rows.withColumn("place", F.row_number().over(order) - 1), label + "-numbered")
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    return rows, [sizes.get(p, 0) for p in range(parts)]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Each group with its texts as one, ``TEXTS`` bytes at a time, as its words are hashed for each."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for group, text in zip(batch.column("group").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            held.setdefault(group, []).append(text)
            sizes[group] = sizes.get(group, 0) + len(text) + 1
            if sizes[group] >= TEXTS:
                yield group, b"\n".join(held.pop(group))
                del sizes[group]
            elif len(held) > GROUPS:  # many groups: the largest goes
                group = max(sizes, key=sizes.get)
                yield group, b"\n".join(held.pop(group))
                del sizes[group]
    while held:
        group, texts = held.popitem()
        yield group, b"\n".join(texts)


def _cut(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Shards of the numbers, none longer than need be, that end where a piece does; one 0 is enough."""
    ids = ids[(ids > 0) | (np.append(0, ids[:-1]) > 0)]
    ends = np.flatnonzero(ids == 0)
    at = 0
    while at < len(ids):
        cut = np.searchsorted(ends, at + SHARD)
        until = int(ends[cut]) + 1 if cut < len(ends) else len(ids)
        yield ids[at:until]
        at = until


def _let_go(shared) -> None:
    """A worker forgets what it read of a broadcast, if it can read it again."""
    if getattr(shared, "_path", None):
        vars(shared).pop("_value", None)


def _by_group(vocabulary: DataFrame, part: int, first: int) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Each group's words of a part, and their numbers by the place in these, counted from 1; 0 has none."""
    mine = vocabulary.where(F.col("part") == part).orderBy("group", "place").select("group", "word", "place").toArrow()
    groups = mine.column("group").combine_chunks().dictionary_encode()
    held = {}
    for i, group in enumerate(groups.dictionary.to_pylist()):
        own = mine.filter(pc.equal(groups.indices, i))
        held[group] = own.column("word").combine_chunks(), np.append(0, own.column("place").to_numpy() + first).astype(np.int32)
    return held


def shards_of(texts: DataFrame, vocabulary: DataFrame, sizes: list[int]) -> DataFrame:
    """``ids, live, marks``: the numbers of the frequent words of all texts, as bytes, cut where a piece ends.

    ``live`` and ``marks`` are null until :func:`accepting` sets them.  The vocabulary is broadcast part by
    part; beyond one part the texts are passed once for each.
    """
    spark, rows = texts.sparkSession, texts
    for part in range(len(sizes)):
        shared = spark.sparkContext.broadcast(_by_group(vocabulary, part, sum(sizes[:part]) + 1))
        give_back()
        first, last = part == 0, part + 1 == len(sizes)

        def encode(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            nothing = pa.array([], pa.binary()), np.zeros(1, dtype=np.int32)
            source = ((g, t, None) for g, t in _joined(batches)) if first else (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            for group, text, before in source:
                words = Words(pa.array([text], pa.binary()), SIGNS)
                vocabulary, number = shared.value.get(group, nothing)
                ids = number[words.numbers(vocabulary)]
                out = np.zeros(len(ids) + int(words.starts_piece.sum()), dtype=np.int32)
                out[np.arange(len(ids)) + np.cumsum(words.starts_piece)] = ids
                if before is not None:
                    out = np.maximum(out, np.frombuffer(before, dtype=np.int32))
                if last:
                    for shard in _cut(out):
                        columns = [pa.array([shard.tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["ids", "live", "marks"])
                else:
                    columns = [pa.array([group], pa.string()), *(pa.array([x], pa.binary()) for x in (text, out.tobytes()))]
                    yield pa.RecordBatch.from_arrays(columns, ["group", "text", "ids"])
            _let_go(shared)

        schema = "ids binary, live binary, marks binary" if last else "group string, text binary, ids binary"
        rows = stored(rows.mapInArrow(tidied(encode), schema), "phrase-shards" if last else "phrase-texts")
    return rows


def positions(ids: np.ndarray, live: np.ndarray, k: int) -> np.ndarray:
    """Where a phrase of ``k`` words may begin: both phrases one shorter are frequent."""
    if len(ids) < k:
        return np.zeros(0, dtype=np.int64)
    # a frequent phrase reaches over no 0, so two that overlap do not either
    open_ = (live[: len(ids) - k + 1] > 0) & (live[1 : len(ids) - k + 2] > 0)
    return np.flatnonzero(open_)


def bucket_of(words: list[np.ndarray]) -> np.ndarray:
    """A hash of 31 bits of each phrase, given by the numbers of its first, second, ... words."""
    mixed = np.zeros(len(words[0]), dtype=np.uint64)
    for word in words:
        mixed ^= word.astype(np.uint64)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def different(words: list[np.ndarray], n: np.ndarray | None, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different phrases of words below ``2^bits``, in order, and how often (or with which sum of ``n``) they are there."""
    if not len(words[0]):
        return words, np.zeros(0, dtype=np.int64)
    per, keys = 63 // bits, []
    for i in range(0, len(words), per):
        key = words[i].astype(np.int64)
        for word in words[i + 1 : i + per]:
            key <<= bits
            key |= word
        keys.append(key)
    new = np.ones(len(key), dtype=bool)
    if len(keys) == 1 and n is None:  # words are read off the sorted key
        many, words = len(words), []
        key.sort()
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        key = key[first]
        words = [(key >> (bits * i) & ((1 << bits) - 1)).astype(np.int32) for i in reversed(range(many))]
        return words, np.diff(first, append=len(new))
    order = np.argsort(key) if len(keys) == 1 else np.lexsort(keys[::-1])
    new[1:] = reduce(np.logical_or, (np.diff(key[order]) != 0 for key in keys))
    first = np.flatnonzero(new)
    total = np.diff(first, append=len(order)) if n is None else np.add.reduceat(n[order], first)
    return [w[order[first]] for w in words], total


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ids``, ``live`` and ``marks`` of every shard; without ``live`` every word is, without ``marks`` there are none."""
    for batch in batches:
        for a, b, c in zip(batch.column("ids"), batch.column("live"), batch.column("marks")):
            ids = np.frombuffer(a.as_buffer(), dtype=np.int32)
            live, marks = (np.unpackbits(np.frombuffer(x.as_buffer(), dtype=np.uint8), count=len(ids)).view(bool) if x.is_valid else None for x in (b, c))
            yield ids, ids > 0 if live is None else live, np.zeros(len(ids), dtype=bool) if marks is None else marks


def _blocks(total: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
    """A task's counts in rows of ``BLOCK`` neighbours from block ``start`` on, each in the narrowest integers; blocks of nought are left out."""
    for at in range(0, len(total), BLOCK):
        some = total[at : at + BLOCK]
        if most := int(some.max()):
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
            row = [pa.array([start + at // BLOCK], pa.int32()), pa.array([kind().itemsize], pa.int32()), pa.array([some.astype(kind).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["at", "wide", "counts"])


def summed(rows: DataFrame, cells: int, told: Callable, schema: str) -> DataFrame:
    """``told(first cell, counts)`` of each block of the tasks' counts, added."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for own, wide, counts in zip(batch.column("at").to_pylist(), batch.column("wide").to_pylist(), batch.column("counts")):
                more = np.frombuffer(counts.as_buffer(), dtype=f"u{wide}").astype(np.int64)
                if own != at:
                    if at is not None:
                        yield told(at * BLOCK, total)
                    at, total = own, more
                else:
                    total = total + more
        if at is not None:
            yield told(at * BLOCK, total)

    tasks = max(1, min(-(-cells // BLOCK), 64))
    return rows.repartition(tasks, "at").sortWithinPartitions("at").mapInArrow(tidied(add), schema)


def candidates(shards: DataFrame, k: int, words: int, positions_: int, least: int) -> DataFrame:
    """``gram, bucket``: the phrases of ``k`` words whose parts are frequent and that occur ``least`` times, and their hash."""
    bits = max(1, words.bit_length())
    slices_ = bit_parts(positions_, SLICE, LEAST_SLICES)
    kind = next(x for x in (np.uint8, np.uint16, np.uint32, np.uint64) if least <= np.iinfo(x).max)

    def sent(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        some = [np.concatenate(w) for w in zip(*held)]
        held.clear()
        grams, n = different(some, None, bits)
        own = bucket_of(grams) % slices_
        order = np.argsort(own, kind="stable")
        grams, n = [w[order] for w in grams], np.minimum(n, least).astype(kind)[order]  # more than the threshold need not be told
        ends = np.cumsum(np.bincount(own, minlength=slices_))
        spans = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(np.append(0, ends), ends)) if a < b]
        columns = [
            pa.array([i for i, _, _ in spans], pa.int32()),
            pa.array([b"".join(w[a:b].tobytes() for w in grams) for _, a, b in spans], pa.binary()),  # word after word: neighbours are alike
            pa.array([n[a:b].tobytes() for _, a, b in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["slice", "grams", "n"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, live, _ in _arrays(batches):
            at = positions(ids, live, k)
            held.append([ids[at + i] for i in range(k)])
            size += len(at)
            if size >= SORTED:
                yield sent(held)
                size = 0
        if size:
            yield sent(held)

    def often(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        grams, n = different([np.concatenate(w) for w in zip(*(g for g, _ in held))], np.concatenate([n for _, n in held]).astype(np.int64), bits)
        grams = [w[n >= least] for w in grams]
        ends = pa.array(np.arange(0, k * len(grams[0]) + 1, k, dtype=np.int32))
        gram = pa.ListArray.from_arrays(ends, pa.array(np.stack(grams, axis=1).ravel().astype(np.int32)))
        return pa.RecordBatch.from_arrays([gram, pa.array(bucket_of(grams).astype(np.int32))], ["gram", "bucket"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for own, grams, n in zip(batch.column("slice").to_pylist(), batch.column("grams"), batch.column("n")):
                if own != at and held:
                    yield often(held)
                    held = []
                at = own
                held.append((np.frombuffer(grams.as_buffer(), dtype=np.int32).reshape(k, -1), np.frombuffer(n.as_buffer(), dtype=kind)))
        if held:
            yield often(held)

    rows = shards.mapInArrow(tidied(met), "slice int, grams binary, n binary")
    return rows.repartition(slices_ // 2, "slice").sortWithinPartitions("slice").mapInArrow(tidied(add), "gram array<int>, bucket int")


def _tries(spark: SparkSession, grams: DataFrame, sizes: list[int], k: int, digits: int):
    """The broadcast tries by part, up to ``TOGETHER`` parts at a time."""
    full = [part for part, size in enumerate(sizes) if size]
    for i in range(0, len(full), TOGETHER):
        some = {}
        for part in full[i : i + TOGETHER]:
            own = grams.where(F.col("part") == part).orderBy("place").select("gram").toArrow().column("gram").combine_chunks()
            own = own.flatten().to_numpy().reshape(sizes[part], k)
            some[part] = spark.sparkContext.broadcast(DoubleArray(own, digits))
            del own
            give_back()
        yield some, i + TOGETHER >= len(full)


def _in_reach(ids: np.ndarray, marks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard without the words that no phrase of ``k`` words can hold, and its marks."""
    reach = np.zeros(len(ids) + 1, dtype=np.int32)
    at = positions(ids, marks, k)
    reach[at] += 1
    reach[at + k] -= 1  # positions differ
    ids = np.where(np.cumsum(reach[:-1]) > 0, ids, 0)
    kept = (ids > 0) | (np.append(0, ids[:-1]) > 0)  # one 0 between runs
    return ids[kept], (marks & (ids > 0))[kept]  # no phrase begins at a word that went


def accepting(shards: DataFrame, k: int, tries: dict, sizes: list[int], marked: bool, last: bool) -> DataFrame:
    """One pass with the tries of some parts: ``at, wide, counts`` of the accepting states over all positions of all shards.

    The blocks of a part follow those of the part before it.  With ``marked``, also the
    shards, with ``marks`` where a phrase of these parts or of earlier ones begins; in
    the last pass they are ``live`` for phrases of ``k + 1`` words, and no other words
    stay than those in reach of these.  A task holds one trie at a time.
    """
    names = ["ids", "live", "marks", "at", "wide", "counts"]

    def walked(some: list[tuple[np.ndarray, ...]], total: dict[int, np.ndarray]) -> None:
        """Adds to the counts and marks the shards."""
        ends = np.cumsum([len(ids) + 1 for ids, _, _ in some])  # a 0 behind each
        ids = np.zeros(ends[-1], dtype=np.int32)
        marks = np.zeros(ends[-1], dtype=bool)
        where, parts = [], []
        for i, (end, (own, live, before)) in enumerate(zip(ends, some)):
            first = end - len(own) - 1
            ids[first : end - 1], marks[first : end - 1] = own, before
            some[i] = ids[first : end - 1], live, marks[first : end - 1]  # what was read can go
            at = positions(own, live, k)
            where.append((first + at).astype(np.int32))
            if len(sizes) > 1:
                parts.append((bucket_of([own[at + i] for i in range(k)]) % len(sizes)).astype(np.int32 if len(sizes) > 1 << 16 else np.uint16))
        where = np.concatenate(where)
        parts = np.concatenate(parts) if parts else None
        for part, trie in tries.items():
            at, met = trie.value.walk(ids, where if parts is None else where[parts == part])
            if len(tries) > 1:
                _let_go(trie)
            total[part] += np.bincount(met, minlength=sizes[part]).astype(np.uint32)
            marks[at] = True

    def told(some: list[tuple[np.ndarray, ...]], total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        walked(some, total)
        for ids, live, marks in some:
            if marked and last:
                ids, live = _in_reach(ids, marks, k + 1)
            if marked and len(ids):
                row = [pa.array([x], pa.binary()) for x in (ids.tobytes(), np.packbits(live).tobytes(), None if last else np.packbits(marks).tobytes())]
                yield pa.RecordBatch.from_arrays([*row, pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {part: np.zeros(sizes[part], dtype=np.uint32) for part in tries}
        some, held = [], 0
        for shard in _arrays(batches):
            some.append(shard)
            held += len(shard[0])
            if held >= HELD:
                yield from told(some, total)
                some, held = [], 0
        if some:
            yield from told(some, total)
        for part, trie in tries.items():
            _let_go(trie)
            for block in _blocks(total[part], first_blocks(sizes)[part]):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.binary()) for _ in range(3)), *block.columns], names)

    return shards.mapInArrow(tidied(run), "ids binary, live binary, marks binary, at int, wide int, counts binary")


def first_blocks(sizes: list[int]) -> list[int]:
    """The first block of counts of every part."""
    blocks = [-(-size // BLOCK) for size in sizes]
    return [sum(blocks[:part]) for part in range(len(sizes))]


def frequent_phrases(shards: DataFrame, words: int, positions_: int, longest: int, least: int, per_part: int) -> DataFrame:
    """``gram, a`` of every phrase of 2 to ``longest`` words with ``a >= least`` occurrences."""
    spark = shards.sparkSession
    digits = digits_for(words)
    found: list[DataFrame] = []
    for k in range(2, longest + 1):
        grams, sizes = numbered(candidates(shards, k, words, positions_, least), ["gram"], "candidates", per_part, F.col("bucket"))
        starts = np.array(first_blocks(sizes))

        def told(first: int, total: np.ndarray, starts=starts) -> pa.RecordBatch:
            often = np.flatnonzero(total >= least)
            part = int(np.searchsorted(starts, first // BLOCK, side="right")) - 1
            columns = [pa.array(np.full(len(often), part, dtype=np.int32)), pa.array((first - BLOCK * int(starts[part]) + often).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(total[often])], ["part", "place", "a"])

        level = []
        for tries, last in _tries(spark, grams, sizes, k, digits):
            rows = accepting(shards, k, tries, sizes, k < longest, last)
            if k < longest:
                before, rows = shards, stored(rows, "phrase-shards")
                shards = rows.where(F.col("ids").isNotNull()).select("ids", "live", "marks")
            counts = summed(rows.where(F.col("at").isNotNull()).select("at", "wide", "counts"), BLOCK * len(tries) * -(-max(sizes) // BLOCK), told, "part int, place int, a long")
            level.append(stored(grams.where(F.col("part").isin(list(tries))).join(counts, ["part", "place"]).select("gram", "a"), "frequent"))
            for trie in tries.values():
                trie.unpersist()
            if k < longest:
                drop_stored(before)
        if not level:
            break
        found.append(reduce(DataFrame.unionByName, level))
        positions_ = found[-1].agg(F.sum("a")).first()[0] or 0  # a phrase of one word more begins at no other
    empty = spark.range(0).select(F.array(F.col("id").cast("int")).alias("gram"), F.col("id").alias("a"))  # without Python workers
    return reduce(DataFrame.unionByName, found, empty)


def first_of_each(rows: DataFrame, by: str, order: list, keep: int, total: int) -> DataFrame:
    """The first ``keep`` rows of each group with their ``rank``, never a whole group in one task.

    Rows are dealt over parts, whose first ones are dealt again until few are left.
    """
    parts = bit_parts(total, max(RANKED, 4 * keep))
    while parts > 1:
        inside = Window.partitionBy(by, "_part").orderBy(*order)
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns, F.lit(parts)), F.lit(parts)))
        rows = rows.withColumn("_place", F.row_number().over(inside)).where(F.col("_place") <= keep).drop("_part", "_place")
        parts = bit_parts(parts * keep, max(RANKED, 4 * keep))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= keep)


def collocations(
    docs: DataFrame,
    text: str = "text",
    group: str = "lang",
    no_group: str = "und",
    longest: int = 4,
    least: int = 30,
    scale: int = 2_000_000,
    covered: int = 80,
    keep: int = 2000,
    per_part: int = PART,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each group's best phrases.

    Texts are lower-cased A-Z, cut into pieces at ``.,;:!?`` and line ends and into
    words at blanks and tabs.  ``n`` counts all words of the group, ``a`` the
    occurrences of the phrase in pieces; it needs ``least`` of them.  Of its cuts
    into two parts with ``l`` and ``r`` occurrences the lowest
    ``floor(scale * a / (l + r))`` counts, the earliest of equal ones.  A phrase in
    a longer one with ``covered`` per cent of its occurrences drops out.  Null
    groups are ``no_group``, null and empty texts have no words, repeated rows
    count as often as they stand, and an empty table has no phrases.
    """
    bound_batches(docs.sparkSession)
    named = F.coalesce(F.col(group).cast("string"), F.lit(no_group))
    texts = docs.select(named.alias("group"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = stored(count_words(texts), "words")
    totals = counts.groupBy("group").agg(F.sum("n").alias("n"))
    vocabulary, sizes = numbered(counts.where(F.col("n") >= least), ["group", "word"], "vocabulary", per_part)
    offsets = F.array(*[F.lit(sum(sizes[:p]) + 1) for p in range(len(sizes))])
    words = stored(
        vocabulary.select((F.col("place") + F.get(offsets, F.col("part"))).cast("int").alias("id"), "group", F.decode("word", "UTF-8").alias("word"), "n"),
        "word-numbers",
    )
    shards = shards_of(texts, vocabulary, sizes)
    occurrences = words.agg(F.sum("n")).first()[0] or 0
    phrases = stored(frequent_phrases(shards, sum(sizes), occurrences, longest, least, per_part), "phrases")

    # cuts: the counts of both parts
    known = stored(words.select(F.array("id").alias("gram"), F.col("n").alias("a")).unionByName(phrases), "all-phrases")
    cut = F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("cut")
    cuts = phrases.select("gram", "a", cut)
    cuts = cuts.select("gram", "a", "cut", F.slice("gram", F.lit(1), F.col("cut")).alias("left"),
                       F.slice("gram", F.col("cut") + 1, F.size("gram") - F.col("cut")).alias("right"))
    cuts = cuts.join(known.select(F.col("gram").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("gram").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {scale}) DIV (CAST(l AS DECIMAL(20,0)) + r)")
    lowest = cuts.select("gram", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("c"))
    scored = lowest.groupBy("gram", "a").agg(F.min("c").alias("c"))

    # containment: the most frequent longer phrase around each
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("gram") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.size("gram") - k + 1), lambda i: F.slice("gram", i, k)),
    ))
    around = phrases.where(F.size("gram") > 2).select("a", F.explode(inner).alias("gram"))
    around = around.groupBy("gram").agg(F.max("a").alias("most"))
    kept = scored.join(around, "gram", "left").where(
        F.col("most").isNull() | (F.expr(f"CAST(most AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {covered}"))
    )

    # words back
    spelled = kept.select("gram", F.posexplode("gram").alias("at", "id")).join(words.select("id", "group", "word"), "id")
    spelled = spelled.groupBy("gram").agg(
        F.first("group").alias("lang"), F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase")
    )
    rows = kept.select("gram", "a", "c.l", "c.r", "c.score").join(spelled, "gram").select("lang", "phrase", "a", "l", "r", "score")
    rows = stored(rows, "scored-phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = first_of_each(rows, "lang", order, keep, rows.count())
    best = best.join(totals.select(F.col("group").alias("lang"), "n"), "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
