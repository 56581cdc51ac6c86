"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 12).

A window is ``size`` consecutive words of a benchmark item (all words of a
shorter item).  Texts are searched for all windows at once, with words as the
signs of the alphabet:

* *shift table*: the block of the last two words in front of the search position
  tells how far the position may move without passing the end of any window;
* *suffix buckets*: where it may not move, the windows that end in this block,
  and begin with the words where one would have to begin, are taken;
* *comparison*: they are compared word by word.

Words are numbered by the words of the windows, so equal numbers are equal words.
Windows of each length have tables of their own.  A batch of texts is searched in
many short lanes of positions, all of which move at once with numpy.

The windows are broadcast in parts of at most ``words_per_part`` item words; each
part is one pass over the texts, which adds to the places and items found.  Usual
benchmarks are one part.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored

from .common import bit_parts
from .words import Words, kinds, slices

#: Words are made of letters, digits and everything beyond ASCII.
SIGNS = kinds(bytes(b for b in range(128) if not chr(b).isalnum()))
#: What separates words in SQL.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Positions of a lane, and pairs of position and window that are compared at a time.
LANE, PAIRS = 64, 1 << 19


class WindowTable:
    """Shift table and suffix buckets of different windows of one length, rows of word numbers."""

    def __init__(self, windows: np.ndarray, words: int):
        self.windows, (n, self.length) = windows, windows.shape
        self.block = min(2, self.length)
        self.words = words + 1
        self.bits = max(10, int(2 * n * self.length).bit_length())
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, dtype=np.int16 if self.length < 1 << 15 else np.int32)
        for end in range(self.block, self.length + 1):
            slots = self.slot(self.code(windows, end - 1))
            self.shift[slots] = np.minimum(self.shift[slots], self.length - end)
        suffix, prefix = self.code(windows, self.length - 1), self.code(windows, self.block - 1)
        self.suffixes, s = np.unique(suffix, return_inverse=True)
        self.prefixes, p = np.unique(prefix, return_inverse=True)
        bucket = s * len(self.prefixes) + p
        self.order = np.argsort(bucket, kind="stable")
        self.buckets = bucket[self.order]

    def code(self, rows: np.ndarray, last: int | np.ndarray) -> np.ndarray:
        """A number for the block that ends at ``last`` (in each row of a matrix, or of a text)."""
        pick = (lambda i: rows[:, i]) if rows.ndim == 2 else (lambda i: rows[i])
        out = pick(last).astype(np.int64)
        return out + self.words * pick(last - 1).astype(np.int64) if self.block == 2 else out

    def slot(self, code: np.ndarray) -> np.ndarray:
        mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ends(self, text: np.ndarray) -> np.ndarray:
        """Positions whose block ends some window: where the shift is nought."""
        at = np.arange(self.length - 1, len(text), LANE)
        stop = np.minimum(at + LANE, len(text))
        out = []
        while len(at):
            move = self.shift[self.slot(self.code(text, at))]
            out.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(out) if out else np.empty(0, dtype=np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place of every occurrence in the text, and the window's number."""
        ends = self.ends(text)
        starts = ends - self.length + 1
        suffix, prefix = self.code(text, ends), self.code(text, starts + self.block - 1)
        s, p = (np.minimum(np.searchsorted(all_of, x), len(all_of) - 1) for all_of, x in ((self.suffixes, suffix), (self.prefixes, prefix)))
        live = (self.suffixes[s] == suffix) & (self.prefixes[p] == prefix)
        starts, bucket = starts[live], (s * len(self.prefixes) + p)[live]
        first = np.searchsorted(self.buckets, bucket)
        sizes = np.searchsorted(self.buckets, bucket, "right") - first
        starts, first, sizes = starts[sizes > 0], first[sizes > 0], sizes[sizes > 0]
        places, numbers = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        done = np.cumsum(sizes)
        total = int(done[-1]) if len(done) else 0
        for at in range(0, total, PAIRS):  # pairs of a place and a window of its bucket, some at a time
            pair = np.arange(at, min(at + PAIRS, total))
            row = np.searchsorted(done, pair, "right")
            window = self.order[first[row] + pair - (done[row] - sizes[row])]
            place = starts[row]
            for i in range(self.length):
                same = text[place + i] == self.windows[window, i]
                place, window = place[same], window[same]
            places.append(place)
            numbers.append(window)
        return np.concatenate(places), np.concatenate(numbers)


class Windows:
    """All windows of a part of the benchmark, by length, and the items that hold each."""

    def __init__(self, pieces: Sequence[tuple[str, str]], size: int):
        """``pieces`` are ``(item, words joined by a space)``."""
        split = [(item, words.split(" ")) for item, words in pieces]
        self.vocabulary = sorted({w for _, words in split for w in words})
        number = {w: i for i, w in enumerate(self.vocabulary, 1)}
        by_length: dict[int, dict[bytes, set[str]]] = {}
        for item, words in split:
            coded = np.array([number[w] for w in words], dtype=np.int32)
            length = min(size, len(words))
            for at in range(len(words) - length + 1):
                by_length.setdefault(length, {}).setdefault(coded[at : at + length].tobytes(), set()).add(item)
        self.tables, self.items = [], sorted({item for item, _ in split})
        place = {item: i for i, item in enumerate(self.items)}
        for length, held in sorted(by_length.items()):
            rows = np.frombuffer(b"".join(held), dtype=np.int32).reshape(len(held), length)
            ends = np.cumsum([0] + [len(x) for x in held.values()])
            members = np.array([place[i] for x in held.values() for i in sorted(x)], dtype=np.int64)
            self.tables.append((WindowTable(rows, len(number)), ends, members))

    def search(self, texts: pa.Array, before: list | None) -> tuple[np.ndarray, list, list]:
        """For each text its number of words, the ranges ``[start, end]`` of hit words, and the items' numbers."""
        words = Words(texts, SIGNS)
        n = words.per_text
        coded = words.numbers(pa.array([w.encode() for w in self.vocabulary], pa.binary()))
        # a sign that is no word between texts: no window reaches over it
        offset = np.cumsum(n) - n + np.arange(len(n))
        text = np.zeros(len(coded) + len(n), dtype=np.int32)
        text[np.arange(len(coded)) + np.repeat(np.arange(len(n)), n)] = coded
        depth = np.zeros(len(text) + 1, dtype=np.int32)
        for row, ranges in enumerate(before or []):
            for start, end in ranges or ():
                depth[offset[row] + start] += 1
                depth[offset[row] + end + 1] -= 1
        pairs = [np.empty((0, 2), dtype=np.int64)]
        for table, ends, members in self.tables:
            places, windows = table.find(text)
            np.add.at(depth, places, 1)
            np.add.at(depth, places + table.length, -1)
            row = np.searchsorted(offset, places, "right") - 1
            met = np.unique(np.column_stack([row, windows]), axis=0)
            sizes = ends[met[:, 1] + 1] - ends[met[:, 1]]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            item = members[np.repeat(ends[met[:, 1]], sizes) + within]
            pairs.append(np.unique(np.column_stack([np.repeat(met[:, 0], sizes), item]), axis=0))
        hit = np.cumsum(depth[:-1]) > 0
        edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        starts, stops = edge[::2], edge[1::2] - 1
        row = np.searchsorted(offset, starts, "right") - 1
        ranges = [[] for _ in n]
        for r, a, b in zip(row.tolist(), (starts - offset[row]).tolist(), (stops - offset[row]).tolist()):
            ranges[r].append([a, b])
        items = [[] for _ in n]
        for r, i in np.unique(np.concatenate(pairs), axis=0).tolist():
            items[r].append(i)
        return n, ranges, items


def item_pieces(benchmark: DataFrame, item_id: str, text: str, size: int, longest: int) -> DataFrame:
    """``item, words, n``: the items' words, long items in overlapping pieces that lose no window."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, GAPS), lambda w: w != "")
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    cut = F.explode(F.sequence(F.lit(0), last, F.lit(longest)))
    rows = rows.select("item", "w", cut.alias("at")).select("item", F.slice("w", F.col("at") + 1, longest + size - 1).alias("w"))
    return rows.select("item", F.array_join("w", " ").alias("words"), F.size("w").alias("n")).distinct()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: Sequence[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    words_per_part: int = 1 << 20,
    words_per_piece: int = 1 << 14,
) -> DataFrame:
    """``carry`` and ``n_words``, ``hits`` (ranges of hit words, both ends included) and ``items`` (sorted ids as text).

    One row per document.  Null and empty texts have no words; items without words
    have no windows; rows that repeat an item id are one item, a null id counts
    as an empty one.  An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    pieces = stored(item_pieces(benchmark, item_id, item_text, size, words_per_piece), "benchmark-words")
    parts = bit_parts(pieces.agg(F.sum("n")).first()[0] or 0, words_per_part)
    found = docs.select(F.struct(*carry).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([found.schema["doc"], found.schema["text"]])
    for name, kind in (("n_words", "bigint"), ("hits", "array<array<int>>"), ("items", "array<string>")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
        found = found.withColumn(name, F.lit(None).cast(kind))

    for part in range(parts):
        mine = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(Windows([(r["item"], r["words"]) for r in mine.collect()], size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    n, ranges, items = windows.search(batch.column("text"), batch.column("hits").to_pylist())
                    earlier = batch.column("items").to_pylist()
                    names = [sorted({*(e or ()), *(windows.items[i] for i in own)}) for e, own in zip(earlier, items)]
                    new = [pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int32()))), pa.array(names, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), *new], ["doc", "text", "n_words", "hits", "items"])

        found = found.mapInArrow(run, schema)
        if part + 1 < parts:
            found = stored(found, "searched")  # one part of the windows in memory at a time
    return found.select("doc.*", "n_words", "hits", "items")
