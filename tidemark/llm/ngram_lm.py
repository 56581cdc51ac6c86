"""Language-model scoring with Elias-Fano n-gram tries (operator 10).

The model is a word bigram with Dirichlet smoothing: for a token ``b`` behind ``a``

    P(b | a) = (c(ab) + mu * (c(b) + 1) / Z) / (c(a) + mu),   Z = N + V + 1,

which sums to one over all known words and one unknown.  The logarithm is a term
of the pair, with ``b``'s own count, less a term of ``a`` alone.  So a text's
score is a sum of terms, each known where the counts of one word ``b`` are: the
second term of ``a`` is added where ``a`` itself is the token.  (The end token
stands in for the start: both are counted once a document.)

Hence everything is cut into shards by the word: one shuffle brings the training
pairs of a shard together and a trie is built of them; another brings the tokens
to be scored to the trie, whose levels are mapped into memory.  Words so
frequent that they would fill a shard are spread over shards by what is in front
of them; there are at most ``N / (tokens_per_shard / 4)`` such words, and they
are found by counting all words first.

Tokens travel in bulk: a task sorts a few million tokens, and sends each shard
the distinct words, the distinct words in front of each (48 bits of their hash,
as they are only told apart behind one word), and the documents they stand in.
No task holds more than a few million tokens or one shard: words become numbers
as they are read, a shard's pairs are merged range by range of the words, and the
tokens to be scored are answered message by message, behind their trie.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

from .bpe import _slices
from .common import bit_parts, bound_batches, whole
from .elias_fano import Trie, from_file, to_bytes

#: No words: they contain a space.
END, START = b" end", b" start"
FLUSH_TOKENS, FLUSH_DOCS, WINDOW = 2_500_000, 60_000, 1_000_000
#: Pairs of a shard that are merged at a time.
MERGED = 500_000
MESSAGE = "shard int, flush long, model binary, keys binary, words binary, runs binary, contexts binary, counts binary, docs binary"
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def windows(text: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text between start and end; a very long one in parts that begin with the token before."""
    tokens = [START, *text.lower().split(), END]
    for at in range(0, len(tokens) - 1, WINDOW):
        yield tokens[at : at + WINDOW + 1]


class Tokens:
    """Tokens of some windows as numbers of a sorted vocabulary of hashes."""

    def __init__(self, met: dict[bytes, int], parts: list[np.ndarray]):
        """``met`` numbers the words, ``parts`` has the numbers of each window."""
        hashes = np.fromiter(map(word_hash, met), dtype=np.uint64, count=len(met))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        ids = place[np.concatenate(parts)]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        is_token = np.ones(len(ids), dtype=bool)
        is_token[np.cumsum(sizes) - sizes] = False  # what only stands in front of a token
        self.word, self.before = ids[is_token], ids[:-1][is_token[1:]]
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), sizes - 1)


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tokens, list]]:
    """Tokens of windows with the second column's value (if there is one), a few million tokens at a time."""
    met: dict[bytes, int] = defaultdict(count().__next__)  # numbers words as they come, one look-up a token
    parts: list[np.ndarray] = []
    keys: list = []
    held = 0
    for full in batches:
        for batch in _slices(full):
            values = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * batch.num_rows
            for text, key in zip(batch.column(0).cast(pa.binary()).to_pylist(), values):
                for part in windows(text):
                    parts.append(np.fromiter(map(met.__getitem__, part), dtype=np.int32, count=len(part)))
                    keys.append(key)
                    held += len(part)
                    if held > FLUSH_TOKENS or len(parts) >= FLUSH_DOCS:
                        done = Tokens(met, parts), keys
                        met, parts, keys, held = defaultdict(count().__next__), [], [], 0
                        yield done
    if parts:
        yield Tokens(met, parts), keys


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes * SPREAD >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    if not len(sorted_columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(sorted_columns[0]), dtype=bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: pa.Buffer) -> np.ndarray:
    out = np.zeros((data.size // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _messages(t: Tokens, keys: np.ndarray | None, shards: int, hot: np.ndarray) -> Iterator[dict[str, object]]:
    """The tokens of some documents, for each shard; with ``keys`` also where they stand."""
    code = t.word.astype(np.uint64)
    if keys is None:
        code <<= np.uint64(24)
        code |= t.before.astype(np.uint64)
        code.sort()
        first = _runs(code)
        n = np.diff(np.append(first, len(code)))
        code = code[first]
        word, before = (code >> np.uint64(24)).astype(np.int32), (code & np.uint64((1 << 24) - 1)).astype(np.int32)
        doc = None
    else:
        code <<= np.uint64(42)
        code |= t.before.astype(np.uint64) << np.uint64(20)
        code |= t.doc.astype(np.uint64)
        code.sort()
        word = (code >> np.uint64(42)).astype(np.int32)
        before = (code >> np.uint64(20) & np.uint64((1 << 22) - 1)).astype(np.int32)
        doc = (code & np.uint64((1 << 20) - 1)).astype(np.uint16)
        n = None
    del code
    by_word = _shard_of(t.hashes, shards)
    shard = by_word[word]
    is_hot = np.isin(t.hashes, hot)[word]
    if is_hot.any():
        mixed = t.hashes[word[is_hot]] ^ (t.hashes[before[is_hot]] * SPREAD)
        shard[is_hot] = _shard_of(mixed, shards)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    shard, word, before = shard[order], word[order], before[order]
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    flush = None if keys is None else xxhash.xxh64_intdigest(keys.tobytes()) >> 1
    for s in range(shards):
        a, b = bounds[s], bounds[s + 1]
        if a == b:
            continue
        w, c = word[a:b], before[a:b]
        pair = _runs(w, c)
        tokens = np.diff(np.append(pair, b - a)) if n is None else n[order[a:b]]
        w, c = w[pair], c[pair]
        first = _runs(w)
        out = {
            "shard": s,
            "words": t.hashes[w[first]].tobytes(),
            "runs": np.diff(np.append(first, len(w))).astype(np.uint32).tobytes(),
            "contexts": _six(t.hashes[c] >> np.uint64(16)),
            "counts": tokens.astype(np.uint32).tobytes(),
        }
        if doc is not None:
            mine = doc[order[a:b]]
            number = np.zeros(len(keys), dtype=np.int64)
            number[mine] = 1
            at = np.flatnonzero(number)
            number[at] = np.arange(len(at))
            out |= {"flush": flush, "keys": keys[at].tobytes(), "docs": number[mine].astype(np.uint16).tobytes()}
        yield out


def _record(rows: list[dict[str, object]]) -> pa.RecordBatch:
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * (len(names) - 2)
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)


def to_shards(rows: DataFrame, shards: int) -> DataFrame:
    """A shard is a partition."""
    return rows.repartitionById(shards, F.col("shard"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
    """Messages one by one, their arrays as buffers of the batch."""
    for batch in batches:
        columns = [(name, c, pa.types.is_binary(c.type)) for name, c in zip(batch.schema.names, batch.columns)]
        for i in range(batch.num_rows):
            yield {name: (c[i].as_buffer() if c[i].is_valid else None) if binary else c[i].as_py() for name, c, binary in columns}


def _by_shard(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    """Messages by shard; a partition holds one, or a few where there are more shards than partitions."""
    out: dict[int, list[dict]] = {}
    for row in _rows(batches):
        out.setdefault(row["shard"], []).append(row)
    return out


# ------------------------------------------------------------------ training
class Counts:
    """What all shards share: token and type counts, the number of shards, and the hot words."""

    def __init__(self, tokens: int, types: int, shards: int, hot: dict[int, int], mu: float):
        self.tokens, self.types, self.shards, self.mu = tokens, types, shards, mu
        self.z = tokens + types + 1
        names = sorted(hot)
        self.hot = np.array(names, dtype=np.uint64)
        self.hot_counts = np.array([hot[h] for h in names], dtype=np.int64)

    def of_words(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Counts in the whole corpus: a shard holds only a part of a hot word's."""
        if not len(self.hot):
            return counts
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, self.hot_counts[at], counts)


def count_words(docs: DataFrame, text: str, tokens_per_shard: int, mu: float) -> Counts:
    """Count every word of the training documents, and find the hot ones."""
    data = docs.select(whole(text).alias("__text"))
    size = data.agg(F.sum(F.octet_length("__text") / 6 + 1).alias("n")).first()["n"] or 0
    shards = bit_parts(int(size), tokens_per_shard)
    limit = tokens_per_shard // 4

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _flushes(batches):
            n = np.bincount(t.word, minlength=len(t.hashes))
            hashes, n = t.hashes[n > 0], n[n > 0].astype(np.uint32)  # not what only stands in front
            shard = _shard_of(hashes, shards)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            sent = [(s, order[a:b]) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
            yield _record([{"shard": s, "words": hashes[at].tobytes(), "counts": n[at].tobytes()} for s, at in sent])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches).values():
            words = np.concatenate([np.frombuffer(r["words"], dtype=np.uint64) for r in rows])
            n = np.concatenate([np.frombuffer(r["counts"], dtype=np.uint32) for r in rows]).astype(np.int64)
            words, at = np.unique(words, return_inverse=True)
            n = np.bincount(at, weights=n).astype(np.int64)
            big = n > limit
            hot, m = words[big].view(np.int64).tolist(), n[big].tolist()
            columns = [[None, *hot], [int(n.sum()), *m], [len(words), *[0] * len(m)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "n", "types"])

    sums = to_shards(data.mapInArrow(send, MESSAGE), shards).mapInArrow(add, "word long, n long, types long")
    found = sums.groupBy("word").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    totals = next((r for r in found if r["word"] is None), None)
    hot = {r["word"] % (1 << 64): r["n"] for r in found if r["word"] is not None}
    return Counts(totals["n"] if totals else 0, totals["types"] if totals else 0, shards, hot, mu)


def _merged(rows: list[dict], low: int, high: int) -> tuple[np.ndarray, ...]:
    """Words with hashes in ``[low, high)``, how many contexts each has, and the contexts with their counts."""
    words, contexts, n = [], [], []
    for r in rows:
        names, runs = np.frombuffer(r["words"], dtype=np.uint64), np.frombuffer(r["runs"], dtype=np.uint32)
        a, b = (int(np.searchsorted(names, np.uint64(x))) if x < 1 << 64 else len(names) for x in (low, high))
        start, end = int(runs[:a].sum(dtype=np.int64)), int(runs[:b].sum(dtype=np.int64))
        words.append(np.repeat(names[a:b], runs[a:b]))
        contexts.append(_from_six(r["contexts"][6 * start : 6 * end]))
        n.append(np.frombuffer(r["counts"], dtype=np.uint32)[start:end])
    word, context, n = np.concatenate(words), np.concatenate(contexts), np.concatenate(n)
    order = np.lexsort((context, word))
    word, context = word[order], context[order]
    first = _runs(word, context)
    n = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)
    word, context = word[first], context[first]
    start = _runs(word)
    return word[start], np.diff(np.append(start, len(word))), context, n


def _trie_of(rows: list[dict], shared: Counts) -> dict[str, np.ndarray]:
    """The arrays of a shard's trie; the pairs of its messages are merged some ranges of words after the other."""
    ranges = max(1, -(-sum(r["contexts"].size for r in rows) // (6 * MERGED)))
    bounds = [(i << 64) // ranges for i in range(ranges + 1)]
    parts = [_merged(rows, low, high) for low, high in zip(bounds[:-1], bounds[1:])]
    rows.clear()
    names, runs, contexts, n = (np.concatenate(x) for x in zip(*parts))
    del parts
    starts = np.cumsum(runs) - runs
    counts = shared.of_words(names, np.add.reduceat(n, starts) if len(starts) else n)
    values = np.log10(n + np.repeat(shared.mu * (counts + 1) / shared.z, runs))
    del n
    return Trie.build(names, counts, runs, contexts, values)


def train(
    docs: DataFrame, text: str = "text", mu: float = 20.0, tokens_per_shard: int = 8_000_000
) -> tuple[Counts, DataFrame]:
    """The shared counts, and a stored table ``shard, model`` with a trie for each shard.

    All words and pairs of all rows count; null texts are empty documents.
    """
    bound_batches(docs.sparkSession)
    shared = count_words(docs, text, tokens_per_shard, mu)
    data = docs.select(whole(text).alias("__text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _flushes(batches):
            for message in _messages(t, None, shared.shards, shared.hot):
                yield _record([message])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _by_shard(batches)
        for shard in list(found):
            blob = to_bytes(_trie_of(found.pop(shard), shared))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["shard", "model"]
            )

    sent = to_shards(data.mapInArrow(send, MESSAGE), shared.shards)
    return shared, stored(sent.mapInArrow(build, "shard int, model binary"), "lm-tries")


# ------------------------------------------------------------------- scoring
def _mapped(blob: pa.Buffer) -> Trie:
    """The trie of a block, mapped from a file of the task's own that has no name any more."""
    handle, path = tempfile.mkstemp(prefix="trie-")
    with os.fdopen(handle, "wb") as file:
        file.write(blob)
    trie = Trie(from_file(path))
    os.unlink(path)
    return trie


#: Sums over the tokens of a document; the last two are of doubles.
SUMS = (("tokens", np.int64), ("known", np.int64), ("base", np.float64), ("score", np.float64))


def _scored(row: dict, trie: Trie | None, shared: Counts) -> list[np.ndarray]:
    """Sums over one message's tokens, for each of its documents."""
    words = np.frombuffer(row["words"], dtype=np.uint64)
    runs = np.frombuffer(row["runs"], dtype=np.uint32)
    contexts, at = np.unique(_from_six(row["contexts"]), return_inverse=True)
    word_at = trie.words.find(words) if trie else np.full(len(words), -1)
    context_at = trie.contexts.find(contexts) if trie else np.full(len(contexts), -1)
    counts = shared.of_words(words, trie.count(word_at) if trie else np.zeros(len(words), dtype=np.int64))
    context_of_pair = context_at[at]
    value = trie.value(word_at, runs, context_of_pair) if trie else np.full(len(context_of_pair), np.nan)
    unseen, ahead = np.log10(shared.mu * (counts + 1) / shared.z), np.log10(counts + shared.mu)
    pair = np.where(np.isnan(value), np.repeat(unseen, runs), value) - np.repeat(ahead, runs)
    repeats = np.frombuffer(row["counts"], dtype=np.uint32)
    docs = np.frombuffer(row["docs"], dtype=np.uint16)
    n = row["keys"].size // 8
    of_token = np.repeat(np.repeat(np.arange(len(words)), runs), repeats)
    total = lambda w: np.bincount(docs, weights=w, minlength=n)
    base = np.log10((counts + 1) / shared.z)
    each = np.bincount(docs, minlength=n), total((counts > 0)[of_token]), total(base[of_token]), total(np.repeat(pair, repeats))
    return [x.astype(kind) for x, (_, kind) in zip(each, SUMS)]


def score(docs: DataFrame, shared: Counts, tries: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row.

    ``score`` is the model's log10 probability of the text with its end;
    ``base_score`` that of words by their counts alone, one added.  A null or
    empty text has one token, the end.  Rows that repeat id and text count each.
    """
    bound_batches(docs.sparkSession)
    key = F.xxhash64(F.col(doc_id), whole(text))
    data = docs.select(whole(text).alias("__text"), key.alias("key"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, keys in _flushes(batches):
            for message in _messages(t, np.array(keys, dtype=np.int64), shared.shards, shared.hot):
                yield _record([message])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trie = None, None
        for row in _rows(batches):  # the trie of a shard is its first row
            if row["shard"] != shard:
                shard, trie = row["shard"], None
            if row["model"] is not None:
                trie = _mapped(row["model"])
            else:
                data = [[row["keys"].to_pybytes()], *([x.tobytes()] for x in _scored(row, trie, shared))]
                columns = [pa.array([row["flush"]], pa.int64()), *(pa.array(d, pa.binary()) for d in data)]
                yield pa.RecordBatch.from_arrays(columns, ["flush", "key", *(name for name, _ in SUMS)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What all shards say of the documents of a flush, together."""
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            keys = np.concatenate([np.frombuffer(r["key"], dtype=np.int64) for r in rows])
            keys, at = np.unique(keys, return_inverse=True)
            columns = [pa.array(keys)]
            for name, kind in SUMS:
                parts = np.concatenate([np.frombuffer(r[name], dtype=kind) for r in rows])
                columns.append(pa.array(np.bincount(at, weights=parts).astype(kind)))
            yield pa.RecordBatch.from_arrays(columns, ["key", *(name for name, _ in SUMS)])

    sent = data.mapInArrow(send, MESSAGE).unionByName(tries, allowMissingColumns=True)
    ordered = to_shards(sent, shared.shards).sortWithinPartitions("shard", F.col("model").isNull())
    answers = ordered.mapInArrow(
        answer, "flush long, key binary, tokens binary, known binary, base binary, score binary"
    )
    answers = answers.repartition(shared.shards, "flush").mapInArrow(
        add, "key long, tokens long, known long, base double, score double"
    )
    sums = answers.groupBy("key").agg(*[F.sum(name).alias(name) for name, _ in SUMS])
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    sums = sums.join(copies, "key")
    share = lambda c: F.col(c) / F.col("copies")
    return rows.join(sums, "key").select(
        "doc_id",
        share("tokens").cast("long").alias("n_tokens"),
        share("known").cast("long").alias("n_known"),
        share("base").alias("base_score"),
        share("score").alias("score"),
    )


