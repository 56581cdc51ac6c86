"""Byte-level BPE encoding and decoding (operator 3).

A text is cut by the tokenizer's pattern and every piece is merged on its own.
The merges of a piece run on a segment tree over its byte positions: a leaf
holds the rank of the pair that starts there (the pair of two live neighbours),
an inner node the smallest rank below it, and the search for the next merge
goes down to the leftmost leaf with the root's rank.  A merge changes three
leaves - the merged pair, its left neighbour, and the position that disappears -
so it costs three logarithmic point updates.  Trees of short pieces of one
width are updated together with numpy; a longer piece has a tree of its own.

Pieces repeat, so a worker keeps a bounded table of what it has encoded.  There
is no shuffle: documents stay in the partition that read them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replace_column

#: White space as the tokenizer library's regular expressions define it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: A chunk is one white space with the word behind it, or white space before more of it; pieces never cross chunks.
CHUNK = re.compile(f"[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])")
NO_PAIR = np.int32(2**31 - 1)
WIDTHS = (8, 16, 32, 64)
KEPT_CHUNKS = 250_000
LONGEST_KEPT = 64


def piece_pattern(pattern: str) -> regex.Pattern:
    """The library's pattern with its white-space classes spelled out."""
    inside = pattern.replace(r"[^\s", f"[^{SPACE}")
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class ByteBPE:
    """Encoder for one rank file; ranks are token ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = piece_pattern(pattern)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.kept: dict[str, bytes] = {}
        self.kept_pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return cls(ranks, pattern)

    # ------------------------------------------------------------- merging
    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids, NO_PAIR where there is none."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(found, self.values[at], NO_PAIR)

    def merge_together(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pieces of at most ``width`` bytes (a power of two)."""
        n, depth, side = len(pieces), width.bit_length() - 1, width + 1
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
        ids = np.full((n, side), -1, dtype=np.int32)  # the last column stands for "no neighbour"
        live = np.arange(width) < sizes[:, None]
        ids[:, :width] = np.where(live, self.byte_ids[raw.reshape(n, width)], -1)
        after = np.tile(np.arange(1, side + 1, dtype=np.int32), (n, 1)).clip(max=width)
        after = np.where(after < sizes[:, None], after, width).astype(np.int32)
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), NO_PAIR, dtype=np.int32)
        tree[:, width : 2 * width - 1] = self._pair_ranks(ids[:, : width - 1], ids[:, 1:width])
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            below = tree[:, 2 * a : 4 * a]
            tree[:, a : 2 * a] = np.minimum(below[:, ::2], below[:, 1::2])
        ids1, after1, before1, tree1 = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()

        row = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while len(row):
            base, trunk = row * side, row * (2 * width)
            best = tree1[trunk + 1]
            node = np.ones(len(row), dtype=np.int64)
            for _ in range(depth):  # down to the leftmost leaf with the smallest rank
                node *= 2
                node += tree1[trunk + node] != best
            here = node - width
            gone = after1[base + here]
            then = after1[base + gone]
            ids1[base + here] = best
            ids1[base + gone] = -1
            after1[base + here] = then
            before1[base + then] = here  # harmless for the column that stands for none
            prior = before1[base + here]
            ids1[base + width] = -1
            tree1[trunk + width + here] = self._pair_ranks(best, ids1[base + then])
            tree1[trunk + width + gone] = NO_PAIR
            has = prior < width
            at = trunk[has] + width + prior[has]
            tree1[at] = self._pair_ranks(ids1[base[has] + prior[has]], best[has])
            touched = [here + width, gone.astype(np.int64) + width, np.where(has, prior, here) + width]
            for _ in range(depth):
                touched = [t >> 1 for t in touched]
                for t in touched:
                    low = trunk + 2 * t
                    tree1[trunk + t] = np.minimum(tree1[low], tree1[low + 1])
            row = row[tree1[trunk + 1] != NO_PAIR]
        kept = ids[:, :width] >= 0
        return np.split(ids[:, :width][kept], np.cumsum(kept.sum(1))[:-1])

    def merge_alone(self, piece: bytes) -> np.ndarray:
        """Token ids of one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none = int(NO_PAIR)
        ids = [int(self.byte_ids[b]) for b in piece]
        get = self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = get(ids[i] << 32 | ids[i + 1], none)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, rank: int) -> None:
            k = width + i
            tree[k] = rank
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] != none:
            best, k = tree[1], 1
            while k < width:
                k = 2 * k if tree[2 * k] == best else 2 * k + 1
            here = k - width
            gone = after[here]
            then = after[gone]
            ids[here], ids[gone], after[here] = best, -1, then
            put(gone, none)
            if then < n:
                before[then] = here
                put(here, get(best << 32 | ids[then], none))
            else:
                put(here, none)
            prior = before[here]
            if prior >= 0:
                put(prior, get(ids[prior] << 32 | best, none))
        return np.array([i for i in ids if i >= 0], dtype=np.int32)

    # ------------------------------------------------------------ interface
    def _encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        waiting: dict[int, list[tuple[str, bytes]]] = {w: [] for w in WIDTHS}
        for piece in pieces:
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                out[piece] = np.int32(whole).tobytes()
            elif len(data) <= WIDTHS[-1]:
                waiting[next(w for w in WIDTHS if len(data) <= w)].append((piece, data))
            else:
                out[piece] = self.merge_alone(data).tobytes()
        for width, found in waiting.items():
            for at in range(0, len(found), 8192):
                part = found[at : at + 8192]
                done = self.merge_together([d for _, d in part], width)
                out.update((p, ids.tobytes()) for (p, _), ids in zip(part, done))
        return out

    def forget(self) -> None:
        """Drop what was encoded so far."""
        self.kept, self.kept_pieces = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The int32 token ids of each text, as bytes."""
        if len(self.kept) > KEPT_CHUNKS:
            self.forget()
        cut = [CHUNK.findall(text) for text in texts]
        new = set().union(*cut) - self.kept.keys()
        parts = {c: self.split.findall(c) for c in new}
        pieces = set().union(*parts.values()) - self.kept_pieces.keys()
        done = self._encode_pieces(pieces)
        self.kept_pieces.update((p, ids) for p, ids in done.items() if len(p) <= LONGEST_KEPT)
        far = {p: ids for p, ids in done.items() if len(p) > LONGEST_KEPT}
        once: dict[str, bytes] = {}
        for chunk, split in parts.items():
            ids = b"".join(far[p] if p in far else self.kept_pieces[p] for p in split)
            (self.kept if len(chunk) <= LONGEST_KEPT else once)[chunk] = ids
        get = self.kept.__getitem__
        if not once:
            return [b"".join(map(get, chunks)) for chunks in cut]
        return [b"".join(once[c] if c in once else get(c) for c in chunks) for chunks in cut]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process and rank file."""
    return ByteBPE.load(path, pattern)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token id of a rank file."""
    with open(path, "rb") as file:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def default_files() -> tuple[str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def _slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes, one row at least."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, most)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _encoded(batches: Iterable[pa.RecordBatch], bpe: ByteBPE, text: str, out: str) -> Iterator[pa.RecordBatch]:
    """Batches with the ids of ``text``."""
    for whole in batches:
        for batch in _slices(whole):
            coded = bpe.encode([t or "" for t in batch.column(text).to_pylist()])
            ends = np.cumsum([0] + [len(c) // 4 for c in coded], dtype=np.int32)
            ids = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32))
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out])


def _decoded(batches: Iterable[pa.RecordBatch], tokens: list[bytes], ids: str, out: str) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes of ``ids``."""
    get = tokens.__getitem__
    for whole in batches:
        for batch in _slices(whole):
            lists = batch.column(ids)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            data = [b"".join(map(get, values[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
            column = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False), False)


def encode(
    docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Add ``out``, the token ids of the whole text, as array<int>.

    A null or empty text has no tokens.  Special tokens are not looked for.
    Other columns pass unchanged; one named ``out`` is replaced.  ``path`` is a
    rank file that every worker can open, as installed with its Python.
    """
    known = default_files()
    path, pattern = path or known[0], pattern or known[1]
    rest = replace_column(docs, out)
    schema = T.StructType([*rest.schema.fields, _ids_field(out)])
    return rest.mapInArrow(lambda batches: _encoded(batches, encoder(path, pattern), text, out), schema)


def decode(
    docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None
) -> DataFrame:
    """Add ``out``, the bytes that the ids stand for, as binary; null ids give no bytes."""
    path = path or default_files()[0]
    rest = replace_column(docs, out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.BinaryType(), False)])
    rest = rest.withColumn(ids, F.coalesce(ids, F.array().cast("array<int>")))
    return rest.mapInArrow(lambda batches: _decoded(batches, token_bytes(path), ids, out), schema)


def round_trip(
    docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """What ``decode`` of ``encode`` gives, by both steps in one worker a task instead of one worker a step.

    What was encoded is dropped behind a task, so a worker that waits for later stages is small.
    """
    known = default_files()
    path, pattern = path or known[0], pattern or known[1]
    rest = replace_column(replace_column(docs, ids), decoded)
    schema = T.StructType([*rest.schema.fields, _ids_field(ids), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        yield from _decoded(_encoded(batches, bpe, text, ids), token_bytes(path), ids, decoded)
        bpe.forget()

    return rest.mapInArrow(run, schema)
