"""Elias-Fano coded monotone sequences and a two-level n-gram trie (for operator 10).

A sequence of ``n`` values below ``u`` keeps ``log2(u / n)`` low bits of each
value as they are, and the high parts as a bit vector with a one for each value
and a zero for each step of the high part: about ``2 + log2(u / n)`` bits a
value.  ``select`` on the bit vector gives access to value ``i`` and the run of
values that share a high part, in which the successor of a number is found.  All
operations work on arrays of queries.

The trie of a shard has as levels its words, and for each word the words seen in
front of it (its contexts).  Contexts are numbered within the shard; a word's
contexts are an ascending run of such numbers, made monotone over all words by
adding the end of the run before.  Pointers say where runs start.  Beside each
context stands its smoothed probability in 16 bits.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np

U64 = np.uint64
STEPS = tuple((U64(s), U64((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1))
ZERO, ONE, SIX, SEVEN = U64(0), U64(1), U64(6), U64(7)


class EliasFano:
    """A monotone sequence as three arrays."""

    def __init__(self, parts: Mapping[str, np.ndarray]):
        self.size, self.low_bits = (int(x) for x in parts["head"])
        self.low, self.high = parts["low"], parts["high"]
        # numbers of ones in front of each word of the bit vector
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self.view = np.ndarray((max(0, len(self.low) - 7),), dtype="<u8", buffer=self.low, strides=(1,))

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, ((top + 1) // max(n, 1)).bit_length() - 1))
        highs = (values >> U64(bits)).astype(np.int64)
        at = highs + np.arange(n, dtype=np.int64)
        length = (int(highs[-1]) if n else 0) + n + 2
        flags = np.zeros((length + 63) // 64 * 64, dtype=np.uint8)
        flags[at] = 1
        low = np.zeros((n * bits + 7) // 8 + 8, dtype=np.uint8)
        if bits:
            chunk = 1 << 17  # a multiple of eight, so that chunks end on bytes
            shifts = np.arange(bits, dtype=U64)
            for a in range(0, n, chunk):
                part = ((values[a : a + chunk, None] >> shifts) & ONE).astype(np.uint8)
                packed = np.packbits(part.ravel(), bitorder="little")
                low[a * bits // 8 : a * bits // 8 + len(packed)] = packed
        return {
            "head": np.array([n, bits], dtype=np.int64),
            "low": low,
            "high": np.packbits(flags, bitorder="little").view("<u8"),
        }

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the one (or zero) that has ``rank`` others in front."""
        front = self.ones if ones else self.zeros
        word = np.searchsorted(front, rank, side="right") - 1
        left = (rank - front[word]).astype(U64)
        bits = self.high[word] if ones else ~self.high[word]
        at = np.zeros(len(rank), dtype=np.int64)
        for step, mask in STEPS:
            count = np.bitwise_count(bits & mask).astype(U64)
            over = left >= count
            left = np.where(over, left - count, left)
            bits = np.where(over, bits >> step, bits)
            at += np.where(over, int(step), 0)
        return word * 64 + at

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=U64)
        bit = i.astype(U64) * U64(self.low_bits)
        return (self.view[(bit >> U64(3)).astype(np.int64)] >> (bit & SEVEN)) & U64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at these places."""
        if not len(i):
            return np.zeros(0, dtype=U64)
        high = (self._select(i, True) - i).astype(U64)
        return high << U64(self.low_bits) | self._lows(i)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first values that are at least ``x``, and whether they equal it."""
        if not self.size or not len(x):
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        x = x.astype(U64)
        high = (x >> U64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1  # high parts beyond the largest have no values
        beyond = high >= last
        high = np.where(beyond, 0, high)
        low = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = self._select(high, False) - high
        want = x & U64((1 << self.low_bits) - 1)
        stop = end.copy()
        while (open_ := low < stop).any():
            mid = (low + stop) >> 1
            less = open_ & (self._lows(np.minimum(mid, self.size - 1)) < want)
            low = np.where(less, mid + 1, low)
            stop = np.where(open_ & ~less, mid, stop)
        # a value of the same high part that equals in the low part is the same
        same = (low < end) & ~beyond & (self._lows(np.minimum(low, self.size - 1)) == want)
        return np.where(beyond, self.size, low), same

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Places of the first values that are at least ``x``; the size where there is none."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of the values equal to ``x``, -1 where there is none."""
        at, same = self._search(x)
        return np.where(same, at, -1)


class Trie:
    """Words and their contexts, read from the arrays of :meth:`build`."""

    def __init__(self, arrays: Mapping[str, np.ndarray]):
        part = lambda name: EliasFano({k: arrays[f"{name}.{k}"] for k in ("head", "low", "high")})
        self.words, self.contexts, self.counts = part("words"), part("contexts"), part("counts")
        self.pointers, self.pairs = part("pointers"), part("pairs")
        self.codes, (self.least, self.step) = arrays["codes"], arrays["scale"]

    @staticmethod
    def build(
        words: np.ndarray, counts: np.ndarray, runs: np.ndarray, contexts: np.ndarray, values: np.ndarray
    ) -> dict[str, np.ndarray]:
        """Arrays of a trie: sorted words with counts and numbers of contexts, then contexts sorted in each run."""
        least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (most - least) / 65535 or 1.0
        out = {"codes": np.round((values - least) / step).astype(np.uint16), "scale": np.array([least, step])}
        names = np.unique(contexts)
        ids = np.empty(len(contexts), dtype=np.int32)
        for at in range(0, len(ids), 1 << 19):
            ids[at : at + (1 << 19)] = np.searchsorted(names, contexts[at : at + (1 << 19)])
        starts = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
        last = ids[starts[1:] - 1].astype(np.int64) if len(runs) else np.zeros(0, dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(last + 1)[:-1]]) if len(runs) else last
        pairs = np.repeat(base, runs) + ids
        levels = {
            "words": words,
            "contexts": names,
            "counts": np.concatenate([[0], np.cumsum(counts)]),
            "pointers": starts,
            "pairs": pairs,
        }
        for name, sequence in levels.items():
            out |= {f"{name}.{k}": v for k, v in EliasFano.parts(sequence).items()}
        return out

    def count(self, word_at: np.ndarray) -> np.ndarray:
        """Counts of words at these places, 0 for place -1."""
        at = np.maximum(word_at, 0)
        if not self.words.size:
            return np.zeros(len(at), dtype=np.int64)
        held = self.counts.access(at + 1) - self.counts.access(at)
        return np.where(word_at >= 0, held.astype(np.int64), 0)

    def value(self, word_at: np.ndarray, runs: np.ndarray, context_at: np.ndarray) -> np.ndarray:
        """Values of pairs: words at these places, each with its run of contexts; NaN for pairs not in the trie."""
        out = np.full(len(context_at), np.nan)
        if not self.words.size:
            return out
        at = np.maximum(word_at, 0)
        start = self.pointers.access(at).astype(np.int64)
        end = self.pointers.access(at + 1).astype(np.int64)
        before = np.where(start > 0, self.pairs.access(np.maximum(start - 1, 0)).astype(np.int64) + 1, 0)
        rows = np.flatnonzero(np.repeat(word_at >= 0, runs) & (context_at >= 0))
        place, same = self.pairs._search((np.repeat(before, runs)[rows] + context_at[rows]).astype(U64))
        found = same & (place < np.repeat(end, runs)[rows])
        out[rows[found]] = self.least + self.step * self.codes[place[found]]
        return out


def to_bytes(arrays: Mapping[str, np.ndarray]) -> bytes:
    """All arrays in one block with a table of contents, each at a multiple of 8 bytes."""
    toc, body, at = {}, [], 0
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        toc[name] = [a.dtype.str, len(a), at]
        body.append(data.ljust(-len(data) % 8 + len(data), b"\0"))
        at += len(body[-1])
    head = json.dumps(toc).encode()
    head = head.ljust(-len(head) % 8 + len(head))
    return b"".join([np.int64(len(head)).tobytes(), head, *body])


def from_file(path: str) -> dict[str, np.ndarray]:
    """The arrays of a block, mapped into memory."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    size = int(raw[:8].view(np.int64)[0])
    toc = json.loads(bytes(raw[8 : 8 + size]))
    out = {}
    for name, (kind, n, at) in toc.items():
        dtype = np.dtype(kind)
        out[name] = raw[8 + size + at : 8 + size + at + n * dtype.itemsize].view(dtype)
    return out
