"""Words of many texts at once, found on their UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of bytes: part of a word, between words, between words that do not belong together.
INSIDE, GAP, BREAK = 0, 1, 2
#: Bytes of text that are split at a time (one text at least).
SLICE = 4 << 20


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of every byte."""
    out = np.full(256, INSIDE, dtype=np.uint8)
    out[list(gaps)], out[list(breaks)] = GAP, BREAK
    return out


#: A-Z in lower case, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    texts = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - 1) // most
    cuts = [0, *(np.flatnonzero(part[1:] > part[:-1]) + 1), len(sizes)]
    for start, end in zip(cuts[:-1], cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


class Words:
    """The words of some texts in order, lower-cased A-Z.

    ``per_text`` counts the words of each text, ``starts_piece`` tells whether a
    word is the first of its text or behind a breaking byte.  Nulls are empty.
    """

    def __init__(self, texts: pa.Array, kind_of: np.ndarray):
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        raw = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = kind_of[LOWER[raw]]
        inside = kind == INSIDE
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        first = ends[:-1][ends[:-1] < ends[1:]]  # first byte of every text that has one
        start[first] = inside[first]
        at = np.flatnonzero(start)
        offsets = np.empty(len(at) + 1, dtype=np.int32)
        offsets[:-1] = np.cumsum(inside, dtype=np.int32)[at] - 1
        letters = LOWER[raw[inside]]
        offsets[-1] = len(letters)
        buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())]
        self.strings = pa.Array.from_buffers(pa.binary(), len(at), buffers)
        self.per_text = np.diff(np.searchsorted(at, ends))
        self.starts_piece = np.zeros(len(at), dtype=bool)
        if len(at):
            broken = np.cumsum(kind == BREAK, dtype=np.int32)[at]
            self.starts_piece[1:] = broken[1:] != broken[:-1]
            heads = np.cumsum(self.per_text) - self.per_text
            self.starts_piece[heads[self.per_text > 0]] = True

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        """For each word its place in the vocabulary (of bytes), counted from 1; 0 if it is not there."""
        coded = self.strings.dictionary_encode()
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1)
        return (np.asarray(found, dtype=np.int32) + 1)[np.asarray(coded.indices)]
