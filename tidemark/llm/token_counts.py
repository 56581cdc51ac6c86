"""Exact token counts at every prefix (operator 4).

The count of a prefix is one more than the count of a shorter prefix: the one
in front of its last token.  Going left to right, position ``j`` looks at the
vocabulary pieces that end there and takes the one, say ``t``, for which the
last token of the prefix before it and ``t`` stand side by side in an encoding,
that is, merging their joined letters gives exactly these two tokens.  There is
one such ``t``, because an encoding is valid just when all its neighbouring
pairs are, and each prefix has one encoding.  Whether two tokens may be
neighbours is found once and remembered.

The counts answer truncation (the longest prefix within a budget) and budget
questions (tokens between two cuts) by a search in the array; nothing is encoded
again.

No piece of the vocabulary has a space mark behind another letter, so tokens
never cross from a word to the next space; nor do they cross a letter that is in
no longer piece.  The dynamic programme therefore runs on chunks, whose counts a
worker keeps in a bounded table.  There is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import whole

MARK = "▁"
KEPT_CHUNKS = 1_200_000
LONGEST_KEPT = 64


class PrefixCounter:
    """Prefix counts for a sentencepiece BPE vocabulary with byte fallback."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        if any(MARK in piece.lstrip(MARK) for piece in scores):
            raise ValueError("a piece has a space mark inside: chunks would not be independent")
        letters = {c for piece in scores if len(piece) > 1 for c in piece}
        #: ASCII signs that stand in no longer piece end a chunk, as a line break does.
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in letters and chr(c) != " ")
        self.chunk = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+")
        self.kept = _Kept(self)
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.ends = self._ends()

    @classmethod
    def load(cls, path: str) -> PrefixCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: the best pair first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _ends(self) -> dict:
        """The longer pieces by their letters from the last to the first; "" holds the piece.

        A piece that its own letters do not merge to is never a token.
        """
        top: dict = {}
        for piece in self.scores:
            if len(piece) > 1 and self.merged(piece) == [piece]:
                node = top
                for letter in reversed(piece):
                    node = node.setdefault(letter, {})
                node[""] = piece
        return top

    def _beside(self, pair: tuple[str, str]) -> bool:
        if len(self.neighbours) > 2_000_000:
            self.neighbours.clear()
        known = self.neighbours[pair] = self.merged(pair[0] + pair[1]) == list(pair)
        return known

    def prefixes(self, chunk: str) -> list[int]:
        """Token count of the first j letters, for j from 0 to the length."""
        neighbours, beside, ends = self.neighbours, self._beside, self.ends
        last, counts = [""], [0]
        for j, letter in enumerate(chunk):
            node, i, token, count = ends.get(letter), j, letter, 0
            while node is not None and i:
                i -= 1
                node = node.get(chunk[i])
                if node is not None and (piece := node.get("")) is not None:
                    if not i or ((ok := neighbours.get(pair := (last[i], piece))) is None and beside(pair)) or ok:
                        token, count = piece, counts[i] + 1
                        break
            if not count:
                count = counts[j] + (1 if letter in self.scores else len(letter.encode()))
            last.append(token)
            counts.append(count)
        return counts

    def cut(self, text: str) -> list[str]:
        """The chunks of a text, behind the space mark that the library puts in front."""
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str) -> int:
        return sum(map(self.kept.__getitem__, self.cut(text)))

    def at_every_prefix(self, text: str) -> np.ndarray:
        """Counts for the first j characters of the text, j from 0 to its length."""
        if not text:
            return np.zeros(1, dtype=np.int32)
        out, total = [], 0
        for chunk in self.cut(text):
            counts = self.prefixes(chunk)
            out += [total + c for c in counts[1:]]
            total += counts[-1]
        out[0] = 0  # the mark in front belongs to no character: an empty prefix has no token
        return np.array(out, dtype=np.int32)


class _Kept(dict):
    """Count of a chunk; remembers short chunks up to a bound."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        count = self.counter.prefixes(chunk)[-1]
        if len(chunk) <= LONGEST_KEPT:
            if len(self) > KEPT_CHUNKS:
                self.clear()
            self[chunk] = count
        return count


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter.load(path)


def default_file() -> str:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def prefix_counts(docs: DataFrame, text: str = "text", out: str = "prefix_tokens", path: str | None = None) -> DataFrame:
    """Add ``out``: array<int> whose element j (from 0) is the token count of the first j characters.

    A null text counts as empty: ``[0]``.  A column named ``out`` is replaced.
    """
    path = path or default_file()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts):
        one = counter(path)
        return texts.map(lambda t: one.at_every_prefix(t or ""))

    return docs.withColumn(out, run(F.col(text)))


def tokens_between(prefix_tokens: str, start: int, end: int):
    """Budget question: tokens of the first ``end`` characters beyond those of the first ``start``."""
    return F.get(prefix_tokens, F.lit(end)) - F.get(prefix_tokens, F.lit(start))


def longest_prefix(prefix_tokens: str, budget: int):
    """Truncation: most characters from the start whose count is within the budget."""
    fits = F.filter(F.sequence(F.lit(0), F.size(prefix_tokens) - 1), lambda j: F.get(prefix_tokens, j) <= budget)
    return F.array_max(fits)


def count_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, path: str | None = None
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, from the count at the last prefix.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; other columns are not read.
    """
    path = path or default_file()
    schema = T.StructType(
        [docs.schema[doc_id], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = counter(path)
        for full in batches:
            for batch in _slices(full):
                texts = batch.column(1)
                counts = [one.count(t) for t in texts.to_pylist()]
                sizes = pc.binary_length(texts).cast(pa.int64())
                columns = [batch.column(0), sizes, pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [doc_id, "n_bytes", "n_tokens"])

    counted = docs.select(doc_id, whole(text).alias("__text")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
