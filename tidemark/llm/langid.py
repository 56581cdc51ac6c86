"""Language ID with segmentation-marginalised unigrams (operator 6).

The pieces of a fixed public vocabulary have a probability in each language.  A
word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities.  A forward pass gives it: the weight of a prefix
is the sum over its last pieces of the weight before the piece times the piece.
A text's score is the product over its words.  The language with the largest
wins.

Learning is expectation-maximisation on word counts of a bounded sample of
labelled rows (``docs_per_lang``, drawn by hash): forward and backward passes
give each piece's expected count in each language, Spark adds them up.  Word
counts and expected counts are distributed; the driver sees one row a piece of
the vocabulary and language.

Prediction has no shuffle.  A worker keeps the scores of words it has met in a
table of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored

from .bpe import _slices
from .common import replace_column

UNDETERMINED = "und"
START = "▁"
KEPT_WORDS = 300_000
#: Letters of words of one language and length whose pieces are counted together.
GROUP_LETTERS = 50_000
WORDISH = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> Iterator[str]:
    """Lower-cased runs of letters."""
    for run in WORDISH.findall(text.lower()):
        if run.isalpha():
            yield run
        else:  # numerals that are no digits
            yield from "".join(c if c.isalpha() else " " for c in run).split()


def vocabulary_pieces(path: str | None = None) -> list[str]:
    """Pieces of letters, lower case, with or without the mark of a word's start."""
    import public_tokenizers as public
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public.path("piece_bpe_32k.model"))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    keep = {p for p in pieces if (b := p.removeprefix(START)).isalpha() and b == b.lower()}
    return sorted(keep)


@dataclass
class PieceModel:
    """Probabilities of pieces, ``weights[piece, language]``; the last row stands for unknown letters."""

    pieces: list[str]
    langs: list[str]
    weights: np.ndarray
    _index: dict[str, int] = field(default_factory=dict)
    _steps: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
    _kept: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __getstate__(self):
        return {"pieces": self.pieces, "langs": self.langs, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def index(self) -> dict[str, int]:
        """The number of each piece, -1 for what is only the end of a piece."""
        if not self._index:
            self._index = {p[i:]: -1 for p in self.pieces for i in range(1, len(p))}
            self._index.update((p, i) for i, p in enumerate(self.pieces))
        return self._index

    @property
    def longest(self) -> int:
        """Letters of the longest piece, the mark of a start included."""
        return max(map(len, self.pieces), default=1)

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of pieces as a trie read backwards: its letters, sorted (state, letter) keys, the state each leads to, and a state's piece."""
        if self._steps is None:
            numbers = self.index()
            ends = sorted(numbers, key=len)
            state = {"": 0, **{end: i + 1 for i, end in enumerate(ends)}}
            letters = np.unique([ord(end[0]) for end in ends]).astype(np.int64)
            codes = np.searchsorted(letters, [ord(end[0]) for end in ends])
            keys = np.array([state[end[1:]] for end in ends], dtype=np.int64) * len(letters) + codes
            order = np.argsort(keys)
            self._steps = letters, keys[order], order + 1, np.array([-1, *map(numbers.get, ends)], dtype=np.int32)
        return self._steps

    def cut(self, words: list[str]) -> np.ndarray:
        """Piece numbers ``[word, end, length - 1]`` of words of one length; -1 where there is no piece."""
        size, longest = len(words[0]), self.longest
        out = np.full((len(words), size, longest), -1, dtype=np.int32)
        out[:, :, 0] = len(self.pieces)
        letters, keys, target, number = self.steps()
        if not len(keys):
            return out
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        code = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
        code[letters[code] != text] = -1
        code = code.reshape(len(words), size)
        # all ends of all words at once, one letter further back a level
        row, end = np.divmod(np.arange(len(words) * size), size)
        state = np.zeros(len(row), dtype=np.int64)
        for length in range(1, min(longest, size) + 1):
            inside = end >= length - 1
            row, end, state = row[inside], end[inside], state[inside]
            letter = code[row, end - length + 1]
            sought = state * len(letters) + letter
            at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            alive = (letter >= 0) & (keys[at] == sought)
            row, end, state = row[alive], end[alive], target[at[alive]]
            piece = number[state]
            some = piece >= 0
            out[row[some], end[some], length - 1] = piece[some]
        return out

    def forward(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all prefixes ``[end, word, language]`` and their common log scale ``[end, word]``."""
        n, size = found.shape[:2]
        padded = np.vstack([self.weights, np.zeros((1, len(self.langs)))])
        alpha = np.zeros((size + 1, n, len(self.langs)))
        scale = np.zeros((size + 1, n))
        alpha[0] = 1
        scaled = False
        for end in range(1, size + 1):
            scale[end] = scale[end - 1]
            for length in range(1, min(found.shape[2], end) + 1):
                before, piece = end - length, found[:, end - 1, length - 1]
                some = np.flatnonzero(piece >= 0)
                if not len(some):
                    continue
                if 2 * len(some) > n:
                    some = slice(None)
                step = alpha[before, some] * padded[piece[some]]
                if scaled:
                    step *= np.exp(scale[before, some] - scale[end, some])[:, None]
                alpha[end, some] += step
            top = alpha[end].max(1)
            low = (top < 1e-100) & (top > 0)
            if low.any():  # keeps the products of long words within range
                alpha[end][low] /= top[low, None]
                scale[end][low] += np.log(top[low])
                scaled = True
        return alpha, scale

    def score_words(self, words: list[str]) -> np.ndarray:
        """log probability ``[word, language]`` of words."""
        out = np.empty((len(words), len(self.langs)), dtype=np.float64)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w) + 1, []).append(i)
        for size, rows in by_size.items():
            step = max(1, 200_000 // size)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                alpha, scale = self.forward(self.cut([START + words[i] for i in part]))
                out[part] = np.log(alpha[-1]) + scale[-1][:, None]
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log probability ``[text, language]`` and the number of words."""
        if self._scores is None or len(self._kept) > KEPT_WORDS:
            self._kept, self._scores = {}, np.zeros((0, len(self.langs)))
        runs = [list(letter_runs(t)) for t in texts]
        new = list(set().union(*runs) - self._kept.keys()) if runs else []
        if new:
            self._kept.update(zip(new, range(len(self._kept), len(self._kept) + len(new))))
            self._scores = np.vstack([self._scores, self.score_words(new)])
        get = self._kept.__getitem__
        out = np.zeros((len(texts), len(self.langs)))
        for i, words in enumerate(runs):
            if words:
                out[i] = self._scores[np.fromiter(map(get, words), dtype=np.int64, count=len(words))].sum(0)
        return out, np.array([len(w) for w in runs], dtype=np.int64)

    def expected(self, words: list[str], counts: np.ndarray, lang: int) -> np.ndarray:
        """Expected count of each piece in these words of one language and one length."""
        found = self.cut([START + w for w in words])
        n, size, longest = found.shape
        weights = self.weights[:, lang]
        arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
        for end in range(1, size + 1):
            for length in range(1, min(longest, end) + 1):
                piece = found[:, end - 1, length - 1]
                some = np.flatnonzero(piece >= 0)
                if len(some):
                    arcs[end].append((end - length, some, piece[some]))
        alpha, beta = np.zeros((size + 1, n)), np.zeros((size + 1, n))
        # common log scales of a place, as products of long words leave the range of doubles
        up, down = np.zeros((size + 1, n)), np.zeros((size + 1, n))
        alpha[0], beta[size] = 1, 1
        scaled = False
        for end in range(1, size + 1):
            up[end] = up[end - 1]
            for before, some, piece in arcs[end]:
                step = alpha[before, some] * weights[piece]
                if scaled:
                    step *= np.exp(up[before, some] - up[end, some])
                alpha[end, some] += step
            scaled |= _rescale(alpha[end], up[end])
        ways: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
        for end in range(1, size + 1):
            for before, some, piece in arcs[end]:
                ways[before].append((end, some, piece))
        scaled_down = False
        for start in range(size - 1, -1, -1):
            down[start] = down[start + 1]
            for behind, some, piece in ways[start]:
                step = beta[behind, some] * weights[piece]
                if scaled_down:
                    step *= np.exp(down[behind, some] - down[start, some])
                beta[start, some] += step
            scaled_down |= _rescale(beta[start], down[start])
        share = counts / np.where(alpha[size] > 0, alpha[size], 1)
        parts, pieces = [np.zeros(0)], [np.zeros(0, dtype=np.int32)]
        for end in range(1, size + 1):
            for before, some, piece in arcs[end]:
                part = share[some] * alpha[before, some] * weights[piece] * beta[end, some]
                if scaled or scaled_down:
                    part *= np.exp(up[before, some] + down[end, some] - up[size, some])
                parts.append(part)
                pieces.append(piece)
        return np.bincount(np.concatenate(pieces), np.concatenate(parts), len(weights))


def _rescale(weights: np.ndarray, scale: np.ndarray) -> bool:
    """Move very small weights of a place into its log scale; whether there were any."""
    low = (weights < 1e-100) & (weights > 0)
    if not low.any():
        return False
    scale[low] += np.log(weights[low])
    weights[low] = 1
    return True


# ------------------------------------------------------------------ learning
def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_per_lang: int = 1500,
    rounds: int = 3,
    smoothing: float = 0.05,
    vocabulary: str | None = None,
) -> PieceModel:
    """Learn from rows whose text and language are known; about ``docs_per_lang`` of each language at most.

    Without such rows the model has no language and finds all texts undetermined.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs, pieces = sorted(sizes), vocabulary_pieces(vocabulary)
    model = PieceModel(pieces, langs, np.full((len(pieces) + 1, len(langs)), 1 / (len(pieces) + 1)))
    if not langs:
        return model
    luck = F.pmod(F.xxhash64(doc_id, F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.coalesce(*[F.when(F.col(lang) == x, F.lit(min(1.0, docs_per_lang / n))) for x, n in sizes.items()])
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        for batch in batches:
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(number[x], Counter()).update(letter_runs(t))
        for at, words in counts.items():
            names = list(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(list(words.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    words = known.where(luck < share).select(lang, text).mapInArrow(count, "lang int, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            totals = np.zeros_like(model.weights)
            groups: dict[tuple[int, int], list[tuple[str, int]]] = {}

            def add(x: int, found: list[tuple[str, int]]) -> None:
                totals[:, x] += model.expected([w for w, _ in found], np.array([n for _, n in found], float), x)

            for batch in batches:
                for x, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                    found = groups.setdefault((x, len(w)), [])
                    found.append((w, n))
                    if len(found) * len(w) >= GROUP_LETTERS:
                        add(x, groups.pop((x, len(w))))
            for (x, _), found in groups.items():
                add(x, found)
            at, x = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(totals[at, x])], ["piece", "lang", "n"]
            )

        rows = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        weights = np.full(model.weights.shape, smoothing)
        for r in rows.collect():
            weights[r["piece"], r["lang"]] += r["n"]
        model = PieceModel(pieces, langs, weights / weights.sum(0))
    return model


# ---------------------------------------------------------------- prediction
def predict(
    docs: DataFrame, model: PieceModel, text: str = "text", pred: str = "lang_pred", score: str = "lang_score"
) -> DataFrame:
    """Add the predicted language of the whole text and its posterior probability (uniform prior).

    A null text or one without letters is ``und`` with score 0, and so is every
    text of a model without languages.  Equal scores go to the first language by
    name.  Columns named ``pred`` or ``score`` are replaced.
    """
    rest = replace_column(replace_column(docs, pred), score)
    schema = T.StructType([*rest.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for batch in _slices(full):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                langs, sure = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if model.langs:
                    logs, words = model.score(texts)
                    best = logs.argmax(1)
                    rows = np.arange(len(texts))
                    sure = np.where(words > 0, 1 / np.exp(logs - logs[rows, best][:, None]).sum(1), 0.0)
                    langs = [model.langs[b] if n else UNDETERMINED for b, n in zip(best.tolist(), words.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(langs, pa.string()), pa.array(sure)], [*batch.schema.names, pred, score]
                )

    return rest.mapInArrow(run, schema)
