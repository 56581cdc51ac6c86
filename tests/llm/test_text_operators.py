"""Tokenizers, language ID and language-model scoring: libraries and brute force as reference."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe, elias_fano, langid, ngram_lm, queries, token_counts

public = pytest.importorskip("public_tokenizers")


def _odd_strings(n: int) -> list[str]:
    pick = random.Random(5)
    signs = [chr(c) for c in (*range(1, 0x250), *range(0x2000, 0x2070), *range(0x3000, 0x3060), *range(0x1F600, 0x1F640))]
    made = [
        "".join(pick.choice(signs) if pick.random() < 0.4 else pick.choice(" ab1'\n.esti\t") for _ in range(pick.randrange(120)))
        for _ in range(n)
    ]
    return ["", " ", "a  b", "\n\n a", "don't we'll 's", "<|endoftext|><s>", "▁▁ a ▁", "x" * 3000, " " * 40, "!?" * 60, *made]


@pytest.fixture(scope="module")
def reference_bpe():
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference_bpe):
    texts = _odd_strings(400)
    coded = bpe.encoder(*bpe.default_files()).encode(texts)
    assert [np.frombuffer(c, np.int32).tolist() for c in coded] == [reference_bpe.encode_ordinary(t) for t in texts]


def test_bpe_keeps_odd_rows_and_decodes(odd_docs, reference_bpe):
    rows = bpe.decode(bpe.encode(odd_docs), "ids", "decoded").collect()
    assert len(rows) == odd_docs.count() and set(rows[0].asDict()) == set(odd_docs.columns)
    for r in rows:
        assert r["ids"] == reference_bpe.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_of_an_empty_table(no_docs):
    assert bpe.decode(bpe.encode(no_docs), "ids").count() == 0


def test_bpe_query(spark, sf_dir, reference_bpe):
    got = {r["doc_id"]: r for r in queries.op3_byte_bpe(spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    for doc_id, text in texts:
        ids = reference_bpe.encode_ordinary(text)
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def reference_pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def test_prefix_counts_equal_the_library(reference_pieces):
    one = token_counts.counter(token_counts.default_file())
    for text in _odd_strings(300):
        assert one.count(text) == len(reference_pieces.encode(text))
    for text in _odd_strings(40):
        counts = one.at_every_prefix(text[:150])
        assert counts.tolist() == [len(reference_pieces.encode(text[:j])) for j in range(len(text[:150]) + 1)]


def test_budget_and_truncation(spark, reference_pieces):
    text = "Tokenizers cut texts into pieces, again and again."
    df = token_counts.prefix_counts(spark.createDataFrame([(text,), (None,)], "text string"))
    df = df.select("text", token_counts.longest_prefix("prefix_tokens", 5).alias("cut"),
                   token_counts.tokens_between("prefix_tokens", 10, 20).alias("between"))
    full, none = df.collect()
    size = lambda j: len(reference_pieces.encode(text[:j]))
    assert full["cut"] == max(j for j in range(len(text) + 1) if size(j) <= 5)
    assert full["between"] == size(20) - size(10) and none["cut"] == 0


def test_token_counts_of_odd_rows(odd_docs, no_docs, reference_pieces):
    got = token_counts.count_tokens(odd_docs, limit=50).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(reference_pieces.encode(r["text"] or ""))) for r in odd_docs.collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(want, key=key)
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in got)
    assert token_counts.count_tokens(no_docs).count() == 0


def test_token_count_query(spark, sf_dir, reference_pieces):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, sf_dir).collect()}
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        assert got[doc_id] == len(reference_pieces.encode(text))


# ------------------------------------------------------------- language ID
def _all_cuts(model: langid.PieceModel, word: str, lang: int) -> float:
    """The sum over all segmentations, one by one."""
    index = model.index()
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(model.longest, len(word)) + 1):
        at = index.get(word[:n], len(model.pieces) if n == 1 else None)
        if at is not None:
            total += model.weights[at, lang] * _all_cuts(model, word[n:], lang)
    return total


def test_long_runs_are_learnt_from_and_no_piece_is_left_out():
    weights = np.array([[1e-4, 0.1], [1e-5, 0.2], [1e-4, 0.3], [1e-6, 0.1], [1e-3, 0.1], [1e-5, 0.1], [1e-7, 0.1]])
    model = langid.PieceModel(["a", "ab", "b", "ba", "▁a", "▁ab"], ["x", "y"], weights)
    lengths = np.array([len(p) for p in model.pieces] + [1])
    for word in ("ab", "abba" * 10, "abba" * 400, "abq" * 100):  # the products of the third are below any double
        for lang in (0, 1):
            got = model.expected([word], np.array([3.0]), lang)
            assert np.isfinite(got).all() and got @ lengths == pytest.approx(3 * (len(word) + 1))
    pieces = langid.vocabulary_pieces()
    assert max(map(len, pieces)) > 8 and langid.PieceModel(pieces, ["x"], np.ones((len(pieces) + 1, 1))).longest == max(map(len, pieces))


def test_forward_sums_all_segmentations():
    weights = np.random.default_rng(3).random((7, 2))
    model = langid.PieceModel(["a", "ab", "b", "ba", "▁a", "▁ab"], ["x", "y"], weights)
    words = ["a", "ab", "abba", "bab", "zab", "a" * 9]
    want = [[math.log(_all_cuts(model, "▁" + w, k)) for k in range(2)] for w in words]
    assert np.allclose(model.score_words(words), want)
    assert np.isfinite(model.score_words(["ab" * 3000])).all()


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    rows = langid.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and set(rows[0].asDict()) == set(odd_docs.columns)
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en") and 0 <= r["lang_score"] <= 1
    nothing = langid.train(no_docs)
    assert nothing.langs == [] and {r["lang_pred"] for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_language_query_is_right_on_held_out_rows(spark, sf_dir):
    langs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect())
    rows = queries.op6_language_id(spark, sf_dir).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.97


# --------------------------------------------------------------- LM scoring
@pytest.mark.parametrize("n, top", [(0, 5), (1, 2**64 - 1), (5, 3), (900, 40), (900, 2**64 - 1), (20_000, 2**48)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, top, size=k, dtype=np.uint64, endpoint=True)
    values = np.sort(draw(n))
    coded = elias_fano.EliasFano(elias_fano.EliasFano.parts(values))
    assert (coded.access(np.arange(n)) == values).all()
    asked = np.concatenate([values[:200], draw(200), np.array([0, top], dtype=np.uint64)])
    assert (coded.successor(asked) == np.searchsorted(values, asked)).all()


def _brute_lm(train, docs, mu=20.0):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    words, pairs = collections.Counter(), collections.Counter()
    for t in train:
        w = tokens(t)
        words.update(w)
        pairs.update(zip(["start", *w[:-1]], w))
    n, z = sum(words.values()), sum(words.values()) + len(words) + 1
    out = []
    for t in docs:
        w, score = tokens(t), 0.0
        for a, b in zip(["start", *w[:-1]], w):
            seen = len(train) if a == "start" else words[a]
            score += math.log10((pairs[a, b] + mu * (words[b] + 1) / z) / (seen + mu))
        out.append((len(w), sum(words[x] > 0 for x in w), sum(math.log10((words[x] + 1) / z) for x in w), score, n))
    return out


@pytest.mark.parametrize("tokens_per_shard", [8_000_000, 3_000])
def test_lm_equals_brute_force(spark, sf_dir, tokens_per_shard, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 200").select("doc_id", "text")
    rows = docs.collect()
    shared, tries = ngram_lm.train(docs.where("doc_id % 4 <> 1"), tokens_per_shard=tokens_per_shard)
    assert (len(shared.hot) > 0) == (tokens_per_shard < 1_000_000)
    got = {r["doc_id"]: r for r in ngram_lm.score(docs, shared, tries).collect()}
    for row, want in zip(rows, _brute_lm([t for i, t in rows if i % 4 != 1], [t for _, t in rows])):
        r = got[row["doc_id"]]
        assert (r["n_tokens"], r["n_known"], shared.tokens) == (want[0], want[1], want[4])
        assert r["base_score"] == pytest.approx(want[2], rel=1e-9)
        assert r["score"] == pytest.approx(want[3], abs=2e-4 * want[0])  # 16-bit probabilities


def test_lm_of_odd_rows_and_windows(odd_docs, no_docs, monkeypatch):
    rows = odd_docs.select("doc_id", "text").collect()
    shared, tries = ngram_lm.train(odd_docs)
    got = sorted(map(tuple, ngram_lm.score(odd_docs, shared, tries).collect()), key=str)
    want = _brute_lm([t for _, t in rows], [t for _, t in rows])
    ordered = sorted([(i, w[0], w[1], w[2], w[3]) for (i, _), w in zip(rows, want)], key=str)
    assert [g[:3] for g in got] == [w[:3] for w in ordered]
    assert np.allclose([g[3] for g in got], [w[3] for w in ordered])
    assert all(abs(g[4] - w[4]) <= 2e-4 * w[1] for g, w in zip(got, ordered))  # 16-bit probabilities
    text = b"a b c d e f g"
    monkeypatch.setattr(ngram_lm, "WINDOW", 3)
    parts = list(ngram_lm.windows(text))
    assert [p[1:] for p in parts] == [[b"a", b"b", b"c"], [b"d", b"e", b"f"], [b"g", ngram_lm.END]] and parts[1][0] == b"c"


def _lm_rows(texts, keys, shards, hot):
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)), pa.int64())], ["text", "key"])
    for t, found in ngram_lm._flushes(iter([batch])):
        yield from (ngram_lm._record([m]) for m in ngram_lm._messages(t, np.array(found) if keys else None, shards, hot))


def test_lm_shards_are_merged_by_ranges_of_words(monkeypatch):
    rng, hot = np.random.default_rng(9), np.zeros(0, dtype=np.uint64)
    monkeypatch.setattr(ngram_lm, "FLUSH_TOKENS", 300)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 40) % 200) for _ in range(60)]
    shared = ngram_lm.Counts(60 * 41, 200, 1, {}, 20.0)
    found = []
    for most in (1_000_000, 37):
        monkeypatch.setattr(ngram_lm, "MERGED", most)
        found.append(ngram_lm._trie_of(list(ngram_lm._rows(_lm_rows(texts, False, 1, hot))), shared))
    assert found[0].keys() == found[1].keys() and all(np.array_equal(found[0][k], found[1][k]) for k in found[0])


def test_lm_holds_numbers_not_words():
    text = " ".join(f"w{i % 1000}" for i in range(1000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 1000)], ["text"])
    tracemalloc.start()
    tokens = sum(len(t.word) for t, _ in ngram_lm._flushes(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens == 1_001_000 and peak < 40 * tokens  # 50 and more as words


def test_lm_batches_are_bounded(spark, no_docs):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    ngram_lm.train(no_docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_lm_without_training_rows(odd_docs, no_docs):
    shared, tries = ngram_lm.train(no_docs)
    rows = ngram_lm.score(odd_docs, shared, tries).collect()
    assert shared.tokens == 0 and all(r["n_known"] == 0 and r["base_score"] == 0 for r in rows)
    assert ngram_lm.score(no_docs, shared, tries).count() == 0


def test_lm_predicts_better_than_words_alone(spark, sf_dir):
    rows = [r for r in queries.op10_lm_scoring(spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
