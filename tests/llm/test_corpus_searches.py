"""Phrases, benchmark windows and hard negatives against their definitions."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest

from __spark_entry__ import oracle_sql
from tests.compare import compare, connect
from tidemark.llm import decontaminate, negatives, phrases, queries
from tidemark.llm.trie import DoubleArray, digits_for


@pytest.mark.parametrize("name", ["op11_phrases", "op12_decontamination", "op13_hard_negatives"])
def test_equals_sql(name, spark, sf_dir):
    error, rows, _ = compare(spark, connect(sf_dir), queries.queries()[name], oracle_sql()[name], sf_dir)
    assert not error and rows > 0


def _lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# ------------------------------------------------------------------- phrases
@pytest.mark.parametrize("n, k, largest", [(0, 2, 5), (1, 2, 5), (400, 2, 30), (3000, 3, 100), (5000, 4, 70_000)])
def test_double_array_finds_all_keys(n, k, largest):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(1, largest + 1, (n, k)), axis=0).astype(np.int32).reshape(-1, k)
    trie = DoubleArray(keys, digits_for(largest))
    text = np.concatenate([rng.integers(0, largest + 1, 500), keys[rng.permutation(len(keys))[:200]].ravel(), [0] * k]).astype(np.int32)
    place = {tuple(x): i for i, x in enumerate(keys.tolist())}
    want = {i: place[t] for i in range(len(text) - k + 1) if (t := tuple(text[i : i + k].tolist())) in place}
    assert dict(zip(*(x.tolist() for x in trie.walk(text, np.arange(len(text) - k + 1))))) == want


def _collocations(rows, least, keep, longest=4):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", _lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    covered = collections.Counter()
    for (lang, g), a in found.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                covered[lang, g[i : i + k]] = max(covered[lang, g[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, g), a in found.items():
        if 100 * covered[lang, g] < 80 * a or not covered[lang, g]:
            cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return sorted(
        (lang, i, t.decode(), -a, left, right, n[lang], -score)
        for lang, rows in out.items() for i, (score, a, t, left, right) in enumerate(sorted(rows)[:keep], 1)
    )


@pytest.mark.parametrize("per_part", [1 << 20, 3])
def test_phrases_equal_their_definition(spark, per_part, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 50)
    rng = np.random.default_rng(5)
    words = ["alpha", "BETA", "a\x01", "a", "ünï", "b", "²³", "zz\x00"]
    common = "the Same passage, of some words again"
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02])), str(rng.choice(["en", "de"]))) for _ in range(40)]
    rows += [(f"{common}. {common}\t{i}", None) for i in range(12)] + [("und alpha", "und"), (None, "en"), ("", None), (" .,; \n", "fr"), ("once", "it")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'x' AS word", "'x' AS `group`", "'x' AS n", "1 AS rank")
    got = [tuple(r) for r in phrases.collocations(df, least=5, keep=20, per_part=per_part).collect()]
    assert sorted(got) == _collocations(rows, 5, 20) and len(got) > 30


def test_no_phrase_begins_at_a_word_out_of_reach(spark):
    # frequent pairs whose neighbours are not: they leave the shards between two runs that stay
    rows = [(f"a b c h x{i % 10} y{i % 10} d e f g", "en") for i in range(100)]
    rows += [(f"a b c x{i % 10} y{i % 10} d e f{i // 10}", "de") for i in range(100)] + [(f"e f{i % 10}", "de") for i in range(250)]
    rows += [(f"x{i % 10} y{i % 10}", lang) for i in range(250) for lang in ("en", "de")]
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=30)
    assert sorted(tuple(r) for r in got.collect()) == _collocations(rows, 30, 2000)


def test_candidates_are_the_frequent_phrases(spark, monkeypatch):
    # many different pairs, few of them frequent: what the driver broadcasts must not grow with the different ones
    built = []
    monkeypatch.setattr(phrases, "DoubleArray", lambda keys, digits: built.append(keys.shape) or DoubleArray(keys, digits))
    for size in ("SORTED", "SLICE"):
        monkeypatch.setattr(phrases, size, 500, raising=False)
    rng = np.random.default_rng(11)
    rows = [(" ".join(f"w{i}" for i in rng.integers(0, 300, 100)) + (" x y z" if i % 4 == 0 else ""), "en") for i in range(200)]
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=4, per_part=10)
    assert sorted(tuple(r) for r in got.collect()) == _collocations(rows, 4, 2000)
    seen = collections.Counter(g for text, _ in rows for k in (2, 3, 4) for g in zip(*(text.split()[i:] for i in range(k))))
    for k in (2, 3, 4):
        frequent = sum(n >= 4 for g, n in seen.items() if len(g) == k)
        assert sum(n for n, words in built if words == k) == frequent < 200


@pytest.mark.parametrize("k, bits", [(2, 4), (2, 31), (3, 21), (3, 30), (4, 17)])
def test_different_phrases_and_their_sums(k, bits):
    rng = np.random.default_rng(k)
    some = rng.integers(1, 1 << bits, 4)
    words = [rng.choice(some, 500).astype(np.int32) for _ in range(k)]
    n = rng.integers(1, 9, 500)
    for weights in (None, n):
        grams, total = phrases.different(words, weights, bits)
        want = collections.Counter()
        for g, x in zip(zip(*(w.tolist() for w in words)), (n if weights is not None else np.ones(500, int)).tolist()):
            want[g] += x
        assert list(zip(zip(*(w.tolist() for w in grams)), total.tolist())) == sorted(want.items())


def test_phrases_of_odd_rows(spark, odd_docs, no_docs):
    got = phrases.collocations(odd_docs, least=2)
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == _collocations(rows, 2, 2000)
    assert phrases.collocations(no_docs).count() == 0


def test_ranks_of_a_hot_group_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 10)
    df = spark.range(3000).selectExpr("IF(id % 3 < 2, 'a', 'b') AS lang", "id % 7 AS score", "id")
    order = [df["score"].desc(), df["id"].asc()]
    got = [tuple(r) for r in phrases.first_of_each(df, "lang", order, 5, 3000).select("lang", "rank", "id").collect()]
    want = [(g, i, x) for g in "ab" for i, (_, x) in enumerate(sorted((-(x % 7), x) for x in range(3000) if (x % 3 < 2) == (g == "a"))[:5], 1)]
    assert sorted(got) == want


# ------------------------------------------------------------- benchmark windows
def _split(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text)) if w]


def _contaminated(text, items, size):
    words, hit, met = _split(text), set(), set()
    for item, other in items:
        other = _split(other)
        m = min(size, len(other))
        for at in range(len(other) - m + 1) if m else ():
            for i in range(len(words) - m + 1):
                if words[i : i + m] == other[at : at + m]:
                    hit |= set(range(i, i + m))
                    met.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(met)


@pytest.mark.parametrize("parts", [{}, {"words_per_part": 40, "words_per_piece": 3}])
def test_windows_equal_their_definition(spark, odd_docs, no_docs, parts):
    rng = np.random.default_rng(6)
    words = ["the", "of", "Ünï", "x1", "and", "THE", "cat"]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(int(rng.integers(1, 14)))) for i in range(30)] + [(30, None), (31, "--"), (None, "quick brown fox jumps"), (32, items_long := text(60))]
    items += [(10, "alpha beta gamma delta alpha beta"), (10, "alpha beta gamma delta alpha beta"), (11, "Z" * 5000)]
    docs = [(i, text(int(rng.integers(0, 200)))) for i in range(40)] + [(41, "start " + items_long + " end"), (42, items_long[: len(items_long) // 2])]
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect() if r["doc_id"] != 7]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS item", "'x' AS words", "'x' AS n")
    table = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS hits", "'x' AS doc")
    got = decontaminate.contaminated(table, bench, ["doc_id", "text"], size=8, **parts).collect()
    assert len(got) == len(docs) + len(odd)
    for r in got:
        n, hit, met = _contaminated(r["text"], items, 8)
        assert r["n_words"] == n and r["items"] == met
        assert [i for a, b in r["hits"] for i in range(a, b + 1)] == hit
    assert any(r["hits"] for r in got) and any(not r["hits"] for r in got)
    long = decontaminate.contaminated(odd_docs.where("doc_id = 7"), bench, ["doc_id"], size=8, **parts).first()
    assert long["n_words"] == 80_001 and {"10", "11"} <= set(long["items"]) and long["hits"] == [[0, 79_997], [80_000, 80_000]]
    assert decontaminate.contaminated(no_docs, bench, ["doc_id"]).count() == 0
    assert {len(r["hits"]) for r in decontaminate.contaminated(odd_docs, no_docs.withColumnRenamed("doc_id", "item_id"), ["doc_id"]).collect()} == {0}


# --------------------------------------------------------------- hard negatives
def _mined(rows, every, k=5):
    clean = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = (label, [int(np.floor(256 * float(x))) for x in v])
            clean[i] = min(clean.get(i, w), w)
    out = []
    for i, (label, v) in clean.items():
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, (other, w) in clean.items() if j != i and len(w) == len(v))
            for s, p, _ in [x for x in scored if x[2] == label][:k]:
                met = [(t, j) for t, j, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
                out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(met, 1)]
    return sorted(out)


def test_negatives_equal_their_definition(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((400, 5)).round(1)
    vectors[::3] = vectors[0]  # a third of the rows is one vector
    rows = [(int(i), v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (501, [1.0] * 5, None), (None, [1.0] * 5, 1), (502, [nan] * 5, 1), (503, [inf] * 5, 1), (504, [None] + [1.0] * 4, 1)]
    rows += [(505, [], 1), (510, [], 2), (520, [0.0] * 5, 1), (530, [3.0, 1.0], 1), (531, [3.0, 1.0], 2), (532, [2.0, 1.0], 1), (0, [9.0] * 5, 0), (40, [1.0] * 5, -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS dims", "'x' AS v", "2 AS block", "3 AS kind")
    anchors = "vec_id % 10 = 0"
    from pyspark.sql import functions as F

    for per_block in (65_536, 50):
        got = negatives.hard_negatives(df, is_anchor=F.expr(anchors), rows_per_block=per_block)
        assert sorted(tuple(r) for r in got.collect()) == _mined(rows, 10)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_residue_products_are_exact():
    rng = np.random.default_rng(8)
    for dims, largest in ((1, 1), (64, 256), (700, 2_000_000), (3, 1_000_000_000)):
        a, b = (rng.integers(-largest, largest + 1, (n, dims)) for n in (7, 90))
        a[0], b[0], b[1] = largest, largest, -largest
        primes = negatives.primes_for(dims * largest * largest)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert negatives.ResidueMatrix(b, primes).scores(a).tolist() == want
    with pytest.raises(ValueError):
        negatives.primes_for(1 << 70)
