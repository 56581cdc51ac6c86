"""The pipeline's stages against brute force on a small table with planted cases."""

from __future__ import annotations

import collections

import pytest

from tidemark.llm import bpe

pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 250")
    rows = [tuple(r) for r in docs.collect()]
    text = next(r[1] for r in rows if 300 < len(r[1].split()) < 900)
    words = text.split()
    extra = [
        (1000, text, "en", "src0", 1),
        (1001, text.replace(" ", "  \t"), "en", "src1", 1),
        (1002, " ".join([*words[:100], "planted", *words[101:]]), "en", "src2", 1),
        (1003, "12345 !!!", "en", "src3", 1),
        (1004, None, None, None, None),
        (1005, "", "en", "src4", 1),
    ]
    return spark.createDataFrame(rows + extra, docs.schema)


def test_stages(spark, planted, sf_dir, tmp_path):
    docs, seen = planted, {}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "byte_bpe"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "byte_bpe":
            assert out.columns == planted.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    start = planted.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}

    lettered = {r["doc_id"] for r in start if any(c.isalpha() for c in r["text"] or "")}
    assert ids["language_id"] == lettered and not lettered & {1003, 1004, 1005}

    first = {}
    for r in sorted(seen["language_id"], key=lambda r: r["doc_id"]):
        first.setdefault(" ".join(r["text"].replace("\t", " ").split()) if r["doc_id"] >= 1000 else r["text"], r["doc_id"])
    assert not ids["exact_dedup"] & {1000, 1001} and ids["exact_dedup"] <= ids["language_id"]

    texts = {r["doc_id"]: r["text"] for r in seen["exact_dedup"]}
    gone = ids["exact_dedup"] - ids["near_dedup"]
    assert 1002 in gone
    for i in gone:  # only what has a near copy
        assert any(i != j and len(shingles(texts[i]) & shingles(t)) >= 0.8 * len(shingles(texts[i]) | shingles(t)) for j, t in texts.items())

    size = lambda r: len(r["text"].split())
    before, after = collections.Counter(), collections.Counter()
    for r in seen["near_dedup"]:
        before[r["source"]] += size(r)
    times = collections.Counter(r["doc_id"] for r in seen["source_mixing"])
    assert max(times.values()) <= 3 and set(times) <= ids["near_dedup"]
    for r in seen["source_mixing"]:
        after[r["source"]] += size(r)
    assert abs(sum(after.values()) - sum(before.values())) <= 0.1 * sum(before.values())

    assert all(r["round_trip"] for r in seen["byte_bpe"])
    assert len(seen["byte_bpe"]) == len(seen["source_mixing"])


def test_run_on_the_given_table(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.where("NOT round_trip").count() == 0 and out.count() > 0


def test_empty_table_and_clashing_columns(spark, odd_docs, no_docs, sf_dir):
    for docs in (no_docs, odd_docs):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "byte_bpe" or out.columns == docs.columns
            assert docs is odd_docs or out.count() == 0


def test_tokens_take_one_small_worker_a_task(spark, odd_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = pipeline.tokenise(spark, docs, sf_dir)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text")))
    want = sorted(((r["doc_id"], list(r["ids"])) for r in both.collect()), key=str)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in out.collect()), key=str) == want and out.where("NOT round_trip").count() == 0
    coder = bpe.ByteBPE.load(*bpe.default_files())
    coder.encode(["some unheardof words"])
    assert coder.kept
    coder.forget()
    assert not coder.kept and not coder.kept_pieces
