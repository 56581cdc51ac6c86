"""Dedup, sharding, mixing, licenses and nearest neighbours on small tables, against definitions."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash

from __spark_entry__ import oracle_sql
from tests.compare import compare, connect
from tidemark.llm import ann, exact_dedup, license_scan, mixing, queries, sharding, simhash
from tidemark.llm.graph import components


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, str(r)))


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op8_license_scan", "op9_source_mixing"])
def test_equals_sql(name, spark, sf_dir):
    error, rows, _ = compare(spark, connect(sf_dir), queries.queries()[name], oracle_sql()[name], sf_dir)
    assert not error and rows > 0


# --------------------------------------------------------------- exact dedup
def test_dedup_of_odd_rows(odd_docs, no_docs):
    rows = exact_dedup.exact_dedup(odd_docs.select("doc_id", "text", "kept")).collect()
    text = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[text(r["text"])].append(r)
    for members in groups.values():
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        assert {r["keep_id"] for r in members} == {min(ids, default=None)}
        assert {r["group_size"] for r in members} == {len(members)}
        assert sum(r["kept"] for r in members) == 1
    assert len(rows) == odd_docs.count()
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_dedup_does_not_trust_lengths_or_prefixes(spark):
    same = "p" * 100
    rows = [(i, same + t) for i, t in enumerate(["aa", "ab", "aa", "b", "b ", "b"])]
    got = by_id(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size").collect())
    assert got == [(0, 0, 2), (1, 1, 1), (2, 0, 2), (3, 3, 2), (4, 4, 1), (5, 3, 2)]


# ------------------------------------------------------------------ sharding
def _check_shards(rows, docs, shards):
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == sorted(
        str((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in docs
    )
    slots = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even(spark, sf_dir):
    rows = queries.op5_sharding(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    _check_shards(rows, docs, 24)
    held = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=24)
    assert abs(held - held.mean()).max() <= max(r["size"] for r in rows)


def test_overfull_text_is_subdivided(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 < 2, 'one text', concat('t', id % 50)) AS text")
    rows = sharding.shard_by_bytes(docs, shards=6, rows_per_bucket=100).collect()
    _check_shards(rows, docs.collect(), 6)
    held = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=6)
    assert held.max() / held.mean() < 1.03 and held.min() / held.mean() > 0.97


def test_shards_of_odd_rows(odd_docs, no_docs, spark):
    _check_shards(sharding.shard_by_bytes(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 24)
    assert sharding.shard_by_bytes(no_docs).count() == 0
    assert [r["shard"] for r in sharding.shard_by_bytes(odd_docs, shards=1).collect()] == [0] * odd_docs.count()


# ------------------------------------------------------------------- SimHash
def _fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    made = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_three_bits():
    masks = [m % (1 << 64) for m in simhash.covering_masks(3)]
    assert len(masks) == 15 and all(32 <= m.bit_count() <= 36 for m in masks)
    for i in range(64):
        for j in range(i, 64):
            for k in range(j, 64):
                assert any(not m & (1 << i | 1 << j | 1 << k) for m in masks)


def _components(points, most):
    label = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= most:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("block", [2048, 7])
def test_links_connect_what_they_should(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    points = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(40)}
    points = sorted(points | {0, 1, 3, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = dict(map(tuple, components(simhash.links(df, 3, block=block)).collect()))
    groups = collections.defaultdict(set)
    for p, label in zip(signed, _components(points, 3)):
        groups[label].add(p)
    for members in groups.values():
        assert {found.get(p, p) for p in members} == {min(members)}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all(prints[i] == _fingerprint(t) for i, t in texts.items() if len(t or "") < 1000)
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_duplicate_query(spark, sf_dir):
    rows = queries.op7_simhash(spark, sf_dir).collect()
    points = [int(r["fingerprint"], 16) for r in rows]
    smallest = {}
    for label, r in zip(_components(points, 3), rows):
        smallest[label] = min(smallest.get(label, r["doc_id"]), r["doc_id"])
    assert all(smallest[label] == r["component_id"] for label, r in zip(_components(points, 3), rows))


def test_near_copies_are_verified(spark, odd_docs, no_docs):
    words = [f"w{i}" for i in range(120)]
    near, far = [*words[:60], "changed", *words[61:]], words[::-1]
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(far)), (6, " ".join(words))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == [3, 4]
    assert simhash.drop_near_copies(odd_docs).columns == odd_docs.columns
    assert simhash.drop_near_copies(no_docs).count() == 0


def test_near_copies_by_any_edit_are_found(spark):
    rng = np.random.default_rng(6)
    rows, lost = [], set()
    for i in range(100):
        words = [f"w{w}" for w in rng.integers(0, 5000, int(rng.integers(60, 600)))]
        more = [f"w{w}" for w in rng.integers(0, 5000, int(0.17 * len(words)))]
        cut, at = len(more), int(rng.integers(10, 40))
        kinds = [words + more, more + words, words[cut:], [*words[:at], "changed", *words[at + 1 :]]]
        rows += [(10 * i + j, " ".join(x)) for j, x in enumerate([words, kinds[i % 4]])]
        lost.add(10 * i + 1)
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - lost


def test_near_copies_meet_by_fingerprints(spark):
    rng = np.random.default_rng(8)
    rows, close = [], set()
    for i in range(12):
        words = [f"w{w}" for w in rng.integers(0, 5000, 3000)]
        texts = [" ".join(words), " ".join([*words[:50], "changed", *words[51:]])]
        rows += [(10 * i + j, t) for j, t in enumerate(texts)]
        if (int.__xor__(*map(simhash.of_shingles(5), texts))).bit_count() <= 3:
            close.add(10 * i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {"threshold": 0.99, "rows": 1500, "miss": 1 - 1e-7}  # a band that brings hardly any pair together
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs, **one).collect()}
    assert len(close) > 6 and not kept & close and len(kept) >= 12


@pytest.mark.parametrize("block", [256, 9])
def test_near_links_connect_families_as_all_pairs_do(spark, block):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(4):  # versions of a text, of which few are near copies of any one of them
        base = rng.choice(1 << 20, 100, replace=False)
        for _ in range(60):
            own = rng.choice(100, rng.integers(0, 22), replace=False)
            sets.append(set(np.delete(base, own).tolist()) | set(rng.integers(1 << 21, 1 << 30, rng.integers(0, 6)).tolist()))
    sets += [set(range(i * 10, i * 10 + 100)) for i in range(40)]  # a chain: each one is near the next only
    met = spark.createDataFrame([(min(i // 60, 4), i) for i in range(len(sets))], "group long, key long")
    held = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "key long, held array<int>")
    found = dict(map(tuple, components(simhash.near_links(met, held, 0.8, block=block)).collect()))
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if min(i // 60, 4) == min(j // 60, 4) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [found.get(i, i) for i in range(len(sets))] == label and label[-40:] == [240] * 40


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}


# ------------------------------------------------------------------ licenses
def test_phrases_that_touch_and_odd_rows(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(odd_docs).collect()}
    r = rows[10]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (14, 4, 2, 12)
    assert r["base_labels"] == "cc-by,reserved" and r["labels"] == "cc-by,cc-by-nc-4.0,reserved" and r["score"] == 1.0
    assert (rows[3]["n_words"], rows[3]["n_base"], rows[3]["first_word"], rows[3]["labels"]) == (0, 0, None, "")
    assert license_scan.scan_licenses(odd_docs).count() == odd_docs.count()
    assert license_scan.scan_licenses(no_docs).count() == 0


def _blocks(words, threshold):
    """All blocks that meet a template, by the definition."""
    met = collections.defaultdict(set)
    for t in license_scan.TEMPLATES:
        need, span = set(t.split()), -(-3 * len(t.split()) // 2)
        least = len(need) if len(need) < 10 else threshold * len(need) - 1e-9
        for i, w in enumerate(words):
            if w in need and len(need & set(words[i : i + span])) >= least:
                met[i].add(t)
    return {(i, t) for i, ts in met.items() for t in ts if not any(set(t.split()) < set(u.split()) for u in ts)}


def test_blocks_equal_all_windows(spark):
    rng = np.random.default_rng(4)
    words = sorted({w for t in license_scan.TEMPLATES for w in t.split()}) + ["zz", "yy"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(400)]
    for t in license_scan.TEMPLATES:  # notices in any order and with words lost or put in
        for _ in range(6):
            own = [w for w in t.split() if rng.random() < 0.95]
            texts.append(" ".join([*rng.choice(words, 3), *(rng.permutation(own) if rng.random() < 0.3 else own), *rng.choice(words, 5)]))
    texts = [" ".join(texts[i::40]) for i in range(40)]
    docs = spark.createDataFrame([(i, re.sub(" ", lambda _: rng.choice([" ", "\n", ", "]), t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        got = [tuple(r)[:3] for r in license_scan.matching_blocks(docs, threshold=threshold).collect()]
        want = {(i, b, t) for i, text in enumerate(texts) for b, t in _blocks(text.split(), threshold)}
        assert sorted(got) == sorted(want) and len(want) > 50


def test_long_texts_without_line_breaks(spark):
    text = "the terms of this file and the use of it " * 20_000 + "released under the MIT license"
    rows = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["n_words"], r["labels"], r["score"]) for r in rows] == [(200_005, "mit", 1.0)]


def test_notices_wrapped_over_lines(spark):
    texts = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "mpl-2.0": "/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. If a copy of",
        "gpl": "# you can redistribute it and/or modify\n# it under the terms of the GNU General\n# Public License as published by",
    }
    filler = "words of another kind stand here\n" * 20
    apart = "redistribution and use in source and\n" + filler + "binary forms with or without\n" + filler + "modification are permitted"
    rows = [(label, filler + t + "\n" + filler) for label, t in texts.items()] + [("", apart)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert all(label in got[label]["labels"].split(",") for label in texts) and got[""]["labels"] == ""
    met = {(r["doc_id"], r["label"]) for r in license_scan.matching_blocks(docs).collect()}
    assert met == {(label, label) for label in texts}


# -------------------------------------------------------------------- mixing
def test_water_levels_clamp_and_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 40, "d": 0}
    rows = mixing.water_levels(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    got = {r["source"]: r["target"] for r in rows}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, capped = {}, set()
    while True:  # the definition, step by step
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weights[s] for s in sizes if s not in capped)
        want = {s: 3 * sizes[s] if s in capped else rest * weights[s] / share for s in sizes}
        over = {s for s in sizes if want[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets(spark, sf_dir, odd_docs, no_docs):
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["source"]).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        assert r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    # whole documents only: with 50 a source the best fit is within a few per cent
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())
    assert mixing.mix(odd_docs, carry=["size"]).count() == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0


def test_mix_with_one_dominating_document(spark):
    sizes = {"a": [100] * 500 + [50_000], "b": [100] * 3750, "c": [40] * 5000} 
    docs = spark.createDataFrame(
        [(i, "w " * n, s) for i, (s, n) in enumerate((s, n) for s, all_of in sizes.items() for n in all_of)],
        "doc_id long, text string, source string",
    )
    for seed, weights in (("1", (1, 3, 4)), ("2", (1, 8, 8)), ("3", (1, 8, 8)), ("4", (1, 16, 16))):
        rows = mixing.mix(docs, carry=["source"], weights=weights, seed=seed).collect()
        taken, target = collections.Counter(), {r["source"]: r["target"] for r in rows}
        for r in rows:
            assert r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items()), (seed, taken, target)


# --------------------------------------------------------- nearest neighbours
def _nearest(rows, k):
    out = {}
    for q, v in rows.items():
        if q % 20 == 0:
            scored = sorted((-(np.array(v) * np.array(w)).sum(), i) for i, w in rows.items() if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def test_recall(spark, sf_dir):
    rows = dict(map(tuple, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()))
    want = _nearest(rows, 20)
    got = collections.defaultdict(list)
    for r in sorted(queries.op1_nearest(spark, sf_dir).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.dot(np.array(rows[r["query_id"]], float), np.array(rows[r["vec_id"]], float))))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (20, [-1.0, 0.5]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score")
    got = by_id(ann.nearest(df, k=2).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_many_equal_vectors_over_blocks(spark):
    df = spark.range(600).selectExpr("id AS vec_id", "IF(id % 3 = 0, array(1.0D, 2.0D), array(CAST(id AS DOUBLE), -1.0D)) AS embedding")
    rows = dict(map(tuple, df.collect()))
    got = ann.nearest(df, k=5, candidates=8, rows_per_block=100).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
    assert found == _nearest(rows, 5)


def _recall(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got, stack = collections.defaultdict(list), np.array(vectors)
    for r in ann.nearest(df).collect():
        got[r["query_id"]].append(r["score"])
    out = []
    for q, i in enumerate(ids):
        if i % 20 == 0:  # by score: any of several equal vectors will do
            best = np.sort(np.delete(stack @ stack[q], q))[::-1][:20]
            assert len(got[i]) == len(best)
            out.append(np.mean(np.array(got[i]) >= best[-1] - 1e-9) if len(best) else 1.0)
    return np.array(out)


def _unit(n, seed=8):
    v = np.random.default_rng(seed).standard_normal((n, 64))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("n", [5, 20, 100])
def test_small_tables_are_searched_whole(spark, n):
    assert _recall(spark, _unit(n)).min() == 1


def test_recall_with_a_third_of_copies(spark):
    v = _unit(2000)
    v[::3] = v[0]
    found = _recall(spark, v)
    assert found.mean() >= 0.9 and found.min() >= 0.5


@pytest.mark.parametrize("n", [2000, 20_000])
def test_recall_through_the_forest(n):
    v = _unit(n, seed=9)[:8192]  # blocks of the larger table have no more rows
    forest = ann.Forest(v, 1.0, 32, 11)
    found, share = [], []
    for i, live in enumerate(forest.candidates(v[::20][:200], 1.1 * len(v))):
        best = np.argsort(-np.delete(v @ v[20 * i], 20 * i))[:20]
        found.append(np.isin(best + (best >= 20 * i), live).mean())
        share.append(len(live) / len(v))
    assert np.mean(found) >= 0.9 and np.mean(share) <= 0.7


def test_ascent_counts_as_its_definition():
    v = _unit(300, seed=10).round(1)
    v[::4] = v[0]
    forest = ann.Forest(v, float(np.sqrt((v**2).sum(1).max())), 4, 11)
    strings = forest.strings(v, np.sqrt(np.maximum((v**2).sum(1).max() - (v**2).sum(1), 0)))
    for wanted in (1, 40, 300, 5000):
        for q, live in zip(v[:9], forest.candidates(v[:9], wanted)):
            own = forest.strings(q[None], np.zeros(1))[0]
            held, done = [set() for _ in range(4)], False
            for depth in range(32, -1, -1):
                for t in range(4):
                    if not done:
                        held[t] = {i for i in range(300) if not int(strings[i, t] ^ own[t]) >> (32 - depth)}
                        places = sum(len({v[i].tobytes() for i in s} | {q.tobytes()}) - 1 for s in held)
                        done = places >= wanted
            assert set(live) == set().union(*held) | set(np.flatnonzero(forest.repeated))


def test_rare_vector_lengths_have_blocks_of_their_own(spark):
    df = spark.range(3000).selectExpr(
        "id AS vec_id", "transform(sequence(1, IF(id % 100 < 99, 3, 4)), x -> rand(7) - 0.5) AS embedding"
    )
    rows = ann.nearest(df.selectExpr("IF(vec_id % 100 = 99, 20 * vec_id, vec_id + 60000) AS vec_id", "embedding"), rows_per_block=100)
    counts = collections.Counter(r["query_id"] for r in rows.where("query_id < 60000 AND query_id % 100 = 80").collect())
    assert len(counts) == 30 and set(counts.values()) == {20}
