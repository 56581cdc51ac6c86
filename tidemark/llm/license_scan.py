"""License scans by an exact set-similarity join (operator 8).

A text block is a run of words that begins at a word of the template and is half as
long again as it, whatever line breaks are in it.  It meets the template if it holds
at least ``threshold`` of its distinct words, or all of them if they are fewer than
ten.  Where a block meets a template, one whose words are a strict part of that
template's is not met by the block from the same word (a notice of CC BY-NC is none
of CC BY).  The join finds every such block without looking at most of them:

* words have one global order, rare before frequent, by the number of documents
  that hold them (counted over all documents);
* *prefix*: a template of ``n`` words that needs ``k`` of them cannot be met by a
  block that has none of its first ``n - k + 1`` words, so only places of these are
  looked at, and a block only from the first of them in it;
* *length*: nor can a place be in a block that meets it if the words in reach of
  the place hold fewer than ``k`` of the template's;
* *position*: a block begins at a word of the template that stands in front of the
  place, at most a block's length and behind the prefix word before it.

What passes is verified on the words themselves.  The template index is a constant
of the caller and joined as a literal; a place carries the words in its reach only,
so that the work of a text grows with its length, and nothing is shuffled before
the places have been verified.

Besides, phrases are counted: places where their words stand consecutively.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, whole

#: A template of fewer different words is met by all of them only.
SHORT = 10
#: What separates words: ASCII signs other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Words of common license notices, with their labels.
TEMPLATES = {
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "all rights reserved": "reserved",
}


def spaced(text: Column) -> Column:
    """The words of a text, each with a space on both sides: two between words.

    Occurrences of a phrase written this way never share a sign.
    """
    return F.concat(F.lit(" "), F.regexp_replace(lower_ascii(text), GAP, "  "), F.lit(" "))


def phrase_places(spaced_text: str, phrase: str) -> dict[str, Column]:
    """How often the phrase's words stand consecutively, and the first and last place, in words."""
    words = phrase.split()
    sought = "".join(f" {w} " for w in words)
    text = F.col(spaced_text)
    count = (F.length(text) - F.length(F.replace(text, F.lit(sought)))) / len(sought)
    ahead = F.substring_index(text, sought, 1)
    behind = F.substring_index(text, sought, -1)
    return {
        "count": count.cast("long"),
        "first": _words_of(ahead),
        "last": _words_of(text) - _words_of(behind) - len(words),
    }


def _words_of(spaced_text: Column) -> Column:
    return F.regexp_count(spaced_text, F.lit("[^ ]+")).cast("long")


def count_phrases(docs: DataFrame, text: str, phrases: Mapping[str, str], carry: Sequence[str]) -> DataFrame:
    """``carry`` and ``n_words, n_base, first_word, last_word, base``, the last a sorted array of labels."""
    rows = docs.select(*carry, spaced(whole(text)).alias("__text"))
    found = {p: phrase_places("__text", p) for p in phrases}
    hit = {p: F.contains(F.col("__text"), F.lit("".join(f" {w} " for w in p.split()))) for p in phrases}
    count = reduce(lambda a, b: a + b, [F.when(hit[p], f["count"]).otherwise(F.lit(0)) for p, f in found.items()])
    places = [F.when(hit[p], f["first"]) for p, f in found.items()], [F.when(hit[p], f["last"]) for p, f in found.items()]
    least, most = (side[0] if len(side) == 1 else make(*side) for side, make in zip(places, (F.least, F.greatest)))
    labels = F.array_compact(F.array(*[F.when(hit[p], F.lit(label)) for p, label in phrases.items()]))
    return rows.select(
        *carry,
        _words_of(F.col("__text")).alias("n_words"),
        count.cast("long").alias("n_base"),
        least.alias("first_word"),
        most.alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
    )


def word_order(docs: DataFrame, text: str, words: Sequence[str]) -> list[str]:
    """The template words, those in the fewest documents first; one row a word reaches the driver."""
    vocabulary = F.array(*[F.lit(w) for w in words])
    held = docs.select(F.explode_outer(F.array_intersect(F.split(lower_ascii(whole(text)), GAP), vocabulary)).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def needed(words: set[str], threshold: float) -> int:
    """How many of a template's words a block must hold."""
    return len(words) if len(words) < SHORT else max(1, math.ceil(threshold * len(words) - 1e-9))


def block_length(template: str) -> int:
    """Words of a block: half as many again as the template has."""
    return math.ceil(1.5 * len(template.split()))


def matching_blocks(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, str] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """``doc_id, block, template, label, containment`` of every block that meets a template.

    ``block`` is the block's first word, counted from 0.  Null and empty texts have
    no words and meet nothing; a block that meets several templates gives a row for
    each, but for those that are a part of another.
    """
    templates = TEMPLATES if templates is None else templates
    words = {t: set(t.split()) for t in templates}
    order = word_order(docs, text, sorted(set().union(*words.values())))
    need = {t: needed(ws, threshold) for t, ws in words.items()}
    prefix = {t: [w for w in order if w in ws][: len(ws) - need[t] + 1] for t, ws in words.items()}
    reach = max(map(block_length, templates))

    kept = "n int, need int, span int, words array<string>"
    part = lambda t: [F.lit(len(words[t])), F.lit(need[t]), F.lit(block_length(t)), _strings(sorted(words[t]))]
    entry = f"struct<template:string,label:string,prefix:array<string>,own:struct<{kept}>,wider:array<struct<{kept}>>>"
    index = F.create_map(*[
        x
        for w in sorted(set().union(*prefix.values()))
        for x in (F.lit(w), F.array(*[
            F.struct(F.lit(t), F.lit(templates[t]), _strings(prefix[t]), F.struct(*part(t)),
                     F.array(*[F.struct(*part(u)) for u in templates if words[t] < words[u]]).cast(f"array<struct<{kept}>>"))
            for t in templates if w in prefix[t]
        ]).cast(f"array<{entry}>"))
    ])

    sought = sorted(set().union(*prefix.values()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.array_remove(F.split(lower_ascii(whole(text)), GAP), "").alias("words"))
    # explode_outer: no filter on the generated rows is derived, which would be pushed into the lambdas
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sought), i)), lambda i: i.isNotNull())
    some = F.when(F.arrays_overlap("words", _strings(sought)), places)  # most texts have no place to look at
    rows = rows.select("doc_id", "words", F.explode_outer(some).alias("at")).where(F.col("at").isNotNull())
    first = F.greatest(F.col("at") - (reach - 1), F.lit(0))
    rows = rows.select(
        "doc_id",
        (F.col("at") - first).alias("ahead"),
        first.alias("first"),
        F.slice("words", first + 1, F.lit(2 * reach - 1)).alias("near"),
    )
    pairs = rows.select("*", F.explode_outer(F.element_at(index, F.get("near", F.col("ahead")))).alias("t"))

    def common(start: Column, t: Column) -> Column:
        return F.size(F.array_intersect(F.slice("near", start, t["span"]), t["words"]))

    own = F.col("t.own")
    enough = common(F.lit(1), F.struct(F.lit(2 * reach).alias("span"), own["words"].alias("words"))) >= own["need"]
    begins = F.filter(
        F.sequence(F.greatest(F.col("ahead") - own["span"] + 2, F.lit(1)), F.col("ahead") + 1),
        lambda s: F.array_contains(own["words"], F.get("near", s - 1))
        & (F.size(F.array_intersect(F.slice("near", s, F.col("ahead") + 1 - s), F.col("t.prefix"))) == 0)
        & (common(s, own) >= own["need"])
        & ~F.exists("t.wider", lambda u: common(s, u) >= u["need"]),
    )
    blocks = pairs.select("doc_id", "first", "near", "t", F.explode_outer(F.when(enough, begins)).alias("start"))
    blocks = blocks.where(F.col("start").isNotNull())
    return blocks.select(
        "doc_id",
        (F.col("first") + F.col("start") - 1).cast("long").alias("block"),
        F.col("t.template").alias("template"),
        F.col("t.label").alias("label"),
        (common(F.col("start"), F.col("t.own")) / F.col("t.own.n")).alias("containment"),
    )


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] | None = None,
    templates: Mapping[str, str] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """Phrase counts, labels of both kinds and a score for every row.

    The score is the largest containment of a matched template, 1 where a phrase
    stands, 0 where nothing was found.  Rows that repeat an id share the labels
    of their blocks.
    """
    base = count_phrases(docs, text, PHRASES if phrases is None else phrases, [doc_id])
    blocks = matching_blocks(docs, doc_id, text, templates, threshold)
    found = blocks.groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_set("label").alias("__labels"), F.max("containment").alias("__most")
    )
    both = base.join(found, F.col(doc_id).eqNullSafe(F.col("__id")), "left")
    extra = F.coalesce("__labels", F.array().cast("array<string>"))
    sure = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return both.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", extra)), ",").alias("labels"),
        F.greatest(F.coalesce("__most", F.lit(0.0)), sure).alias("score"),
    )
