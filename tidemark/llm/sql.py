"""Comparison SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from .license_scan import PHRASES, TEMPLATES, block_length, needed
from .mixing import WEIGHTS

BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = rf"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANKS}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""


def license_scan(threshold: float = 0.8) -> str:
    """Every block against every template, by the definition."""
    gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '{gap}')"
    places = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"w[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    templates = ", ".join(
        f"({sorted(set(t.split()))!r}, '{label}', {needed(set(t.split()), threshold)}, {block_length(t)})"
        for t, label in TEMPLATES.items()
    )
    return rf"""
WITH split AS (SELECT doc_id, text, {words('text')} AS w FROM documents),
base AS (SELECT doc_id, len(w) AS n_words, list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) AS p FROM split),
templates(words, label, need, span) AS (VALUES {templates}),
each_word AS (SELECT words, label, need, span, unnest(words) AS word FROM templates),
starts AS (SELECT doc_id, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
met AS (
  SELECT doc_id, i, words, label, len(list_intersect(list_distinct(w[i:i + span - 1]), words)) / len(words) AS part
  FROM starts JOIN each_word USING (word) WHERE len(list_intersect(list_distinct(w[i:i + span - 1]), words)) >= need),
alone AS (
  SELECT * FROM met m WHERE NOT EXISTS (
    SELECT 1 FROM met o WHERE o.doc_id = m.doc_id AND o.i = m.i AND len(o.words) > len(m.words) AND list_has_all(o.words, m.words))),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(part) AS most FROM alone GROUP BY doc_id)
SELECT doc_id, n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word,
  list_max(list_transform(p, lambda x: x.at)) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(labels, [])))), ','), '') AS labels,
  greatest(coalesce(most, 0.0), CASE WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM base LEFT JOIN found USING (doc_id)
"""


def mixing(epochs: int = 3, seed: str = "mix-1") -> str:
    weights = ", ".join(f"{w}::DOUBLE" for w in WEIGHTS)
    return rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat('{seed}', doc_id)) AS hash FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * {epochs} AS cap,
    [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM docs GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER o AS place,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing,
    sum(source_size) OVER () AS total
  FROM named WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
level AS (
  SELECT place AS first_place, (total - clamped) / sharing AS level FROM ordered
  WHERE cap >= weight * ((total - clamped) / sharing) ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN place < first_place THEN cap ELSE least(cap, weight * level) END AS target
  FROM ordered, level),
plan AS (
  SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, {epochs})::BIGINT AS whole FROM targets),
running AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.doc_id ROWS UNBOUNDED PRECEDING) AS seen
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
gaps AS (
  SELECT *, seen <= rest AS drawn,
    rest - coalesce(max(CASE WHEN seen <= rest THEN seen END) OVER (PARTITION BY source), 0) AS gap FROM running),
best AS (
  SELECT doc_id, 1 AS extra FROM gaps WHERE NOT drawn AND abs(size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), hash) = 1)
SELECT doc_id, size, source_size, target, least(whole + drawn::INT + coalesce(extra, 0), {epochs})::BIGINT AS times,
  (least(whole + drawn::INT + coalesce(extra, 0), {epochs}) * size)::BIGINT AS taken
FROM gaps LEFT JOIN best USING (doc_id)
"""


def phrases(longest: int = 4, least: int = 30, keep: int = 2000) -> str:
    """All contiguous phrases of all pieces, counted, cut and ranked by the definition."""
    grams = " UNION ALL ".join(
        f"SELECT lang, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: w[i:i + {k - 1}])) AS g FROM pieces WHERE len(w) >= {k}"
        for k in range(1, longest + 1)
    )
    return rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
cut AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS ({grams}),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= {least}),
cuts AS (
  SELECT c.lang, c.g, c.a, k, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score, l.a AS l, r.a AS r
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
parts AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) AS g
  FROM f WHERE len(g) > 2),
around AS (SELECT lang, g, max(a) AS most FROM parts GROUP BY lang, g),
kept AS (
  SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, l, r, score FROM scored s
  LEFT JOIN around o ON o.lang = s.lang AND o.g = s.g WHERE most IS NULL OR 100 * most < 80 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang)
QUALIFY rank <= {keep}
"""


def decontamination(size: int = 10) -> str:
    """Every window of every document against every window of every item."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT *, least(len(w), {size}) AS m, unnest(range(1, greatest(len(w) - {size}, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
split AS (SELECT row_number() OVER () AS row, doc_id, {words('text')} AS w FROM documents),
places AS (
  SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, lengths WHERE len(w) >= m)),
met AS (SELECT row, i, m, item FROM places JOIN windows USING (m, t)),
found AS (SELECT row, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS named FROM met GROUP BY row),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS p FROM met) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN found USING (row) LEFT JOIN hit USING (row)
"""


HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""


def all_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": EXACT_DEDUP,
        "op8_license_scan": license_scan(),
        "op9_source_mixing": mixing(),
        "op11_phrases": phrases(),
        "op12_decontamination": decontamination(),
        "op13_hard_negatives": HARD_NEGATIVES,
    }
