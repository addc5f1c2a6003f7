"""One query per operator, each over the whole of its tables."""

from __future__ import annotations

from souk.llm import (collocations, decontaminate, embedding_dedup, fingerprints, language_id, language_model, license_scan,
                      near_dedup, pieces, quality, sharding, spelling, toxicity)


def queries() -> dict:
    return {
        "op10_language_model": language_model.query,
        "op11_embedding_dedup": embedding_dedup.query,
        "op12_collocations": collocations.query,
        "op13_spelling_variants": spelling.query,
        "op1_toxicity": toxicity.query,
        "op2_feistel_sharding": sharding.query,
        "op3_decontamination": decontaminate.query,
        "op4_quality": quality.query,
        "op5_near_dedup": near_dedup.query,
        "op6_sentencepiece": pieces.query,
        "op7_fingerprints": fingerprints.query,
        "op8_license_scan": license_scan.query,
        "op9_language_id": language_id.query,
    }


def _runs(words: str, length: str) -> str:
    """SQL list of all runs of ``length`` words, as texts."""
    return f"list_transform(range(1, len({words}) - {length} + 2), lambda i: array_to_string({words}[i:i + {length} - 1], ' '))"


NOTE_WORDS = "regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH items AS (
  SELECT DISTINCT item_id, w, least(5, len(w)) AS n FROM (SELECT item_id, {NOTE_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), item_shingles AS (
  SELECT item_id, w, n, s, count(*) OVER (PARTITION BY item_id, w) AS n_item
  FROM (SELECT DISTINCT item_id, w, n, unnest({_runs('w', 'n')}) AS s FROM items)
), docs AS (
  SELECT DISTINCT doc_id, md5(text) AS t, {NOTE_WORDS} AS w FROM documents WHERE text IS NOT NULL
), doc_shingles AS (
  SELECT DISTINCT doc_id, t, n, unnest({_runs('w', 'n')}) AS s FROM docs, (SELECT DISTINCT n FROM items)
), shared AS (
  SELECT doc_id, t, item_id, w, n_item, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (n, s) GROUP BY ALL
)
SELECT DISTINCT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(n_shared AS INTEGER) AS n_shared,
  n_shared / n_item AS containment
FROM shared WHERE n_shared >= 0.8 * n_item
QUALIFY row_number() OVER (PARTITION BY doc_id, t, item_id ORDER BY n_shared / n_item DESC, n_shared DESC, n_item DESC) = 1"""

ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = f"""WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest({_runs('w', 'least(5, len(w))')}) AS s FROM docs WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = a JOIN sizes k ON k.doc_id = b WHERE 100 * common >= 85 * (m.n + k.n - common)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id)"""

EMBEDDING_DEDUP = """WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), vectors AS (
  SELECT * FROM raw WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.i AS a, y.i AS b FROM vectors x JOIN vectors y ON x.i <> y.i AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9
), reached AS (
  SELECT i, i AS other FROM raw
  UNION SELECT r.i, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
  SELECT r.i, min(o.vec_id) AS component_id FROM reached r JOIN raw o ON o.i = r.other GROUP BY r.i
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = raw.i) AS n_links, component_id,
  coalesce(vec_id = component_id, true) AS kept
FROM raw JOIN least USING (i)"""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

COLLOCATIONS = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, {LETTERS}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), spoken AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM spoken
), runs AS (
  SELECT lang, size, unnest({_runs('w', 'size')}) AS phrase FROM sizes WHERE len(w) >= size
), counts AS (
  SELECT lang, size, phrase, count(*) AS n FROM runs GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), parts AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE n >= 30
), cuts AS (
  SELECT lang, phrase, n AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM parts WHERE size > 1)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.n + y.n) AS BIGINT) AS score
  FROM cuts c JOIN parts x ON x.lang = c.lang AND x.phrase = c.first JOIN parts y ON y.lang = c.lang AND y.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (CAST(2000000 AS HUGEINT) * c.a) // (x.n + y.n), c.k) = 1
), around AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, n, unnest(list_concat({_runs('w', '2')}, CASE WHEN size = 4 THEN {_runs('w', '3')} ELSE [] END)) AS phrase
    FROM parts WHERE size > 2) GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, t.n, score
FROM scored s JOIN totals t ON t.lang = s.lang LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase
WHERE o.n IS NULL OR CAST(100 AS HUGEINT) * o.n < CAST(80 AS HUGEINT) * a
QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """The operators whose whole result SQL can express; tests/llm checks the others against brute force."""
    return {"op3_decontamination": DECONTAMINATION, "op5_near_dedup": NEAR_DEDUP, "op11_embedding_dedup": EMBEDDING_DEDUP,
            "op12_collocations": COLLOCATIONS}
