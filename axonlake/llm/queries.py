"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_secrets import op1_secrets
from .op10_decontaminate import op10_decontaminate
from .op11_runs import op11_runs
from .op12_urls import LIMIT, RULES, VOCABULARY, op12_urls
from .op2_pii import op2_pii
from .op3_mixing import op3_mixing
from .op4_sharding import op4_sharding
from .op5_embedding_dedup import op5_embedding_dedup
from .op6_language import op6_language
from .op7_quality import op7_quality
from .op8_licenses import op8_licenses
from .op9_ngram_join import op9_ngram_join


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_pii, op3_mixing, op4_sharding, op5_embedding_dedup, op6_language, op7_quality, op8_licenses, op9_ngram_join, op10_decontaminate, op11_runs, op12_urls)}


#: Smallest id reachable by links(x, y), which hold both directions, from the rows of `every`(id).
_CLASSES = """
reach AS (SELECT id, id AS r FROM every UNION SELECT reach.id, links.y FROM reach JOIN links ON reach.r = links.x),
classes AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
every AS (SELECT vec_id AS id FROM embeddings),{_CLASSES},
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v JOIN classes c ON c.id = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words),
entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS o FROM entries a JOIN entries b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common WHERE 100 * o >= 85 * (total - o)),
every AS (SELECT doc_id AS id FROM documents),{_CLASSES}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM sets s JOIN classes c ON c.id = s.doc_id
"""

#: The rules and the vocabulary as rows; a term counts where no letter or digit touches it.
URLS = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
terms(t, w) AS (VALUES {", ".join(f"('{t}', {w})" for t, w in VOCABULARY.items())}),
cut AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h0, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
parts AS (SELECT *, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut),
every AS (SELECT page_id, host, path,
  (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  (SELECT coalesce(sum(w), 0) FROM terms WHERE regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')) AS weight FROM parts)
SELECT page_id, host, path, rule, coalesce((SELECT v FROM rules WHERE h || p = rule), CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, weight::BIGINT AS weight FROM every
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't express the other operators: trained models, alignments, automata, compressors, keyed permutations, iterations."""
    return {"op5_embedding_dedup": EMBEDDING_DEDUP, "op9_ngram_join": NGRAM_JOIN, "op12_urls": URLS}
