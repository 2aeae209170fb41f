"""The corpus operators' queries over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telescribe.llm import align, ann, bpe, decontaminate, html_extract, jaccard_join, license_scan, line_dedup, near_dedup, resample, substring_dedup, toxicity, url_filter
from telescribe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def remainder(column: str) -> Column:
    """crc32 of the id as text, modulo 5: 0 marks the held-out fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=remainder("doc_id") != 0)
    held_out = F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, index).select("doc_id", held_out, "score", "predicted")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.later_lines(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("removed", "first_docs")})


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_ranges") - 1), F.lit(0).cast("bigint"), lambda n, i: n + F.element_at("hit_ranges", i + 1) * F.when(i % 2 == 0, -1).otherwise(1))
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.size("hit_ranges") > 0, n_hit).otherwise(F.lit(0)).cast("bigint").alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_items") > 0).alias("contaminated"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_toxicity,
        op3_minhash_near_dedup,
        op4_url_filter,
        op5_html_extraction,
        op6_substring_dedup,
        op7_nearest_vectors,
        op8_line_dedup,
        op9_benchmark_decontamination,
        op10_bpe,
        op11_cross_tokenizer_alignment,
        op12_importance_resampling,
        op13_jaccard_join,
    )
}

PAIRS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def needed(text: str, threshold: float = 0.8) -> int:
    return next(n for n in range(99) if n >= threshold * len(set(text.split())))


#: The same rows from DuckDB, for the operators that SQL can state at a bearable cost.
SQL: dict[str, str] = {
    "op1_license_scan": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), {PAIRS}), {WORDS}) AS w FROM documents),
phrases(phrase, label) AS (VALUES {values(license_scan.PHRASES)}),
base AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x
 JOIN (SELECT string_split(phrase, ' ') AS ph, label FROM phrases) q ON x.w[i] = q.ph[1] AND x.w[i:i + len(ph) - 1] = q.ph),
based AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS own FROM base GROUP BY doc_id),
templates(words, label, needed) AS (VALUES {values((" ".join(sorted(set(t.split()))), label, needed(t)) for t, label in license_scan.TEMPLATES)}),
wanted AS (SELECT string_split(words, ' ') AS tokens, label, needed FROM templates),
vocabulary AS (SELECT list(DISTINCT x) AS v FROM (SELECT unnest(tokens) AS x FROM wanted)),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d),
held AS (SELECT doc_id, k, list_intersect(regexp_extract_all(translate(line, {PAIRS}), {WORDS}), v) AS h FROM lines, vocabulary),
found AS (SELECT * FROM held WHERE len(h) > 0),
blocks AS (SELECT doc_id, h FROM found UNION ALL SELECT a.doc_id, list_distinct(list_concat(a.h, b.h)) FROM found a JOIN found b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
met AS (SELECT doc_id, label, len(list_intersect(tokens, h)) / len(tokens) AS share FROM blocks, wanted WHERE len(list_intersect(tokens, h)) >= needed),
likely AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
 CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN based USING (doc_id) LEFT JOIN likely USING (doc_id)""",
    # targets with . or .. segments are left as they are here
    "op4_url_filter": rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, regexp_extract(url, '^([\s\S]*?)://', 1) AS scheme,
    translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), {PAIRS}) AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages),
tags AS (SELECT *, unnest(regexp_extract_all(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM parts WHERE host <> ''),
named AS (SELECT *, lower(trim(regexp_extract(tag, '(?i)\srel\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"'' ')) AS rel,
  replace(trim(regexp_extract(tag, '(?i)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"'' '), '&amp;', '&') AS href,
  lower(trim(regexp_extract(tag, '(?i)\shttp-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"'' ')) AS equiv,
  replace(trim(regexp_extract(tag, '(?i)\scontent\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"'' '), '&amp;', '&') AS content FROM tags),
targets AS (SELECT *, CASE WHEN lower(tag[:5]) = '<link' AND list_contains(regexp_split_to_array(rel, '\s+'), 'canonical') THEN href
  WHEN lower(tag[:5]) = '<meta' AND equiv = 'refresh' THEN trim(regexp_extract(content, '(?i)url\s*=\s*["'']?([^"''>]+)', 1)) END AS t FROM named),
whole AS (SELECT host, path, query, CASE WHEN t = '' OR t[1] = '#' THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN t[:2] = '//' THEN scheme || ':' || t WHEN t[1] = '/' THEN scheme || '://' || host || t WHEN t[1] = '?' THEN scheme || '://' || host || path || t
  ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^([\s\S]*/)', 1) END || t END AS u FROM targets WHERE t IS NOT NULL),
ends AS (SELECT host || CASE WHEN path = '' THEN '/' ELSE path END || query AS a, translate(regexp_extract(u, '^[\s\S]*?://([^/?#]*)', 1), {PAIRS}) AS h, regexp_extract(u, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS p,
  regexp_extract(u, '^[\s\S]*?://[^?#]*(\?[^#]*)', 1) AS q FROM whole WHERE u IS NOT NULL),
edges AS (SELECT a, h || CASE WHEN p = '' THEN '/' ELSE p END || q AS b, h, p FROM ends WHERE h <> ''),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
every AS (SELECT host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS node FROM parts UNION SELECT h, p, b FROM edges),
known AS (SELECT DISTINCT node, host, path FROM every),
rules(what, name, start) AS (VALUES {values(sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])))}),
ruled AS (SELECT node, host, path, (SELECT (name || start, what) FROM rules WHERE (host = name OR host LIKE '%.' || name) AND starts_with(path, start) ORDER BY len(name || start) DESC LIMIT 1) AS r FROM known),
judged AS (SELECT node, host, path, r[1] AS rule, r[2] AS own FROM ruled),
aliases AS (SELECT reach.a AS node, min(own) AS alias FROM reach JOIN judged ON judged.node = reach.b GROUP BY reach.a)
SELECT page_id, parts.host, parts.path, rule, coalesce(own, alias, 'allow') AS verdict
FROM parts LEFT JOIN judged ON judged.host = parts.host AND judged.path = parts.path AND judged.node = parts.host || CASE WHEN parts.path = '' THEN '/' ELSE parts.path END || parts.query
LEFT JOIN aliases ON aliases.node = judged.node""",
    "op9_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {PAIRS}), {WORDS}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, {PAIRS}), {WORDS}) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {PAIRS}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
linked AS (SELECT a, b FROM common JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_id AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id)::BIGINT AS component_id FROM d LEFT JOIN sized USING (doc_id) LEFT JOIN least_id USING (doc_id)""",
    "op7_nearest_vectors": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}
