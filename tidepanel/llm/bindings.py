"""The operators applied to their whole tables, for the driver's list of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import bitslice, bpe, crosstok, extract, hnsw, mixing, neardup, ppm, secrets, toxicity, urlrules, warc, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(_table(spark, folder, "pages"))


def op2_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_texts(_table(spark, folder, "pages"))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, folder, "documents"))


def op4_hnsw(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.near_vectors(_table(spark, folder, "embeddings"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.grade_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op8_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.score_documents(_table(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"))


def op10_bitslice(spark: SparkSession, folder: str) -> DataFrame:
    return bitslice.neighbours(_table(spark, folder, "embeddings"))


def op11_urlrules(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.filter_urls(_table(spark, folder, "pages"))


def op12_crosstok(spark: SparkSession, folder: str) -> DataFrame:
    return crosstok.align_documents(_table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_extract": op2_extract,
    "op3_secrets": op3_secrets,
    "op4_hnsw": op4_hnsw,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_neardup": op7_neardup,
    "op8_ppm": op8_ppm,
    "op9_bpe": op9_bpe,
    "op10_bitslice": op10_bitslice,
    "op11_urlrules": op11_urlrules,
    "op12_crosstok": op12_crosstok,
    "op13_whitening": op13_whitening,
}
REACH = """
reach(a, c) AS (SELECT id, id FROM nodes UNION SELECT e.a, r.c FROM edges e JOIN reach r ON e.b = r.a),
least AS (SELECT a, MIN(c) AS c FROM reach GROUP BY 1)"""
FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32 = " || ".join(
    f"substr('{ALPHABET}', 1 + ((CAST('0x' || substr(x, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31), 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)

ORACLE: dict[str, str] = {
    "op1_warc": f"""
WITH d AS (SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS x FROM pages),
m AS (SELECT x, MAX(page_id) AS top FROM d GROUP BY 1)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN m USING (x)""",
    "op4_hnsw": f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND {FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
edges AS (
  SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.id <> b.id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),{REACH},
n AS (SELECT a, COUNT(*) AS n FROM edges GROUP BY 1)
SELECT id AS vec_id, COALESCE(n, 0) AS n_links, c AS component_id, id = c AS kept
FROM nodes JOIN least l ON id = l.a LEFT JOIN n ON id = n.a""",
    "op7_neardup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
nodes AS (SELECT doc_id AS id FROM documents),
edges AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),{REACH}
SELECT id AS doc_id, COALESCE(n, 0) AS n_shingles, c AS component_id, id = c AS kept
FROM nodes JOIN least l ON id = l.a LEFT JOIN n ON id = n.doc_id""",
    "op10_bitslice": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND {FINITE}),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op11_urlrules": rf"""
WITH u AS (
  SELECT ROW_NUMBER() OVER () AS r, page_id, COALESCE(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urlrules.UPPER}', '{urlrules.LOWER}'), '') AS host,
    COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    COALESCE(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
list(verdict, h, p) AS (VALUES {", ".join(map(str, urlrules.RULES))}),
hits AS (
  SELECT r, arg_max(h || p, strlen(h || p)) AS rule, arg_max(verdict, strlen(h || p)) AS listed
  FROM u JOIN list ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
t AS (
  SELECT u.r, page_id, host, path, rule, listed, list_sort(list_distinct(list_concat(
    list_transform(regexp_extract_all(host, '{urlrules.WORDS}'), lambda w: 'h:' || w),
    list_transform(regexp_extract_all(translate(path, '{urlrules.UPPER}', '{urlrules.LOWER}'), '{urlrules.WORDS}'), lambda w: 'p:' || w),
    list_transform(regexp_extract_all(translate(query, '{urlrules.UPPER}', '{urlrules.LOWER}'), '{urlrules.WORDS}'), lambda w: 'q:' || w)))) AS tokens
  FROM u LEFT JOIN hits ON u.r = hits.r),
least AS (SELECT greatest({urlrules.MIN_ROWS}, ceil({urlrules.MIN_SUPPORT} * COUNT(*))) AS least FROM t WHERE listed IS NOT NULL),
often AS (
  SELECT token FROM (SELECT unnest(tokens) AS token FROM t WHERE listed IS NOT NULL) GROUP BY 1 HAVING COUNT(*) >= (SELECT least FROM least)),
kept AS (
  SELECT r, any_value(listed) AS listed, list(token ORDER BY token) AS f
  FROM (SELECT r, listed, unnest(tokens) AS token FROM t WHERE listed IS NOT NULL) JOIN often USING (token) GROUP BY r),
sets AS (
  SELECT listed, list_filter(f, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items
  FROM (SELECT listed, f, unnest(range(1, 1 << len(f))) AS m FROM kept)),
mined AS (
  SELECT items, COUNT(*) FILTER (listed = 'block') AS b, COUNT(*) FILTER (listed = 'allow') AS a, COUNT(*) AS n FROM sets GROUP BY 1),
rules AS (
  SELECT items, CASE WHEN b >= (SELECT least FROM least) AND b / n >= {urlrules.MIN_CONFIDENCE} THEN b / n ELSE 0 END AS b,
    CASE WHEN a >= (SELECT least FROM least) AND a / n >= {urlrules.MIN_CONFIDENCE} THEN a / n ELSE 0 END AS a FROM mined),
judged AS (
  SELECT t.r FROM t JOIN rules ON rule IS NULL AND a + b > 0 AND list_has_all(tokens, items) GROUP BY t.r HAVING MAX(b) > MAX(a))
SELECT page_id, host, path, rule, COALESCE(listed, CASE WHEN j.r IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM t LEFT JOIN judged j ON t.r = j.r""",
}
