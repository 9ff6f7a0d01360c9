"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprint, language_id, license_scan, lm, near_dedup, periodic, substring_dedup, suffix_dedup, topk, url_filter, whitening
from .text import documents

QUERIES = {}
ORACLE: dict[str, str] = {}

#: The rules of the url query.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_prediction(documents(spark, sf_dir))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), items)


ORACLE["op2_decontaminate"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (  -- an item of fewer than five words is one run, all of them
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
  FROM item_words
), sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id
), widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM item_words WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g
  FROM doc_words, widths
), common AS (
  SELECT doc_id, item_id, count(*) AS n_common FROM grams JOIN items USING (g) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item::DOUBLE AS containment
FROM common JOIN sizes USING (item_id) WHERE 100 * n_common >= 80 * n_item
"""


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"), URL_RULES)


ORACLE["op3_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/' END AS rule
  FROM urls
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_strings(documents(spark, sf_dir))


ORACLE["op4_suffix_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), strings AS (
  SELECT doc_id, i, md5_number(substr(x, (2 * i + 1)::BIGINT, 100)) AS g
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM raw)
), first AS (
  SELECT g, min(doc_id) AS least FROM strings GROUP BY g
), gone AS (
  SELECT doc_id, i FROM strings JOIN first USING (g) WHERE doc_id > least
), ordered AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM ordered
), spans AS (
  SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM runs GROUP BY doc_id, run
), between_spans AS (
  SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS from_byte, e FROM spans
), kept AS (
  SELECT k.doc_id, count(*) AS n_spans, sum(k.e - k.s) AS n_removed, max(k.e) AS tail,
         string_agg(substr(x, (2 * from_byte + 1)::BIGINT, (2 * (s - from_byte))::BIGINT), '' ORDER BY s) AS head
  FROM between_spans k JOIN raw USING (doc_id) GROUP BY k.doc_id
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, (2 * coalesce(tail, 0) + 1)::BIGINT))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)
"""


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE["op5_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
         unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS g
  FROM split
), first AS (
  SELECT g, min(doc_id) AS least FROM windows GROUP BY g
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS js
  FROM windows JOIN first USING (g) WHERE doc_id > least GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM split
), flat AS (
  SELECT doc_id, unnest(js) AS j FROM gone
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN flat USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


@query
def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(documents(spark, sf_dir))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


@query
def op8_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


ORACLE["op8_setsketch_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM split
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS i
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * i >= 85 * (na + nb - i)
), reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = sets.doc_id AS kept
FROM sets JOIN reach ON sets.doc_id = reach.doc_id
GROUP BY sets.doc_id, s
"""


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                public_tokenizers.PATTERN)


@query
def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(documents(spark, sf_dir))


@query
def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return topk.exact_top_k(vectors, vectors["vec_id"] % 20 == 0)


ORACLE["op11_exact_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.collapse_edited(documents(spark, sf_dir))


ORACLE["op13_periodic_runs"] = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
         list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
           list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc
  FROM documents
), checked AS (
  SELECT r, doc_id, w0, len(w0) AS n, xor(crc, 4294967295) AS h FROM split
), folds AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS g8 FROM checked
), periods AS (
  SELECT *, 1 + (n - a) // (3 + g8) AS p FROM folds
), texts AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) END AS w
  FROM periods
), grams AS (
  SELECT r, n, unnest(range(n - 15)) AS i, unnest(list_transform(range(n - 15), lambda i: md5_number(array_to_string(w[i + 1:i + 16], ' ')))) AS g
  FROM texts WHERE n >= 24
), lags AS (
  SELECT DISTINCT x.r, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), diagonals AS (
  SELECT l.r, q, unnest(list_filter(range(n - q + 1), lambda i: i = n - q OR w[i + 1] <> w[i + q + 1])) AS b FROM lags l JOIN texts t ON l.r = t.r
), stretches AS (
  SELECT r, q, coalesce(lag(b) OVER (PARTITION BY r, q ORDER BY b), -1) + 1 AS s, b + q AS e FROM diagonals
), runs AS (
  SELECT r, s, e - s AS len, min(q) AS q FROM stretches WHERE e - s >= greatest(24, 3 * q) GROUP BY r, s, e
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY r
), pairs AS (  -- lengths and periods are below 10,000,000, so unequal ratios differ by more than a double's error
  SELECT r, s, len, q, row_number() OVER (PARTITION BY r ORDER BY len / q DESC, s, q) AS nth FROM runs
), gone AS (
  SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs
), flat AS (
  SELECT r, unnest(range(n)) AS i, unnest(w) AS x FROM texts
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n_kept FROM flat ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT t.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, p.s::BIGINT AS start, p.len::BIGINT AS length, p.q::BIGINT AS period,
       (1000 * p.len // p.q)::BIGINT AS exponent_milli, sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256,
       t.n::BIGINT AS n_words, (t.n - coalesce(k.n_kept, 0))::BIGINT AS n_dropped
FROM texts t LEFT JOIN listed l ON t.r = l.r LEFT JOIN pairs p ON t.r = p.r AND p.nth = 1 LEFT JOIN kept k ON t.r = k.r
"""
