"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lmscore, packing, pii, quality, simhash, tokencount, topk, urlfilter
from .common import in_fold, outside_fold, table

VOCABULARY = "byte_bpe_50k.json"
#: The query's rules as (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ints = F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")))
    vectors = table(spark, sf_dir, "embeddings").where(usable).select("vec_id", ints.alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tries = langid.learn(docs.where(outside_fold("doc_id", 4, 2)))
    return langid.predict(docs, tries, in_fold("doc_id", 4, 2))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), outside_fold("doc_id", 3, 1))
    return quality.score(docs, model, in_fold("doc_id", 3, 1))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), outside_fold("doc_id", 7, 2), in_fold("doc_id", 7, 2))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.learn(docs))


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_language_id, op3_token_counts, op4_decontaminate, op5_url_filter, op6_simhash, op7_packing, op8_quality, op9_lm_score, op10_pii)}

ORACLE_SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         max(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT)) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op4_decontaminate": rf"""
WITH texts AS (
  SELECT 'd' AS src, row_number() OVER () AS row, doc_id AS id, coalesce(text, '') AS t FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, coalesce(text, '') FROM benchmark
), named AS (
  SELECT * REPLACE (regexp_replace(t, '(^|[^\p{{L}}\p{{N}}])([{decontaminate._UPPER}]\p{{Ll}}+)', '\1' || chr(1) || 'n\2', 'g') AS t) FROM texts
), numbered AS (
  SELECT * REPLACE (CASE WHEN regexp_matches(t, '[0-9]') THEN
    regexp_replace(regexp_replace(t, '(^|[^\p{{L}}\p{{N}}' || chr(1) || '])([0-9]+(?:[.,][0-9]+)*)', '\1 ' || chr(1) || 'd\2 ', 'g'),
      '([0-9] {{1,2}})({decontaminate.UNITS})($|[^\p{{L}}\p{{N}}])', '\1' || chr(1) || 'u\2\3', 'g') ELSE t END AS t) FROM named
), plain AS (
  SELECT src, row, id, trim(regexp_replace(regexp_replace(lower(t), '{decontaminate._PUNCTUATION}', '', 'g'), '[\x20\t\n\x0b\f\r]+', ' ', 'g')) AS s FROM numbered
), typed AS (
  SELECT *, regexp_replace(s, chr(1) || '([du])[^ ]*', chr(1) || '\1', 'g') AS y FROM plain WHERE s <> ''
), tokens AS (
  SELECT src, row, id, string_split(s, ' ') AS v, string_split(replace(y, chr(1) || 'n', ''), ' ') AS a,
         string_split(regexp_replace(y, chr(1) || 'n[^ ]*', chr(1) || 'n', 'g'), ' ') AS b
  FROM typed
), sizes AS (
  SELECT DISTINCT least(len(a), {decontaminate.WINDOW}) AS size FROM tokens WHERE src = 'b'
), starts AS (
  SELECT src, row, id, size, v, a, b, unnest(range(len(a) - size + 1)) AS pos FROM tokens, sizes
  WHERE CASE WHEN size < {decontaminate.SHORTEST} OR src = 'b' AND size < {decontaminate.WINDOW} THEN len(a) = size ELSE len(a) >= size END
), slices AS (
  SELECT src, row, id, size, pos, v[pos + 1 : pos + size] AS v, a[pos + 1 : pos + size] AS a, b[pos + 1 : pos + size] AS b FROM starts
), readings AS (
  SELECT src, row, id, size, pos, size || ':' || array_to_string(a, ' ') AS w, false AS by_value,
         list_transform(v, lambda x: CASE WHEN x[1] = chr(1) AND x[2] <> 'n' THEN x ELSE '' END) AS slots FROM slices
  UNION ALL
  SELECT src, row, id, size, pos, size || ':' || array_to_string(b, ' '), false, list_transform(v, lambda x: CASE WHEN x[1] = chr(1) THEN x ELSE '' END)
  FROM slices WHERE a <> b
  UNION ALL
  SELECT src, row, id, size, pos, 'v' || size || ':' || regexp_replace(array_to_string(v, ' '), chr(1) || '[dun]', '', 'g'), true, list_transform(v, lambda x: '') FROM slices
), filled AS (
  SELECT *, size - len(list_filter(slots, lambda x: x <> '')) AS words, min(CASE WHEN by_value THEN 99 ELSE size - len(list_filter(slots, lambda x: x <> '')) END) OVER (PARTITION BY row, pos) AS least
  FROM readings WHERE src = 'b'
), good AS (
  SELECT row, id, w, min(pos) AS ipos, arg_min(slots, pos) AS slots FROM filled
  WHERE CASE WHEN by_value THEN least < {decontaminate.LITERALS} ELSE words >= {decontaminate.LITERALS} END GROUP BY row, id, w
), bench AS (
  SELECT id AS item_id, w, ipos, slots AS item_slots FROM good
), totals AS (
  SELECT item_id, count(DISTINCT ipos) AS item_windows FROM bench GROUP BY item_id
), hits AS (
  SELECT r.row, r.id AS doc_id, item_id, ipos, pos, pos - ipos AS shift, r.slots = item_slots AS same,
         list_filter(list_transform(list_zip(item_slots, r.slots), lambda p: CASE WHEN p[1] <> '' THEN p[1] || chr(2) || p[2] END), lambda x: x IS NOT NULL) AS pairs
  FROM readings r JOIN bench USING (w) WHERE src = 'd'
), places AS (
  SELECT *, unnest([{{'kind': 0, 'at': shift}}, {{'kind': 1, 'at': CAST(floor(shift / {decontaminate.BAND}.0) AS BIGINT)}},
    {{'kind': 2, 'at': CAST(floor((shift + {decontaminate.BAND // 2}) / {decontaminate.BAND}.0) AS BIGINT)}}, {{'kind': 3, 'at': 0}}]) AS place FROM hits
), judged AS (
  SELECT row, doc_id, item_id, place, count(DISTINCT ipos) AS windows, min(pos) AS position, list_distinct(flatten(list(pairs))) AS pairs
  FROM places WHERE place.kind < 3 OR same GROUP BY row, doc_id, item_id, place
), found AS (
  SELECT row, doc_id, item_id, max(windows) AS windows, max(item_windows) AS item_windows, min(position) AS position, max(place.kind) < 3 AS reparameterised
  FROM judged JOIN totals USING (item_id)
  WHERE (place.kind = 3 OR len(list_distinct(list_transform(pairs, lambda p: split_part(p, chr(2), 1)))) = len(pairs)) AND windows >= 0.5 * item_windows
  GROUP BY row, doc_id, item_id
)
SELECT DISTINCT doc_id, item_id, windows, item_windows, position, reparameterised FROM found
""",
}
