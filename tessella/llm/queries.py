"""Queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .decontaminate import leaked_items
from .fingerprints import fingerprint_edits
from .jaccard_join import jaccard_components
from .language_id import language_query
from .packing import pack_documents
from .quality import quality_query
from .secrets import secrets_query
from .sharding import assign_shards
from .substring_dedup import remove_repeats
from .token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_query(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_fingerprints": op4_fingerprints,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
m AS (SELECT h, min(doc_id) AS d FROM p GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN m USING (h) WHERE m.d < doc_id),
a AS (SELECT t.doc_id, count(*) FILTER (c.k IS NOT NULL) AS gone, coalesce(string_agg(t.word, ' ' ORDER BY t.k) FILTER (c.k IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w) t LEFT JOIN c ON c.doc_id = t.doc_id AND c.k = t.k GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)""",
    "op10_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.other)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, (SELECT min(other) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s""",
}
