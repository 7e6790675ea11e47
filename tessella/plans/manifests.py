"""Queries on manifest lines made from the tables: lenient parsing, pre-filters, per-source gates, sharding, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from ..sources import manifest, sinks
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def manifest_lines(spark, d):
    """One JSON line for each document; every tenth is cut short and does not parse."""
    row = F.to_json(F.struct(F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_filepath"), (F.col("n_chars") / 15.0).alias("duration"), "lang", "text"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.substring(row, 1, 30)).otherwise(row).alias("value"))


@query("SELECT doc_id, '/data/' || source || '/' || doc_id || '.wav' AS audio_filepath, lang FROM documents WHERE doc_id % 10 <> 3")
def lenient_jsonl_scan(spark, d):
    return manifest.parsed(manifest_lines(spark, d)).select("doc_id", "audio_filepath", "lang")


@query("SELECT count(*) AS lines, count(*) FILTER (doc_id % 10 = 3) AS bad FROM documents")
def bad_line_count(spark, d):
    return manifest.bad_lines(manifest_lines(spark, d))


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id % 10 <> 3")
def prefiltered_scan(spark, d):
    return manifest.parsed(manifest_lines(spark, d), pattern='"lang":"de"').select("doc_id")


@query("""
SELECT doc_id, 'long' AS source, 0 AS source_order FROM documents WHERE lang = 'en' AND n_chars >= 2000
UNION ALL SELECT doc_id, 'short', 1 FROM documents WHERE lang <> 'en' AND n_chars BETWEEN 100 AND 500""")
def multi_source_scan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    sources = [("long", docs.where("lang = 'en'"), lambda r: F.col("n_chars") >= 2000), ("short", docs.where("lang <> 'en'"), lambda r: gates.in_range(F.col("n_chars"), 100, 500))]
    return manifest.tagged_sources(sources).select("doc_id", "source", "source_order")


@query("SELECT source, count(*) AS clips, round(sum(n_chars) / 15.0 / 3600, 6) AS hours FROM documents WHERE lang = 'fr' AND doc_id % 10 <> 3 GROUP BY 1")
def inventory_without_parse(spark, d):
    """Count and hours by extracting two fields from the raw line."""
    lines = manifest_lines(spark, d).where(F.col("value").rlike('"lang":"fr"'))
    seconds = F.regexp_extract("value", '"duration":([0-9.E+-]+)', 1).cast("double")
    return lines.groupBy(F.regexp_extract("value", "/data/([^/]+)/", 1).alias("source")).agg(F.count("*").alias("clips"), F.round(F.sum(seconds) / 3600, 6).alias("hours"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'ne' END AS \"set\", event_id AS step, CASE WHEN event_id % 2 = 0 THEN 'flow_loss' ELSE 'kl' END AS metric, value AS reading FROM events")
def log_line_scan(spark, d):
    """A line of either sort for all events."""
    e, tagged = table(spark, d, "events"), F.col("event_id") % 2 == 0
    at, value = F.col("event_id").cast("string"), F.col("value").cast("string")
    line = F.when(tagged, F.concat(F.lit("valid[ne] @ step "), at, F.lit(": {'flow_loss': '"), value, F.lit("'}"))).otherwise(F.concat(F.lit("valid @ step "), at, F.lit(": {'kl': "), value, F.lit("}")))
    return manifest.training_log(e.select(line.alias("value")))


@query("SELECT conv_id || '-' || turn AS id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM conversations")
def transcript_scan(spark, d):
    lines = table(spark, d, "conversations").select(F.concat(F.concat_ws("-", "conv_id", "turn"), F.lit(" "), F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))).alias("value"))
    return manifest.transcripts(lines)


@query("SELECT source, shard, count(*) AS n FROM (SELECT source, CAST(floor(coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 40000) AS BIGINT) AS shard FROM documents) GROUP BY 1, 2")
def byte_shard_sizes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").alias("b"))
    return sinks.shard_by_bytes(docs, F.col("b"), "doc_id", 40000, "source").groupBy("source", "shard").agg(F.count("*").alias("n"))
