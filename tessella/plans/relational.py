"""Queries on manifests: gates, funnels, dedupe, joins, aggregates and reports. Seconds are n_chars / 15."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedupe, gates
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


def seconds():
    return F.col("n_chars") / 15.0


@query("""
WITH r AS (SELECT d.source, d.n_chars / 15.0 AS s,
  lower(trim(d.lang)) IN ('en', 'de') AS g1, d.n_chars / 15.0 BETWEEN 5 AND 600 AS g2, trim(d.text) <> '' AS g3, coalesce(l.quality >= 1, true) AS g4
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS n_in, round(sum(s) / 3600, 6) AS hours_in,
  count(*) FILTER (g1) AS n_lang, round(sum(CASE WHEN g1 THEN s ELSE 0 END) / 3600, 6) AS hours_lang,
  count(*) FILTER (g1 AND g2) AS n_duration, round(sum(CASE WHEN g1 AND g2 THEN s ELSE 0 END) / 3600, 6) AS hours_duration,
  count(*) FILTER (g1 AND g2 AND g3) AS n_text, round(sum(CASE WHEN g1 AND g2 AND g3 THEN s ELSE 0 END) / 3600, 6) AS hours_text,
  count(*) FILTER (g1 AND g2 AND g3 AND g4) AS n_quality, round(sum(CASE WHEN g1 AND g2 AND g3 AND g4 THEN s ELSE 0 END) / 3600, 6) AS hours_quality
FROM r GROUP BY source""")
def manifest_gate_funnel(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return gates.funnel(docs, {"lang": gates.language_in(F.col("lang"), "en", "de"), "duration": gates.in_range(seconds(), 5, 600), "text": gates.has_text(F.col("text")), "quality": gates.at_least(F.col("quality"), 1)}, "source", seconds())


@query("SELECT source, count(*) AS n, round(sum(n_chars / 15.0) / 3600, 6) AS hours, round(sum(n_chars) * 1.0 / sum(sum(n_chars)) OVER (), 8) AS share FROM documents GROUP BY source")
def source_hours_share(spark, d):
    from pyspark.sql import Window

    sums = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return sums.select("source", "n", F.round(F.col("c") / 15.0 / 3600, 6).alias("hours"), F.round(F.col("c") * 1.0 / F.sum("c").over(Window.partitionBy(F.lit(0))), 8).alias("share"))


@query("SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source)")
def source_rollup_total(spark, d):
    return table(spark, d, "documents").rollup("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "n", "chars")


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_text_dedupe_first_seen(spark, d):
    return dedupe.first_seen(table(spark, d, "documents").select("doc_id", "source", "lang", F.md5("text").alias("h")), [F.col("h")], ["doc_id"]).drop("h")


@query("SELECT substr(sha256(lower(text)), 1, 16) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(tx.hash_prefix(F.lower("text"), 16).alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def left_anti_archived(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def left_semi_valid(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality >= 1, true)")
def missing_metric_passes_gate(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where(gates.at_least(F.col("quality"), 1))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality >= 1 AND l.toxic = 0")
def missing_metric_fails_gate(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.where(gates.at_least(F.col("quality"), 1, missing=False) & gates.at_most(F.col("toxic"), 0, missing=False)).select("doc_id")


@query("""
WITH w AS (SELECT d.source, d.n_chars / 15.0 / 3600 * CASE WHEN l.doc_id IS NULL THEN 0.5 WHEN l.quality = 1 THEN 2.0 ELSE 1.0 END AS w,
  CASE WHEN l.doc_id IS NULL THEN 'pseudo' WHEN l.quality = 1 THEN 'human' ELSE 'script' END AS bucket FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT bucket, round(sum(w) / sum(sum(w)) OVER (), 6) AS weight FROM w GROUP BY bucket""")
def bucket_weights_normalised(spark, d):
    from pyspark.sql import Window

    joined = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").withColumn("there", F.lit(1)), "doc_id", "left")
    bucket = F.when(F.col("there").isNull(), "pseudo").when(F.col("quality") == 1, "human").otherwise("script")
    weight = F.element_at(F.create_map(F.lit("pseudo"), F.lit(0.5), F.lit("human"), F.lit(2.0), F.lit("script"), F.lit(1.0)), F.col("bucket"))
    sums = joined.withColumn("bucket", bucket).groupBy("bucket").agg(F.sum(seconds() / 3600 * weight).alias("w"))
    return sums.select("bucket", F.round(F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))), 6).alias("weight"))


@query("SELECT CAST(unnest([0.01, 0.05, 0.5, 0.9, 0.95, 0.99]) AS DOUBLE) AS q, round(unnest(quantile_cont(n_chars / 15.0, [0.01, 0.05, 0.5, 0.9, 0.95, 0.99])), 6) AS seconds FROM documents")
def duration_quantiles(spark, d):
    shares = [0.01, 0.05, 0.5, 0.9, 0.95, 0.99]
    exact = table(spark, d, "documents").agg(F.percentile(seconds(), F.array(*map(F.lit, shares))).alias("p"))
    return exact.select(F.posexplode("p").alias("k", "seconds")).select(F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1).alias("q"), F.round("seconds", 6).alias("seconds"))


@query("""
WITH b AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(n_chars / 15.0, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 3)))) AS bins FROM documents)
SELECT len(list_filter(bins, lambda x: x <= n_chars / 15.0)) AS bin, count(*) AS n FROM documents, b GROUP BY 1""")
def duration_quantile_bins(spark, d):
    docs = table(spark, d, "documents")
    shares = [k / 10 for k in range(1, 10)]
    bins = docs.agg(F.array_sort(F.array_distinct(F.transform(F.percentile(seconds(), F.array(*map(F.lit, shares))), lambda x: F.round(x, 3)))).alias("bins"))
    return docs.crossJoin(F.broadcast(bins)).groupBy(F.size(F.filter("bins", lambda b: b <= seconds())).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(*) AS n, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def group_p50_p90_stats(spark, d):
    q = F.percentile("l_quantity", F.array(F.lit(0.5), F.lit(0.9)))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), q.alias("q"), F.round(F.avg("l_quantity"), 6).alias("mean")).select("l_suppkey", "n", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p90"), "mean")


@query("SELECT event_type, quantile_disc(value, 0.9) AS p90 FROM (SELECT event_type, value FROM events WHERE value IS NOT NULL) GROUP BY 1")
def nearest_rank_quantile(spark, d):
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"))


@query("""
WITH m AS (SELECT median(n_chars * 1.0 / (1 + len(string_split(text, ' ')))) AS med FROM documents)
SELECT CASE WHEN r < med * 0.85 THEN 'slow' WHEN r > med * 1.15 THEN 'fast' ELSE 'moderate' END AS pace, count(*) AS n
FROM (SELECT n_chars * 1.0 / (1 + len(string_split(text, ' '))) AS r FROM documents), m GROUP BY 1""")
def pace_bucket_vs_median(spark, d):
    rate = table(spark, d, "documents").select((F.col("n_chars") * 1.0 / (1 + F.size(F.split("text", " ")))).alias("r"))
    med = rate.agg(F.median("r").alias("med"))
    return rate.crossJoin(F.broadcast(med)).groupBy(F.when(F.col("r") < F.col("med") * 0.85, "slow").when(F.col("r") > F.col("med") * 1.15, "fast").otherwise("moderate").alias("pace")).agg(F.count("*").alias("n"))


@query("""
SELECT d.doc_id, concat_ws('; ', CASE WHEN NOT (d.n_chars >= 200) THEN 'short' END, CASE WHEN NOT (d.lang = 'en') THEN 'language' END, CASE WHEN NOT coalesce(l.quality >= 1, false) THEN 'quality' END) AS reject_reason,
  d.n_chars >= 200 AND d.lang = 'en' AND coalesce(l.quality >= 1, false) AS passed FROM documents d LEFT JOIN labels l USING (doc_id)""")
def reject_reason_concat(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reason = gates.joined_reasons((F.col("n_chars") >= 200, "short"), (F.col("lang") == "en", "language"), (F.col("quality") >= 1, "quality"))
    return joined.select("doc_id", reason.alias("reject_reason")).withColumn("passed", F.col("reject_reason") == "")


@query("""
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'A' WHEN quality = 1 THEN 'B' ELSE '-' END AS tier,
  CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'quality' WHEN n_chars < 100 THEN 'short' ELSE '' END AS drop_reason FROM documents LEFT JOIN labels USING (doc_id)""")
def tier_assignment(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "A").when(F.col("quality") == 1, "B").otherwise("-")
    return joined.select("doc_id", tier.alias("tier"), gates.first_reason((F.col("quality").isNull(), "unlabelled"), (F.col("quality") == 0, "quality"), (F.col("n_chars") < 100, "short")).alias("drop_reason"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, 9) AS quality, coalesce(d.n_chars, -1) AS n_chars FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN labels l USING (doc_id)")
def full_outer_score_merge(spark, d):
    left = table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", "n_chars")
    return left.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "full_outer").select("doc_id", F.coalesce("quality", F.lit(9)).alias("quality"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query("""
WITH b AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT user_id, event_type, round(value, 6) AS value FROM b""")
def last_write_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dedupe.last_written(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_prop_extract(spark, d):
    return table(spark, d, "events").where("props is not null").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
WITH m AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, round(max(v) FILTER (event_type LIKE 'c%'), 6) AS worst, coalesce(max(v) FILTER (event_type LIKE 'c%') <= 90, true) AS passed FROM m GROUP BY 1""")
def map_max_gate(spark, d):
    best = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    metrics = best.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    worst = gates.worst_metric(F.col("m"), "c")
    return metrics.select("user_id", F.round(worst, 6).alias("worst"), gates.at_most(worst, 90).alias("passed"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.event_id < e.event_id)")
def done_key_anti_join(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("event_id")


@query("SELECT event_type, count(*) AS done, round(sum(value), 4) AS spent, sum(value) >= 100000 AS reached FROM events GROUP BY 1")
def resume_state(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("done"), F.round(F.sum("value"), 4).alias("spent"), (F.sum("value") >= 100000).alias("reached"))


@query("SELECT d.doc_id, substr(sha256(concat(d.source, '/', d.doc_id)), 1, 12) AS opaque_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def idmap_backfill(spark, d):
    made = table(spark, d, "documents").select("doc_id", tx.hash_prefix(F.concat_ws("/", "source", "doc_id"), 12).alias("opaque_id"))
    return made.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
WITH p AS (SELECT user_id, event_type, count(*) FILTER (value >= 50) AS k, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, min(k) AS k_min, max(k) AS k_max, round(avg(k * 1.0 / n), 6) AS kept, count(*) FILTER (k > 0 AND k < n) AS unstable FROM p GROUP BY 1""")
def retention_two_level(spark, d):
    probes = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") >= 50).alias("k"), F.count("*").alias("n"))
    return probes.groupBy("event_type").agg(F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.round(F.avg(F.col("k") * 1.0 / F.col("n")), 6).alias("kept"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("unstable"))


@query("SELECT CASE WHEN value >= 80 THEN 'kept' WHEN value >= 40 THEN 'fallback' WHEN value IS NULL THEN 'error' ELSE 'dropped' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def funnel_by_outcome(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.when(v >= 80, "kept").when(v >= 40, "fallback").when(v.isNull(), "error").otherwise("dropped").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, i AS copy FROM documents JOIN labels USING (doc_id), range(1, 4) t(i) WHERE i <= CASE WHEN quality = 1 THEN 3 ELSE 1 END")
def upsample_explode(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return joined.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("quality") == 1, 3).otherwise(1).cast("long"))).alias("copy"))


@query("SELECT doc_id, e AS emotion FROM documents, (VALUES (0, 'angry'), (1, 'calm'), (2, 'happy'), (3, 'sad')) t(i, e) WHERE substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '3' OR i = doc_id % 4")
def contrastive_fanout(spark, d):
    names = F.array(*map(F.lit, ["angry", "calm", "happy", "sad"]))
    every = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "3"
    return table(spark, d, "documents").select("doc_id", F.explode(F.when(every, names).otherwise(F.array(F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int"))))).alias("emotion"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_returnflag <> 'N'), abs(l_quantity - 5), l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def nearest_target_pick(spark, d):
    rank = F.struct((F.col("l_returnflag") != "N").alias("a"), F.abs(F.col("l_quantity") - 5).alias("b"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(rank).alias("r")).select("l_suppkey", "r.l_orderkey", "r.l_linenumber")


@query("""
SELECT 'known_languages' AS name, 'FAIL' AS severity, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS bad FROM documents
UNION ALL SELECT 'empty_text', 'FAIL', count(*) FILTER (trim(text) = '') FROM documents
UNION ALL SELECT 'repeated_id', 'FAIL', count(*) - count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'too_long', 'WARN', count(*) FILTER (n_chars > 10000) FROM documents
UNION ALL SELECT 'label_without_document', 'FAIL', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""")
def quality_checks(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    one = docs.agg(F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("known_languages"), F.count_if(F.trim("text") == "").alias("empty_text"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated_id"), F.count_if(F.col("n_chars") > 10000).alias("too_long"))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.col(n).alias("bad")) for n, s in (("known_languages", "FAIL"), ("empty_text", "FAIL"), ("repeated_id", "FAIL"), ("too_long", "WARN"))))
    lost = labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("bad")).select(F.lit("label_without_document").alias("name"), F.lit("FAIL").alias("severity"), "bad")
    return one.select(F.inline(rows)).unionByName(lost)


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def inner_join_report(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice * (1 - l_discount)), 4) AS net FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def priced_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 10")
def top_k_value_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "lang").limit(10)


@query("SELECT source, round(max(n) * 1.0 / sum(n), 6) AS mode_share, count(*) AS n_values FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def mode_share(spark, d):
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.round(F.max("n") * 1.0 / F.sum("n"), 6).alias("mode_share"), F.count("*").alias("n_values"))


@query("SELECT source, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) AS en, round(avg(CASE WHEN lang = 'de' THEN 1.0 ELSE 0.0 END), 6) AS de FROM documents GROUP BY 1")
def two_key_pivot_report(spark, d):
    counts = table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)
    total = F.col("de") + F.col("en") + F.col("es") + F.col("fr")
    return counts.select("source", F.round(F.col("en") / total, 6).alias("en"), F.round(F.col("de") / total, 6).alias("de"))


@query("SELECT exp(avg(ln(o_totalprice / 100000))) > 0 AS ok, round(exp(avg(ln(o_totalprice / 100000))), 6) AS geometric_mean, round(median(abs(ln(o_totalprice / 100000))), 6) AS median_abs_log, round(avg(ln(o_totalprice / 100000)), 6) AS bias FROM orders WHERE o_totalprice > 0")
def log_ratio_stats(spark, d):
    r = F.ln(F.col("o_totalprice") / 100000)
    return table(spark, d, "orders").where("o_totalprice > 0").agg((F.exp(F.avg(r)) > 0).alias("ok"), F.round(F.exp(F.avg(r)), 6).alias("geometric_mean"), F.round(F.median(F.abs(r)), 6).alias("median_abs_log"), F.round(F.avg(r), 6).alias("bias"))


@query("SELECT o_custkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def weighted_mean(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("weighted_mean"))


@query("SELECT s.l_suppkey, 'p' || (s.l_suppkey % 3) AS variant, coalesce(m.kind, 'pseudo') AS label_kind FROM (SELECT DISTINCT l_suppkey FROM lineitem) s LEFT JOIN (VALUES (0, 'human'), (1, 'script')) m(k, kind) ON s.l_suppkey % 5 = m.k")
def literal_enrichment(spark, d):
    kinds = F.create_map(F.lit(0), F.lit("human"), F.lit(1), F.lit("script"))
    keys = table(spark, d, "lineitem").select("l_suppkey").distinct()
    return keys.select("l_suppkey", F.concat(F.lit("p"), F.pmod("l_suppkey", F.lit(3)).cast("string")).alias("variant"), F.coalesce(F.try_element_at(kinds, F.pmod("l_suppkey", F.lit(5)).cast("int")), F.lit("pseudo")).alias("label_kind"))


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS name, count(*) AS n FROM pages GROUP BY 1, 2")
def path_parts(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), tx.file_name(F.col("url")).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS shared, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT source FROM documents UNION SELECT lang FROM documents)) AS either")
def set_operations(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    shared = docs.select("doc_id").intersect(labels.select("doc_id")).agg(F.count("*").alias("shared"))
    missing = docs.select("doc_id").exceptAll(labels.select("doc_id")).distinct().agg(F.count("*").alias("missing"))
    either = docs.select("source").union(docs.select("lang")).distinct().agg(F.count("*").alias("either"))
    return shared.crossJoin(missing).crossJoin(either)


@query(None)
def dual_key_dedupe_ordered(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_orderkey", "l_partkey")
    return dedupe.admitted_by_either_key(rows, "l_orderkey", "l_partkey", "row_id")
