"""Queries on orders: budgets, round robin, caps, strides, splits, shards, intervals and matched series.

Shuffles are replaced by the order of md5(id), which is the same in every engine and on every run.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, sample
from ..operators.ordered import budget_prefix, hash_bucket, range_bucket, with_running
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


def hashed(df, key="doc_id"):
    return df.withColumn("h", F.md5(F.col(key).cast("string")))


@query("""
WITH ne AS (SELECT sum(n_chars) AS c FROM documents WHERE lang = 'de'),
p AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents WHERE lang = 'en')
SELECT doc_id, n_chars FROM p, ne WHERE coalesce(before, 0) < ne.c * 0.4 / 0.6""")
def lang_budget_mix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    budget = docs.where("lang = 'de'").agg((F.sum("n_chars") * 0.4 / 0.6).alias("budget"))
    pool = hashed(docs.where("lang = 'en'")).crossJoin(F.broadcast(budget))  # one row
    return budget_prefix(pool, [F.col("h"), F.col("doc_id")], hash_bucket(F.col("h")), F.col("n_chars"), F.col("budget")).select("doc_id", "n_chars")


@query("""
WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents),
p AS (SELECT *, sum(n_chars) OVER (ORDER BY turn, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT doc_id, source, turn FROM p WHERE coalesce(before, 0) < 500000""")
def round_robin_source_budget(spark, d):
    docs = hashed(table(spark, d, "documents").select("doc_id", "source", "n_chars"))
    return sample.round_robin_budget(docs, "source", [F.col("h"), F.col("doc_id")], hash_bucket(F.col("h")), "n_chars", 500000).select("doc_id", "source", "turn")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 3")
def per_group_cap(spark, d):
    return sample.cap_per_group(hashed(table(spark, d, "documents").select("doc_id", "source")), ["source"], ["h", "doc_id"], 3).select("doc_id", "source")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(concat(l_orderkey, '-', l_linenumber)), l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def one_per_group(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("h"))
    return sample.cap_per_group(rows, ["l_suppkey"], ["h", "l_orderkey", "l_linenumber"], 1).drop("h")


@query("""
WITH q AS (SELECT doc_id, lang, md5(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents),
t AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rest FROM q WHERE rn > 20)
SELECT doc_id, lang FROM q WHERE rn <= 20 UNION ALL SELECT doc_id, lang FROM t WHERE rest <= 100 - (SELECT count(*) FROM q WHERE rn <= 20)""")
def stratified_quota_topup(spark, d):
    return sample.quota_with_topup(hashed(table(spark, d, "documents").select("doc_id", "lang")), "lang", "h", "doc_id", 20, 100).select("doc_id", "lang")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 1) % 7 = 0")
def stride_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return with_running(docs, [F.col("doc_id")], range_bucket(docs, "doc_id")).where("(rn - 1) % 7 = 0").select("doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 8 AS shard FROM documents")
def shard_assign(spark, d):
    docs = hashed(table(spark, d, "documents").select("doc_id"))
    return with_running(docs, [F.col("h"), F.col("doc_id")], hash_bucket(F.col("h"))).select("doc_id", ((F.col("rn") - 1) % 8).alias("shard"))


@query("SELECT conv_id, turn, CASE WHEN substr(md5(CAST(conv_id AS VARCHAR)), 1, 2) < '1a' THEN 'valid' ELSE 'train' END AS split FROM conversations")
def group_split_no_leak(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 2) < "1a", "valid").otherwise("train").alias("split"))


@query("""
SELECT doc_id, CASE WHEN rn <= n * 0.8 THEN 'train' WHEN rn <= n * 0.9 THEN 'valid' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, (SELECT count(*) FROM documents) AS n FROM documents)""")
def hash_split_80_10_10(spark, d):
    docs = hashed(table(spark, d, "documents").select("doc_id"))
    n = F.lit(docs.count())
    share = F.when(F.col("rn") <= n * 0.8, "train").when(F.col("rn") <= n * 0.9, "valid").otherwise("test")
    return with_running(docs, [F.col("h"), F.col("doc_id")], hash_bucket(F.col("h"))).select("doc_id", share.alias("split"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 50")
def reservoir_sample(spark, d):
    return hashed(table(spark, d, "documents").select("doc_id")).orderBy("h", "doc_id").limit(50).select("doc_id")


@query("""
WITH p AS (SELECT doc_id, source, strlen(text) AS b, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents)
SELECT doc_id, source, CAST(floor(coalesce(before, 0) / 65536.0) AS BIGINT) AS shard FROM p""")
def byte_budget_shards(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").alias("b"))
    run = with_running(docs, [F.col("doc_id")], range_bucket(docs, "doc_id"), F.col("b"), groups=["source"])
    return run.select("doc_id", "source", F.floor(F.col("before") / 65536.0).cast("long").alias("shard"))


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 128.0) AS BIGINT) AS shard FROM documents")
def rowcount_shards(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return with_running(docs, [F.col("doc_id")], range_bucket(docs, "doc_id")).select("doc_id", F.floor((F.col("rn") - 1) / 128.0).cast("long").alias("shard"))


@query("SELECT user_id, round(max(gap), 3) AS widest, count(*) FILTER (gap > 3600) AS breaks FROM (SELECT user_id, epoch(lead(ts) OVER w) - epoch(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def turn_gap_lead(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    gap = F.unix_micros(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rows.withColumn("gap", gap).groupBy("user_id").agg(F.round(F.max("gap"), 3).alias("widest"), F.count_if(F.col("gap") > 3600).alias("breaks"))


@query("""
WITH e AS (SELECT user_id, epoch(ts) AS a, epoch(ts) + 1800 AS b FROM events),
o AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, round(min(a), 3) AS start, round(max(b), 3) AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def turn_islands(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").select("user_id", at.alias("a"), (at + 1800).alias("b"))
    return intervals.merged_intervals(rows, ["user_id"], "a", "b").select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query("SELECT conv_id, count(*) AS turns, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS script FROM conversations GROUP BY 1")
def conversation_assemble(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(turns["line"], "\n").alias("script"))


@query("""
WITH s AS (SELECT user_id % 3 AS run, date_trunc('day', ts) AS step, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT CAST(a.step AS VARCHAR)[:10] AS step, round(a.v, 6) AS run0, round(b.v, 6) AS run1, round(c.v, 6) AS run2,
  CASE WHEN a.v IS NULL OR b.v IS NULL OR c.v IS NULL THEN 'incomplete' WHEN abs(a.v - b.v) < abs(a.v - c.v) THEN 'run1' ELSE 'run2' END AS nearer
FROM (SELECT step, v FROM s WHERE run = 0) a LEFT JOIN (SELECT step, v FROM s WHERE run = 1) b USING (step) LEFT JOIN (SELECT step, v FROM s WHERE run = 2) c USING (step)""")
def matched_step_curves(spark, d):
    runs = table(spark, d, "events").withColumn("run", F.pmod("user_id", F.lit(3)).cast("int")).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("step")).pivot("run", [0, 1, 2]).agg(F.avg("value"))
    a, b, c = F.col("0"), F.col("1"), F.col("2")
    nearer = F.when(a.isNull() | b.isNull() | c.isNull(), "incomplete").when(F.abs(a - b) < F.abs(a - c), "run1").otherwise("run2")
    return runs.where(a.isNotNull()).select("step", F.round(a, 6).alias("run0"), F.round(b, 6).alias("run1"), F.round(c, 6).alias("run2"), nearer.alias("nearer"))


@query("""
SELECT user_id, max(event_id) FILTER (lo = 1) AS lowest_at, round(min(value), 6) AS lowest, max(event_id) FILTER (hi = 1) AS highest_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS lo, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS hi FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def argmin_step(spark, d):
    at = F.struct("value", "event_id")
    return table(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.min_by("event_id", at).alias("lowest_at"), F.round(F.min("value"), 6).alias("lowest"), F.max_by("event_id", at).alias("highest_at"))


@query("""
WITH steps AS (SELECT unnest([1000.5, 2000.25, 3000.75, 4000.5, 5000.125]) AS step), e AS (SELECT event_id, event_id * 1.7 AS place FROM events)
SELECT CAST(step AS DOUBLE) AS step, event_id AS nearest FROM (SELECT step, event_id, row_number() OVER (PARTITION BY step ORDER BY abs(place - step), event_id) AS rn FROM steps JOIN e ON abs(place - step) < 200) WHERE rn = 1""")
def nearest_step_lookup(spark, d):
    """All events, at places between which the steps fall."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 1.7).alias("place"))
    steps = spark.createDataFrame([(s,) for s in (1000.5, 2000.25, 3000.75, 4000.5, 5000.125)], "step double")
    left = steps.select("step", F.explode(F.sequence(F.floor(F.col("step") / 200) - 1, F.floor(F.col("step") / 200) + 1)).alias("bucket"))
    gap = F.abs(F.col("place") - F.col("step"))
    joined = left.join(e.withColumn("bucket", F.floor(F.col("place") / 200)), "bucket").where(gap < 200)
    return joined.groupBy("step").agg(F.min(F.struct(gap.alias("gap"), "event_id")).alias("r")).select("step", F.col("r.event_id").alias("nearest"))


@query("""
WITH v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE label = 0),
t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents)
SELECT t.doc_id, v.vec_id FROM t JOIN v ON t.k % (SELECT count(*) FROM v) = v.k""")
def round_robin_assign(spark, d):
    docs, refs = table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").where("label = 0").select("vec_id")
    left = with_running(docs, [F.col("doc_id")], range_bucket(docs, "doc_id")).select("doc_id", (F.col("rn") - 1).alias("k"))
    right = with_running(refs, [F.col("vec_id")], range_bucket(refs, "vec_id")).select("vec_id", (F.col("rn") - 1).alias("slot"))
    n = F.lit(refs.count())
    return left.withColumn("slot", F.col("k") % n).join(right, "slot").select("doc_id", "vec_id")


@query("""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings)
SELECT a.vec_id, b.vec_id AS next_id FROM r a JOIN r b ON b.k = (a.k + 1) % a.n""")
def rotated_self_join(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id")
    n = F.lit(rows.count())
    k = with_running(rows, [F.col("vec_id")], range_bucket(rows, "vec_id")).select("vec_id", (F.col("rn") - 1).alias("k"))
    return k.select("vec_id", ((F.col("k") + 1) % n).alias("k")).join(k.select(F.col("vec_id").alias("next_id"), "k"), "k").select("vec_id", "next_id")


@query("SELECT doc_id, i AS chunk, CAST(i * 25.0 AS DOUBLE) AS start, CAST(least(i * 25.0 + 30, n_chars / 15.0) AS DOUBLE) AS \"end\" FROM documents, range(0, 3000) t(i) WHERE i < greatest(ceil((n_chars / 15.0 - 5) / 25), 1)")
def overlapped_chunks(spark, d):
    chunks = intervals.overlapped_chunks(F.col("n_chars") / 15.0)
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "c.start", "c.end")


@query("""
WITH s AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) AS r FROM embeddings)
SELECT vec_id, CAST(floor((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / 5) % 4 AS BIGINT) AS reference FROM embeddings""")
def reference_cycle(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    run = with_running(rows, [F.col("vec_id")], range_bucket(rows, "vec_id"), groups=["label"])
    return run.select("vec_id", (F.floor((F.col("rn") - 1) / 5) % 4).cast("long").alias("reference"))
