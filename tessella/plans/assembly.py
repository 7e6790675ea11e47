"""Queries that route, join, project and rank: the rest of the inventory's families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gates, joins, sample
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


@query("""
WITH old AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 3 <> 0)
SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.lang = d.lang THEN 'seed' ELSE 'changed' END AS route, count(*) AS n FROM documents d LEFT JOIN old o USING (doc_id) GROUP BY 1""")
def three_way_routing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    old = docs.where("doc_id % 3 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")))
    return joins.routed(docs, old, ["doc_id"], "lang").groupBy("route").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, round(l_quantity * 1.0001, 3) AS start FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, round(l_quantity + CASE WHEN l_linenumber = 2 THEN 1 ELSE l_quantity * 0.0001 END, 3) AS start FROM lineitem)
SELECT count(*) FILTER (b.start IS NOT NULL) AS reused, count(*) FILTER (b.start IS NULL) AS stale FROM a LEFT JOIN b USING (l_orderkey, l_linenumber, start)""")
def composite_key_reuse(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    a = line.select("l_orderkey", "l_linenumber", F.round(F.col("q") * 1.0001, 3).alias("start"))
    b = line.select("l_orderkey", "l_linenumber", F.round(F.col("q") + F.when(F.col("l_linenumber") == 2, 1.0).otherwise(F.col("q") * 0.0001), 3).alias("start"), F.lit(1).alias("there"))
    return a.join(b, ["l_orderkey", "l_linenumber", "start"], "left").agg(F.count_if(F.col("there").isNotNull()).alias("reused"), F.count_if(F.col("there").isNull()).alias("stale"))


@query("""
SELECT c_custkey, coalesce(a.o, b.o) AS o_orderkey, CASE WHEN a.o IS NOT NULL THEN 'large' WHEN b.o IS NOT NULL THEN 'any' END AS found_in FROM customer c
LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders WHERE o_totalprice > 300000 GROUP BY 1) a ON a.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders GROUP BY 1) b ON b.k = c_custkey""")
def candidate_fallback(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    large = orders.where("o_totalprice > 300000").groupBy("c_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    every = orders.groupBy("c_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return joins.first_match(table(spark, d, "customer").select("c_custkey"), "c_custkey", ("large", large), ("any", every), value="o_orderkey")


@query("SELECT a.doc_id, b.doc_id AS other FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents) b USING (r)")
def positional_zip(spark, d):
    """All documents by position with all documents in reverse."""
    docs = table(spark, d, "documents").select("doc_id")
    return joins.zipped(docs, docs.select(F.col("doc_id").alias("other"), (-F.col("doc_id")).alias("place")), "doc_id", "place").select("doc_id", "other")


@query("""
SELECT d.doc_id, d.lang, coalesce(o.prompt, a.prompt) AS prompt, o.prompt IS NOT NULL AS is_own FROM documents d
LEFT JOIN (SELECT doc_id, 'own-' || doc_id AS prompt FROM labels WHERE quality = 1) o USING (doc_id) LEFT JOIN (SELECT lang, 'any-' || min(doc_id) AS prompt FROM documents GROUP BY 1) a USING (lang)""")
def identity_or_language_fallback(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    own = table(spark, d, "labels").where("quality = 1").select("doc_id", F.concat_ws("-", F.lit("own"), "doc_id").alias("prompt"))
    anyone = docs.groupBy("lang").agg(F.concat_ws("-", F.lit("any"), F.min("doc_id").cast("string")).alias("prompt"))
    return joins.own_or_any(docs, own, "doc_id", anyone, "lang", "prompt").select("doc_id", "lang", "prompt", "is_own")


@query("""
SELECT v.variant, e.emotion, replace(replace('{v} voice, {e}: ', '{v}', v.variant), '{e}', e.emotion) || b.item_id AS caption
FROM (VALUES ('plain'), ('studio')) v(variant), (VALUES ('calm'), ('happy'), ('sad')) e(emotion), benchmark b""")
def caption_grid(spark, d):
    v, e = spark.createDataFrame([("plain",), ("studio",)], "variant string"), spark.createDataFrame([("calm",), ("happy",), ("sad",)], "emotion string")
    grid = joins.every_combination(table(spark, d, "benchmark").select("item_id"), v, e)
    return grid.select("variant", "emotion", F.concat(F.format_string("%s voice, %s: ", "variant", "emotion"), F.col("item_id").cast("string")).alias("caption"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 's3://raw/' || substr(url, 9) ELSE url END AS path, regexp_extract(url, '([0-9]+)$', 1) AS number FROM pages")
def path_rewrite(spark, d):
    number = F.regexp_extract("url", "([0-9]+)$", 1)
    return table(spark, d, "pages").select("page_id", joins.prefix_replaced(F.col("url"), "https://", "s3://raw/").alias("path"), number.alias("number"))


@query("""
SELECT doc_id, CASE WHEN regexp_full_match(sp, 'SPEAKER_[0-9]+') THEN source || '/' || sp ELSE sp END AS speaker FROM
  (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'SPEAKER_0' || doc_id % 5 ELSE 'anna-' || doc_id % 7 END AS sp FROM documents)""")
def composite_speaker_key(spark, d):
    speaker = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SPEAKER_0"), (F.col("doc_id") % 5).cast("string"))).otherwise(F.concat(F.lit("anna-"), (F.col("doc_id") % 7).cast("string")))
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", tx.speaker_key(path, speaker).alias("speaker"))


@query("SELECT doc_id, coalesce(nullif(a, ''), nullif(b, ''), 'none') AS text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS a, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS b FROM documents)")
def alias_coalesce(spark, d):
    from ..sources.manifest import coalesced

    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("a"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("b"))
    return rows.select("doc_id", F.coalesce(coalesced(rows, "a", "b"), F.lit("none")).alias("text"))


@query("SELECT source, round(count(DISTINCT lower(text)) * 1.0 / count(*), 6) AS unique_share, count(DISTINCT lower(text)) * 1.0 / count(*) >= 0.95 AS kept FROM documents GROUP BY 1")
def templated_source_rejection(spark, d):
    share = F.count_distinct(F.md5(F.lower("text"))) * 1.0 / F.count("*")
    return table(spark, d, "documents").groupBy("source").agg(share.alias("s")).select("source", F.round("s", 6).alias("unique_share"), (F.col("s") >= 0.95).alias("kept"))


@query("SELECT doc_id, NOT regexp_matches(text, '\\$\\$|\\\\frac|&&&') AS plain, octet_length(encode(text)) > 1000 AS heavy FROM documents")
def markup_and_payload_gates(spark, d):
    return table(spark, d, "documents").select("doc_id", (~F.col("text").rlike("\\$\\$|\\\\frac|&&&")).alias("plain"), (F.octet_length("text") > 1000).alias("heavy"))


@query("""
SELECT kept, count(*) AS n FROM (SELECT CASE WHEN vc_cer < 30 THEN 'vc' WHEN raw_cer < 50 THEN 'raw_fallback' WHEN vc_cer IS NULL THEN 'error' ELSE 'none' END AS kept
  FROM (SELECT value AS vc_cer, lead(value) OVER (ORDER BY event_id) AS raw_cer FROM events)) GROUP BY 1""")
def fallback_selection(spark, d):
    # The next event's value stands for the raw score; event ids are gapless, so it is a join by id and not a
    # window over the whole table.
    e = table(spark, d, "events").select("event_id", F.col("value").alias("vc"))
    pairs = e.join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("vc").alias("raw")), "event_id", "left")
    kept = F.when(F.col("vc") < 30, "vc").when(F.col("raw") < 50, "raw_fallback").when(F.col("vc").isNull(), "error").otherwise("none")
    return pairs.groupBy(kept.alias("kept")).agg(F.count("*").alias("n"))


@query("""
SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS depth, count(*) OVER (PARTITION BY label) AS size FROM embeddings) ORDER BY depth, size DESC, label LIMIT 37""")
def depth_first_cap(spark, d):
    return sample.largest_first_by_depth(table(spark, d, "embeddings").select("vec_id", "label"), "label", [F.col("vec_id")], 37)


@query("SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN 'A' ELSE 'B' END AS side, (doc_id + doc_id % 4 * 7) % 11 AS variant FROM documents")
def blind_sides(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(F.substring(F.md5(i.cast("string")), 1, 1) < "8", "A").otherwise("B").alias("side"), F.pmod(i + i % 4 * 7, F.lit(11)).alias("variant"))


@query(r"""
WITH base AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS piece FROM benchmark),
new AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS piece FROM documents)
SELECT piece, (SELECT count(*) FROM base) + row_number() OVER (ORDER BY piece) - 1 AS id FROM new WHERE piece NOT IN (SELECT piece FROM base)""")
def vocabulary_append(spark, d):
    from ..operators.ordered import with_running

    pieces = lambda df: df.select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("piece")).distinct()
    base, new = pieces(table(spark, d, "benchmark")), pieces(table(spark, d, "documents"))
    fresh = new.join(base, "piece", "left_anti")
    return with_running(fresh, [F.col("piece")], F.ascii("piece") * 256 + F.ascii(F.substring("piece", 2, 1))).select("piece", (F.lit(base.count()) + F.col("rn") - 1).alias("id"))


@query("SELECT l_shipdate, n, n - lag(n) OVER (ORDER BY l_shipdate) AS change FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1)")
def consecutive_difference(spark, d):
    days = table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n"))  # a row for each day
    return days.select("l_shipdate", "n", (F.col("n") - F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("l_shipdate"))).alias("change"))


@query("SELECT lang, round(sum(len(string_split(text, ' '))) * 1.0 / count(*), 6) AS words_per_row, round(sum(n_chars) * 1.0 / sum(len(string_split(text, ' '))), 6) AS fertility, round(avg(CASE WHEN n_chars / 15.0 * 12.5 / greatest(len(string_split(text, ' ')), 1) >= 4 THEN 1.0 ELSE 0.0 END), 6) AS alignable FROM documents GROUP BY 1")
def fertility_by_language(spark, d):
    n = F.size(F.split("text", " "))
    ok = gates.alignable(F.col("n_chars") / 15.0, n, 12.5, 4.0)
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(n) * 1.0 / F.count("*"), 6).alias("words_per_row"), F.round(F.sum("n_chars") * 1.0 / F.sum(n), 6).alias("fertility"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("alignable"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(sum(length(text)) / 15.0, 4) AS seconds FROM conversations GROUP BY 1 ORDER BY seconds DESC LIMIT 3")
def speaker_inventory(spark, d):
    sums = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.sum(F.length("text")) / 15.0, 4).alias("seconds"))
    return sums.orderBy(F.desc("seconds")).limit(3)


@query("SELECT conv_id, list_sort(list_distinct(list(role))) = ['assistant', 'user'] AS complete, len(list_filter(list_distinct(list(role)), lambda r: r NOT IN ('user', 'assistant', 'system'))) = 0 AS known FROM conversations GROUP BY 1")
def role_subset_check(spark, d):
    roles = F.array_sort(F.collect_set("role"))
    known = F.size(F.array_except(roles, F.array(*map(F.lit, ["user", "assistant", "system"])))) == 0
    return table(spark, d, "conversations").groupBy("conv_id").agg((roles == F.array(F.lit("assistant"), F.lit("user"))).alias("complete"), known.alias("known"))


@query("SELECT conv_id, count(*) FILTER (g > 40) AS long_turns, max(g) - min(g) AS spread FROM (SELECT conv_id, length(text) AS g FROM conversations) GROUP BY 1 HAVING count(*) > 2")
def having_filter(spark, d):
    g = F.length("text")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(g > 40).alias("long_turns"), (F.max(g) - F.min(g)).cast("long").alias("spread"), F.count("*").alias("n")).where("n > 2").drop("n")
