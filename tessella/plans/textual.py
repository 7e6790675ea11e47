"""Queries on texts and vectors: cleaning, ratios, numbers, contamination, error rates, similarity, set cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize, numbers, pieces, signal
from ..functions import text as tx
from ..operators import cluster, gates, intervals, ngrams, score, setcover, vectors
from ..sources.tables import materialize, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = ["the", "that", "tion", "und", "der", "que", "les", "ción", "licensed", "version", "public", "password"]
_TERM_LIST = ", ".join(f"'{t}'" for t in TERMS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(r"SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\r]+', ' ', 'g'))) AS clean_md5 FROM documents")
def text_clean_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.cleaned_lines(F.col("text"))).alias("clean_md5"))


_CANON = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_ ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_CANON.format('text')}) AS canonical_md5 FROM documents")
def canonical_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.canonical(F.col("text"))).alias("canonical_md5"))


@query(r"""
WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^\p{L}\p{M}\p{N}]', '', 'g')) AS solid,
  length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(replace(text, ' ', '')) AS dense FROM documents)
SELECT doc_id, round(low * 1.0 / greatest(low + up, 1), 8) AS of_letters, CASE WHEN solid > 0 THEN round(low * 1.0 / solid, 8) ELSE 0 END AS of_marks,
  CASE WHEN letters > 0 THEN round(low * 1.0 / letters, 8) ELSE 0 END AS of_alphabetic, CASE WHEN dense > 0 THEN round(low * 1.0 / dense, 8) ELSE 0 END AS of_solid FROM c""")
def char_class_ratios(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.round(tx.script_share_of_letters(t, "a-z", "A-Z"), 8).alias("of_letters"), F.round(tx.script_share_of_marks(t, "a-z"), 8).alias("of_marks"), F.round(tx.script_share_of_alphabetic(t, "a-z"), 8).alias("of_alphabetic"), F.round(tx.script_share_of_solid(t, "a-z"), 8).alias("of_solid"))


_WORDS = r"list_filter(string_split(trim(regexp_replace({}, '[ \t\n\r]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""
WITH w AS (SELECT doc_id, text, {_WORDS.format('text')} AS ws FROM documents)
SELECT doc_id, len(ws) BETWEEN 5 AND 2000 AND len(list_filter(ws, lambda x: length(x) = 1 AND x <> '।' OR x LIKE '%्')) = 0 AS readable, len(ws) > 4 OR length(text) > 50 AS long_enough FROM w""")
def text_quality_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", gates.readable(F.col("text"), 5, 2000).alias("readable"), gates.long_enough(F.col("text")).alias("long_enough"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.।?!])[ \t\r\n]+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10))) AS s FROM documents)
SELECT md5(trim(s)) AS sentence, min(doc_id) AS doc_id, count(*) AS n FROM s WHERE trim(s) <> '' GROUP BY trim(s)""")
def sentence_split_pool(spark, d):
    pool = table(spark, d, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return pool.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select(F.md5("s").alias("sentence"), "doc_id", "n")


@query(f"""
WITH lex AS (SELECT DISTINCT unnest({_WORDS.format('lower(text)')}) AS w FROM benchmark),
t AS (SELECT doc_id, unnest({_WORDS.format('lower(text)')}) AS w FROM documents)
SELECT doc_id, round(avg(CASE WHEN lex.w IS NULL THEN 0.0 ELSE 1.0 END), 8) AS covered FROM t LEFT JOIN lex ON t.w = lex.w GROUP BY 1""")
def lexicon_coverage(spark, d):
    lex = table(spark, d, "benchmark").select(F.explode(tx.words(F.lower("text"))).alias("w")).distinct().withColumn("known", F.lit(1.0))
    tokens = table(spark, d, "documents").select("doc_id", F.explode(tx.words(F.lower("text"))).alias("w"))
    return tokens.join(vectors.small_side(lex, ngrams.INDEX_ROWS), "w", "left").groupBy("doc_id").agg(F.round(F.avg(F.coalesce("known", F.lit(0.0))), 8).alias("covered"))


@query(f"SELECT doc_id, t AS term FROM documents, (SELECT unnest([{_TERM_LIST}]) AS t) WHERE contains(lower(text), t)")
def term_containment_join(spark, d):
    found = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.lower("text"), t))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("term"))


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS tok FROM documents)
SELECT CASE WHEN regexp_full_match(tok, '[0-9]+\.[0-9]+') THEN 'decimal' WHEN length(tok) >= 7 THEN 'phone/id' WHEN length(tok) = 4 AND CAST(tok AS INT) BETWEEN 1900 AND 2100 THEN 'year-ad'
  WHEN length(tok) = 4 AND CAST(tok AS INT) BETWEEN 2101 AND 2199 THEN 'year-bs' ELSE 'cardinal' END AS kind, count(*) AS n, count(DISTINCT tok) AS n_distinct FROM t GROUP BY 1""")
def number_kind_classify(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]+(?:\\.[0-9]+)?"), F.lit(0))).alias("tok"))
    return tokens.groupBy(numbers.number_kind(F.col("tok")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("tok").alias("n_distinct"))


def _number_tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]+(?:\\.[0-9]+)?"), F.lit(0))).alias("written")).distinct()


@query()
def verbalize_numbers_en(spark, d):
    return _number_tokens(spark, d).select("written", numbers.english_reading("written").alias("spoken"))


@query()
def verbalize_numbers_ne(spark, d):
    return _number_tokens(spark, d).select("written", numbers.nepali_reading("written").alias("spoken"), numbers.number_kind(F.col("written")).alias("kind"))


@query("SELECT o_orderkey, list_aggregate(list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c: ['zero','one','two','three','four','five','six','seven','eight','nine'][CAST(c AS INT) + 1]), 'string_agg', ' ') AS spoken FROM orders")
def digit_reading(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.digits_spelled(F.col("o_orderkey").cast("string"), numbers.EN_SMALL).alias("spoken"))


@query()
def asr_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize.asr_normalized(F.col("text"), F.col("lang"), "a-zà-ÿœ' ").alias("text"))


@query()
def tts_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize.tts_normalized(F.col("text"), keep_latin=True).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) = text AS composed FROM documents")
def nfc_check(spark, d):
    return table(spark, d, "documents").select("doc_id", (tx.nfc("text") == F.col("text")).alias("composed"))


_GRAMS = "list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], ' ')))"
_WS = "list_filter(string_split({}, ' '), lambda w: w <> '')".format(_CANON.format("text"))


@query(f"""
WITH a AS (SELECT doc_id, {_GRAMS.format('ws')} AS g FROM (SELECT doc_id, {_WS} AS ws FROM documents)), b AS (SELECT item_id, {_GRAMS.format('ws')} AS g FROM (SELECT item_id, {_WS} AS ws FROM benchmark)),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM a), y AS (SELECT item_id, len(g) AS n, unnest(g) AS gram FROM b),
p AS (SELECT doc_id, item_id, count(*) AS shared, count(*) * 1.0 / (any_value(x.n) + any_value(y.n) - count(*)) AS j FROM x JOIN y USING (gram) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, round(j, 8) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS rn FROM p) WHERE rn = 1""")
def contamination_ngram_jaccard(spark, d):
    docs = ngrams.gram_sets(table(spark, d, "documents"), "doc_id", "text", 5)
    items = ngrams.gram_sets(table(spark, d, "benchmark"), "item_id", "text", 5)
    return ngrams.best_match(docs, "doc_id", items, "item_id").select("doc_id", "item_id", "shared", F.round("jaccard", 8).alias("jaccard"))


@query(f"""
WITH c AS (SELECT min(doc_id) AS doc_id, string_split(t, ' ') AS ws FROM (SELECT doc_id, {_CANON.format("text")} AS t FROM documents) WHERE t IS NOT NULL GROUP BY t),
a AS (SELECT doc_id, {_GRAMS.format("ws")} AS g FROM c), x AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM a),
p AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS s, any_value(a.n) + any_value(b.n) - count(*) AS u FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_id, other, round(s * 1.0 / u, 8) AS jaccard FROM p WHERE s * 100 >= u * 80""")
def near_dup_pairs(spark, d):
    """Pairs of different canonical texts, each by its smallest doc_id; near_dup_members has the copies."""
    first = table(spark, d, "documents").select("doc_id", tx.canonical(F.col("text")).alias("text")).where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    pairs = ngrams.similar_pairs(materialize(ngrams.gram_sets(first, "doc_id", "text", 5), "grams"), "doc_id", 80)
    return pairs.select("doc_id", "other", F.round("jaccard", 8).alias("jaccard"))


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS first FROM (SELECT doc_id, {_CANON.format('text')} AS t FROM documents) WHERE t IS NOT NULL")
def near_dup_members(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(tx.canonical(F.col("text")), 256).alias("h")).where("h is not null")
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("first")), "h").select("doc_id", "first")


@query()
def piece_counts(spark, d):
    import public_tokenizers

    found = pieces.piece_counts(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return table(spark, d, "documents").select("doc_id", found.alias("c")).select("doc_id", "c.pieces", "c.unknown")


@query(f"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON {_CANON.format('d.text')} = {_CANON.format('b.text')}")
def contamination_exact(spark, d):
    a = table(spark, d, "documents").select("doc_id", tx.canonical(F.col("text")).alias("c"))
    return a.join(table(spark, d, "benchmark").select("item_id", tx.canonical(F.col("text")).alias("c")), "c").select("doc_id", "item_id")


@query("""
WITH p AS (SELECT conv_id, text AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations),
a AS (SELECT *, levenshtein(r, h) AS e FROM p WHERE h IS NOT NULL AND regexp_full_match(concat(r, h), '[ -~\n\t]+') AND length(r) > 0)
SELECT conv_id, count(*) AS n, CAST(sum(e) AS BIGINT) AS edits, round(sum(e) * 1.0 / sum(length(r)), 8) AS micro_cer, round(avg(e * 1.0 / length(r)), 8) AS macro_cer FROM a GROUP BY 1""")
def cer_pairs_micro_macro(spark, d):
    a = _pairs(spark, d).where("length(r) > 0 and concat(r, h) rlike '^[ -~\\n\\t]+$'").withColumn("e", score.char_edits(F.col("r"), F.col("h")))
    return a.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("e").alias("edits"), F.round(F.sum("e") / F.sum(F.length("r")), 8).alias("micro_cer"), F.round(F.avg(F.col("e") / F.length("r")), 8).alias("macro_cer"))


def _pairs(spark, d):
    from pyspark.sql import Window

    turns = table(spark, d, "conversations")
    return turns.select("conv_id", "turn", F.col("text").alias("r"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("h")).where("h is not null")


@query()
def wer_pairs(spark, d):
    a = _pairs(spark, d).withColumn("e", score.word_edits("r", "h")).withColumn("n_ref", F.size(tx.words(F.col("r"))))
    return a.groupBy("conv_id").agg(F.sum("e").alias("edits"), F.round(F.sum("e") / F.sum("n_ref"), 8).alias("micro_wer"), F.round(F.avg(F.col("e") / F.greatest("n_ref", F.lit(1))), 8).alias("macro_wer"))


@query("SELECT regexp_matches(text, '[0-9०-९]') AS has_digit, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY 1")
def stratified_score_digit(spark, d):
    return table(spark, d, "documents").groupBy(F.col("text").rlike("[0-9०-९]").alias("has_digit")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


_COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_CENT = """cent AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(e[i] / n) AS x FROM
  (SELECT label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))) AS n FROM embeddings), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {_CENT}, s AS (SELECT vec_id, cent.label AS nearest, round({_COS.format('embedding', 'c')}, 9) AS cosine FROM embeddings, cent) SELECT vec_id, nearest, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, nearest) AS rn FROM s) WHERE rn = 1")
def cosine_top1(spark, d):
    e = table(spark, d, "embeddings")
    found = vectors.nearest(e, "vec_id", "embedding", vectors.centroids(e, "embedding", "label"), "label", "centroid")
    return found.select("vec_id", "nearest", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT a.label, count(*) AS n_pairs, round(avg({_COS.format('a.embedding', 'b.embedding')}), 6) AS mean_cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def cosine_pairwise_stats(spark, d):
    return vectors.pair_statistics(table(spark, d, "embeddings"), "embedding", "label").select("label", "n_pairs", F.round("mean_cosine", 6).alias("mean_cosine"))


@query(f"WITH {_CENT} SELECT label, round(c[1] / sqrt(list_sum(list_transform(c, lambda v: v * v))), 6) AS first, round(list_sum(c) / sqrt(list_sum(list_transform(c, lambda v: v * v))), 6) AS total FROM cent")
def speaker_centroids(spark, d):
    c = vectors.centroids(table(spark, d, "embeddings"), "embedding", "label")
    return c.select("label", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {_CENT} SELECT a.label AS a, b.label AS b, round({_COS.format('a.c', 'b.c')}, 6) AS cosine FROM cent a JOIN cent b ON a.label < b.label")
def centroid_distance(spark, d):
    c = vectors.centroids(table(spark, d, "embeddings"), "embedding", "label")  # a row for each label
    pairs = c.select(F.col("label").alias("a"), F.col("centroid").alias("x")).join(vectors.small_side(c.select(F.col("label").alias("b"), F.col("centroid").alias("y"))), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(f"WITH {_CENT} SELECT vec_id, label, round({_COS.format('embedding', 'c')}, 6) >= 0.5 AS passed FROM embeddings JOIN cent USING (label)")
def similarity_gate(spark, d):
    e = table(spark, d, "embeddings")
    joined = e.join(vectors.centroids(e, "embedding", "label"), "label")
    return joined.select("vec_id", "label", (F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6) >= 0.5).alias("passed"))


@query(f"WITH {_CENT} SELECT label, count(*) AS n, round(avg(1 - {_COS.format('embedding', 'c')}), 6) AS dispersion FROM embeddings JOIN cent USING (label) GROUP BY 1")
def group_dispersion(spark, d):
    e = table(spark, d, "embeddings")
    joined = e.join(vectors.centroids(e, "embedding", "label"), "label")
    return joined.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(1 - vectors.cosine(F.col("embedding"), F.col("centroid"))), 6).alias("dispersion"))


@query(f"WITH {_CENT}, s AS (SELECT vec_id, embeddings.label AS intended, cent.label AS top, row_number() OVER (PARTITION BY vec_id ORDER BY round({_COS.format('embedding', 'c')}, 9) DESC, cent.label) AS rn FROM embeddings, cent) SELECT intended, top, count(*) AS n FROM s WHERE rn = 1 GROUP BY 1, 2")
def confusion_matrix(spark, d):
    e = table(spark, d, "embeddings")
    found = vectors.nearest(e, "vec_id", "embedding", vectors.centroids(e, "embedding", "label"), "label", "centroid")
    return found.join(e.select("vec_id", F.col("label").alias("intended")), "vec_id").groupBy("intended", F.col("nearest").alias("top")).agg(F.count("*").alias("n"))


@query()
def average_linkage_clusters(spark, d):
    return cluster.average_linkage(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.5)


@query()
def greedy_set_cover(spark, d):
    terms = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.lower("text"), t))
    return setcover.greedy_cover(table(spark, d, "documents"), "doc_id", F.col("n_chars") / 15.0, terms, budget=3600.0)


@query(f"""
WITH h AS (SELECT doc_id, n_chars, len(list_filter([{_TERM_LIST}], lambda t: contains(lower(text), t))) AS hits FROM documents),
p AS (SELECT *, sum(n_chars) OVER (ORDER BY hits DESC, md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT doc_id, hits FROM p WHERE coalesce(before, 0) < 300000""")
def dense_first_fill(spark, d):
    from ..operators.ordered import budget_prefix, hash_bucket

    hits = F.size(F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.lower("text"), t)))
    docs = materialize(table(spark, d, "documents").select("doc_id", "n_chars", hits.cast("long").alias("hits"), F.md5(F.col("doc_id").cast("string")).alias("h")), "hits")  # the order is gone through twice
    bucket = (len(TERMS) - F.col("hits")) * 4096 + hash_bucket(F.col("h"))
    return budget_prefix(docs, [F.desc("hits"), F.col("h"), F.col("doc_id")], bucket, F.col("n_chars"), 300000).select("doc_id", "hits")


@query("SELECT o_orderkey, round(12 * log2(o_totalprice / 1000), 6) AS semitones, greatest(0.0, least(1.0, round(o_totalprice / 500000, 8))) AS clamped FROM orders WHERE o_totalprice > 0")
def scalar_signal_functions(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").where(p > 0).select("o_orderkey", F.round(signal.semitones(p, F.lit(1000.0)), 6).alias("semitones"), signal.clamped(F.round(p / 500000, 8), 0.0, 1.0).alias("clamped"))


@query()
def frame_acoustics(spark, d):
    return table(spark, d, "embeddings").select("vec_id", signal.acoustics(16000)(F.transform("embedding", lambda x: x.cast("double"))).alias("a")).select("vec_id", "a.rms", "a.db", "a.peak")


@query()
def gap_segments(spark, d):
    words = F.transform(F.array_sort(F.collect_list(F.struct((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), "event_id"))), lambda w: F.struct(w["event_id"].cast("string").alias("word"), w["start"].alias("start"), (w["start"] + 1).alias("end")))
    per_user = table(spark, d, "events").groupBy("user_id").agg(words.alias("words"))
    return per_user.select("user_id", F.explode(intervals.segments_of(F.col("words"), 86400.0)).alias("s")).select("user_id", F.round("s.start", 3).alias("start"), F.round("s.end", 3).alias("end"))


@query("SELECT doc_id, substr(sha256(source), 1, 12) AS sid, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS seed FROM documents")
def hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.hash_prefix(F.col("source"), 12).alias("sid"), tx.hash_seed(F.col("doc_id").cast("string")).alias("seed"))
