import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import cluster, dedupe, gates, ngrams, ordered, sample, setcover, vectors
from tessella.sources import manifest, sinks
from tessella.streaming import events


def test_either_key_replay(spark):
    r = random.Random(4)
    rows = [(k, f"u{r.randint(0, 40)}", r.choice([None, f"c{r.randint(0, 30)}", f"u{r.randint(0, 40)}"])) for k in range(120)]
    seen, want = set(), []
    for k, a, b in rows:
        if a in seen or b is not None and b in seen:
            continue
        seen |= {a} | ({b} if b is not None else set())
        want.append(k)
    for replay_rows in (0, 20, 1000):  # rounds alone, some rounds, none
        got = dedupe.admitted_by_either_key(spark.createDataFrame(rows, "k long, a string, b string"), "a", "b", "k", replay_rows)
        assert sorted(x.k for x in got.collect()) == want


def test_either_key_ties_nulls_and_chains(spark):
    """Ties of the order go by the keys, one of rows alike stays, null orders come first, and a chain of keys ends."""
    r = random.Random(5)
    rows = [(r.choice([None, *range(30)]), r.choice([None, *range(60)]), r.choice([None, *range(40)]), k) for k in range(150)]
    rows += [(100 + k, 1000 + k, 1001 + k, k) for k in range(60)] + [rows[7]] * 2
    seen, want = set(), []
    low = lambda x: (x is not None, x or 0)
    for row in sorted(rows, key=lambda x: (low(x[0]), low(x[2] if x[1] is None else x[1]), low(x[1] if x[2] is None else x[2]), x[1] is not None, low(x[1]), x[2] is not None, low(x[2]), x[3])):
        own = {*row[1:3]} - {None}
        if seen.isdisjoint(own):
            seen |= own
            want.append(row)
    for replay_rows in (1000, 40):
        df = spark.createDataFrame(rows, "k int, a int, b long, _one long")
        got = dedupe.admitted_by_either_key(df, "a", "b", "k", replay_rows).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert dedupe.admitted_by_either_key(df.where("k < 0"), "a", "b", "k").collect() == []


def test_budget_prefix_keeps_crossing_row(spark):
    rows = spark.range(100).select("id", F.lit(3).alias("v"), F.md5(F.col("id").cast("string")).alias("h"))
    kept = ordered.budget_prefix(rows, [F.col("h")], ordered.hash_bucket(F.col("h")), F.col("v"), 10).collect()
    assert [x.id for x in sorted(kept, key=lambda x: x.h)] == [x.id for x in sorted(rows.collect(), key=lambda x: x.h)[:4]]
    assert ordered.budget_prefix(rows.where("id < 0"), [F.col("h")], ordered.hash_bucket(F.col("h")), F.col("v"), 10).count() == 0


def test_running_numbers_by_group(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    got = ordered.with_running(rows, [F.col("id")], ordered.range_bucket(rows, "id", 16), F.col("id"), groups=["g"]).collect()
    for g in range(3):
        own = sorted((x for x in got if x.g == g), key=lambda x: x.id)
        assert [x.rn for x in own] == list(range(1, len(own) + 1))
        assert [x.before for x in own] == [sum(y.id for y in own[:k]) for k in range(len(own))]


def test_caps_and_quotas(spark):
    rows = spark.range(60).select("id", F.when(F.col("id") < 50, "hot").otherwise("cold").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    assert {(r.g, r.n) for r in sample.cap_per_group(rows, ["g"], ["h"], 4).groupBy("g").agg(F.count("*").alias("n")).collect()} == {("hot", 4), ("cold", 4)}
    assert sample.quota_with_topup(rows, "g", "h", "id", 5, 25).count() == 25


def test_first_seen_and_last_written(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "w")], "id long, k string, v string")
    assert {r.id for r in dedupe.first_seen(rows, [F.col("k")], ["id"]).collect()} == {1, 3}
    assert {r.v for r in dedupe.last_written(rows, ["k"], [F.col("id")]).collect()} == {"y", "w"}


def test_missing_metric_rules(spark):
    rows = spark.createDataFrame([({"cer_a": 0.2, "wer": 9.0}, None, None, None), ({"wer": 9.0}, 1.0, 3.0, 1.0), (None, 9.0, 2.0, 2.0)], "m map<string,double>, o double, av double, lo double")
    got = rows.select(gates.error_gate(F.col("m"), F.col("o")).alias("e"), gates.consensus(F.col("av"), F.col("lo")).alias("c"), gates.at_least(F.col("o"), 2.0, missing=False).alias("f")).collect()
    assert [(r.e, r.c, r.f) for r in got] == [(False, True, False), (True, False, False), (False, True, True)]


def test_codes_are_turned(spark):
    rows = spark.createDataFrame([([[1, 2], [3, 4], [5, 6]],), ([[1, 3, 5], [2, 4, 6]],), ([[1], [2, 3]],), ([],)], "c array<array<int>>")
    assert [r.s for r in rows.select(gates.square_codes(F.col("c"), 2).alias("s")).collect()] == [[[1, 2], [3, 4], [5, 6]], [[1, 2], [3, 4], [5, 6]], None, None]


def naive_cover(rows):
    covered, picked = set(), []
    while True:
        best = max(((len(set(t) - covered) / max(s, 1.0), -k) for k, s, t in rows), default=(0, 0))
        if best[0] <= 0:
            return picked
        row = next(r for r in rows if r[0] == -best[1])
        picked.append(row[0])
        covered |= set(row[2])


def test_set_cover_is_greedy(spark):
    r = random.Random(2)
    rows = [(k, r.uniform(1, 9), r.sample("abcdefghij", r.randint(0, 4))) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, s double, t array<string>")
    got = setcover.greedy_cover(df, "id", F.col("s"), F.col("t")).orderBy("pick").collect()
    assert [x.id for x in got] == naive_cover(rows)
    assert all(x.gained > 0 for x in got)


def test_average_linkage_on_clear_clusters(spark):
    r = np.random.default_rng(0)
    rows = [(k, 0, (np.eye(3)[k % 3] + r.normal(0, 0.01, 3)).tolist()) for k in range(12)]
    got = cluster.average_linkage(spark.createDataFrame(rows, "id long, g int, v array<double>"), "id", "v", "g", 0.8).collect()
    assert {x.id: x.cluster for x in got} == {k: k % 3 for k in range(12)}


def test_large_groups_cluster_as_a_whole(spark):
    r = np.random.default_rng(3)
    for n, d, threshold in ((60, 3, 0.9), (60, 3, 0.3), (80, 8, 0.5), (80, 8, 0.0)):
        v = r.normal(size=(n, d))
        v[n // 2 : n // 2 + 10] = v[:10]  # identical vectors
        v[-1] = 0
        assert cluster.chain_labels(v, threshold).tolist() == cluster.linkage_labels(v, threshold).tolist()
    rows = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "id long, v array<double>, g int")
    whole, small = ({x.id: x.cluster for x in cluster.average_linkage(rows, "id", "v", "g", 0.5, m).collect()} for m in (4000, 7))
    assert whole == small


def test_pair_statistics_equal_all_pairs(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(7, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i in range(7) for j in range(i)])
    got = vectors.pair_statistics(spark.createDataFrame([(0, x.tolist()) for x in v], "g int, v array<double>"), "v", "g").first()
    assert got.n_pairs == 21 and abs(got.mean_cosine - want) < 1e-9


def test_sharded_sink_and_strict_scan(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("s").alias("source"), F.lit(10).alias("b"))
    cut = sinks.shard_by_bytes(rows, F.col("b"), "id", 250, "source")
    sinks.sharded_parquet(cut, str(tmp_path / "out"), by="source")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
    sinks.jsonl(rows.limit(3), str(tmp_path / "j"))
    assert manifest.strict_lines(spark, str(tmp_path / "j"), rows.schema).count() == 3
    assert manifest.existing(spark, [str(tmp_path / "j"), str(tmp_path / "none")]) == [str(tmp_path / "j")]
    assert manifest.listing(spark, str(tmp_path / "j"), "*.json").count() >= 1


def test_stream_resumes(spark, tmp_path):
    schema = "id long, k string, ts timestamp"
    batch = lambda a, b: spark.range(a, b).select("id", (F.col("id") % 5).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    path, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    batch(0, 50).write.mode("append").parquet(path)
    stream = events.event_stream(spark, path, spark.createDataFrame([], schema).schema)
    events.run_to_end(stream, out, offsets)
    batch(50, 80).write.mode("append").parquet(path)
    events.run_to_end(stream, out, offsets)
    assert spark.read.parquet(out).count() == 80
    assert events.not_done(batch(0, 100), spark.read.parquet(out), ["id"]).count() == 20


def test_rows_by_place_and_by_position(spark):
    from tessella.operators import joins

    rows = spark.range(50).select(F.lit("f").alias("file"), "id", (F.col("id") * 2).alias("v"))
    wanted = spark.createDataFrame([("f", 3), ("f", 3), ("f", 40), ("g", 1)], "file string, id long")
    assert sorted(r.v for r in joins.looked_up(wanted, rows, ["file", "id"]).collect()) == [6, 80]
    a, b = spark.range(5).select(F.col("id").alias("a")), spark.range(10, 15).select(F.col("id").alias("b"))
    assert {(r.a, r.b) for r in joins.zipped(a, b, "a", "b").collect()} == {(k, k + 10) for k in range(5)}
    try:
        joins.zipped(a, b.where("b < 13"), "a", "b").collect()
    except Exception as error:
        assert "different length" in str(error)
    else:
        raise AssertionError("no error for tables of different length")


def test_vectors_as_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(vectors.unit(F.col("a")).alias("u"), vectors.mixed(F.col("a"), F.col("b"), 0.5).alias("m"), vectors.steered(F.col("a"), F.col("b"), 2.0).alias("s"), vectors.cosine(F.col("a"), F.col("z")).alias("c")).first()
    assert got.u == [0.6, 0.8] and got.m == [1.5, 2.5] and got.c is None
    assert abs(np.linalg.norm(got.s) - 5) < 1e-9


def test_text_sources(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("# comment\nword\tx\n\nword\ty\nother\n", encoding="utf-8")
    assert {r.word for r in manifest.lexicon(spark, str(tmp_path / "lex.tsv")).collect()} == {"word", "other"}
    lines = spark.createDataFrame([("utt1  hello there",), ("utt2",), ("  ",)], "value string")
    assert {(r.id, r.text) for r in manifest.transcripts(lines).collect()} == {("utt1", "hello there"), ("utt2", "")}
    rows = spark.createDataFrame([('{"audio_filepath": "a.wav", "duration": 1.5, "words": [{"word": "x", "start": 0.1, "end": null}]}',), ('{"audio_filepath": "b.wav", ',), ("[]",), ("",)], "value string")
    parsed = manifest.parsed(rows).collect()
    assert [r.audio_filepath for r in parsed if r.audio_filepath] == ["a.wav"]
    timed = manifest.parsed(rows).where("audio_filepath is not null").select(gates.all_timed(F.col("words")).alias("t")).first()
    assert timed.t is False
    sinks.tsv(spark.createDataFrame([("a\tb\nc", 1)], "t string, n int"), str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).first().t == "a b c"
    assert sinks.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_stream_stops_at_target(spark, tmp_path):
    path, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    rows = lambda a, b: spark.range(a, b).select("id", (F.col("id") % 2).cast("string").alias("k"), F.lit(2.0).alias("s")).coalesce(1)
    schema = rows(0, 1).schema
    for a, b in ((0, 6), (6, 20)):
        rows(a, b).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        events.run_to_end(events.stop_at_target(stream, "k", "id", "s", 9.0), out, offsets)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))  # five rows of each key


def test_nearest_in_blocks(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(k, [r.uniform(-1, 1) for _ in range(4)]) for k in range(30)], "k long, v array<double>")
    anchors = spark.createDataFrame([(k, [float(x) for x in r.choices([-1, 0, 1], k=4)]) for k in range(40)], "a long, u array<double>")
    one, many = (sorted(map(tuple, vectors.nearest(rows, "k", "v", anchors, "a", "u", block=b).collect())) for b in (100, 3))
    assert one == many and len(one) == 30


def test_cover_ends_at_its_budget_with_any_pool(spark, monkeypatch):
    rows = [(k, float(1 + k % 3), [f"t{(k * j) % 17}" for j in range(1, 4)]) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, s double, t array<string>")
    want = [sorted(map(tuple, setcover.greedy_cover(df, "k", F.col("s"), F.col("t"), b).collect())) for b in (4.0, float("inf"))]
    monkeypatch.setattr(setcover, "DRIVER_ROWS", 1)
    monkeypatch.setattr(setcover, "WRITE_EACH", 2)
    assert [sorted(map(tuple, setcover.greedy_cover(df, "k", F.col("s"), F.col("t"), b).collect())) for b in (4.0, float("inf"))] == want


def test_markdown_of_many_rows_raises(spark):
    assert sinks.markdown(spark.range(2)).endswith("| 1 |")
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), most=4)


def test_canonical_texts_are_composed(spark):
    rows = spark.createDataFrame([("Cafe\u0301 e\u0301te\u0301",), ("caf\u00e9 \u00e9t\u00e9",)], "t string")
    got = rows.select(tx.canonical(F.col("t")).alias("c"), tx.eval_normalized(F.col("t")).alias("e")).distinct().collect()
    assert [tuple(x) for x in got] == [("caf\u00e9 \u00e9t\u00e9",) * 2]


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices("abcdefg", k=r.randint(0, 30))) for _ in range(20)]
    for t in list(texts):
        w = t.split()
        if w:
            w[r.randrange(len(w))] = "z"
        texts.append(" ".join(w))
    grams = {k: {tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)} for k, t in enumerate(texts)}
    want = {(a, b): len(grams[a] & grams[b]) for a in grams for b in grams if a < b and grams[a] and 10 * len(grams[a] & grams[b]) >= 6 * len(grams[a] | grams[b])}
    sets = ngrams.gram_sets(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", 2)
    got = {(x.k, x.other): round(x.jaccard * len(grams[x.k] | grams[x.other])) for x in ngrams.similar_pairs(sets, "k", 60).collect()}
    assert got == want and len(want) > 5


def test_labels_are_filtered_masked_and_padded(spark):
    rows = spark.createDataFrame([(0, 1, [1, -100, 2]), (0, 2, [3]), (1, 3, []), (1, 4, None), (1, 5, [4, 5])], "batch int, k int, ids array<int>")
    got = {x.k: (x.fits, x.cut, x.restored) for x in rows.select("k", gates.label_fits(F.col("ids"), 2).alias("fits"), gates.truncated(F.col("ids"), 2).alias("cut"), gates.mask_restored(F.col("ids"), 0).alias("restored")).collect()}
    assert got == {1: (False, [1, -100], [1, 0, 2]), 2: (True, [3], [3]), 3: (True, [], []), 4: (False, None, None), 5: (True, [4, 5], [4, 5])}
    padded = {x.k: (x.ids, x.mask) for x in gates.collated(rows, "batch", "ids", 9).collect()}
    assert padded == {1: ([1, -100, 2], [1, 1, 1]), 2: ([3, 9, 9], [1, 0, 0]), 3: ([9, 9], [0, 0]), 4: ([9, 9], [0, 0]), 5: ([4, 5], [1, 1])}


def test_helper_columns_leave_the_callers_alone(spark):
    rows = spark.range(40).select("id", (F.col("id") % 3).alias("g"), F.lit("mine").alias("_value"), F.lit("mine").alias("_bucket"), F.lit("mine").alias("_0_rank"), F.md5(F.col("id").cast("string")).alias("h"))
    bucket = ordered.hash_bucket(F.col("h"))
    for got in (
        ordered.with_running(rows, [F.col("h")], bucket, F.col("id"), groups=["g"]).drop("rn", "before"),
        ordered.budget_prefix(rows, [F.col("h")], bucket, F.col("id"), 100),
        sample.cap_per_group(rows, ["g"], ["h"], 2),
        sample.quota_with_topup(rows, "g", "h", "id", 2, 10),
        sample.largest_first_by_depth(rows, "g", [F.col("h")], 7),
    ):
        assert got.columns == rows.columns
        assert {tuple(r) for r in got.select("_value", "_bucket", "_0_rank").collect()} == {("mine",) * 3}
