"""Decontamination, fingerprints, substring dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
import string

import numpy as np
import pytest

from tessella.llm import components, decontaminate, fingerprints, jaccard_join, substring_dedup
from tessella.llm.substring_dedup import remove_repeats, taken_windows

SCHEMA = "doc_id long, text string, component_id int, packed string"


def vocabulary(r, n=200):
    return ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 7))) for _ in range(n)]


def corpus(seed, n=60, words=90):
    """Random texts with exact copies, near copies, shared passages and repeated words."""
    r = random.Random(seed)
    v = vocabulary(r)
    passage = " ".join(r.choice(v) for _ in range(30))
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif texts and kind < 0.45:
            w = (r.choice(texts) or "").split()
            for _ in range(r.randint(1, 6)):
                if w:
                    w[r.randrange(len(w))] = r.choice(v)
            texts.append(" ".join(w))
        else:
            t = " ".join(r.choice(v) for _ in range(r.randint(1, words)))
            texts.append(f"{t} {passage} {r.choice(v)}" if kind > 0.8 else t)
    return [*texts, None, "", " \n", "one", "One", "x " * 120, "x " * 100, "é b c d e f"]


def rows_of(texts):
    return [(k * 3 + 1, t, 0, "p") for k, t in enumerate(texts)]


def brute_removed(rows, width):
    first = {}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    for k in sorted(words):
        for i in range(len(words[k]) - width + 1):
            first.setdefault(tuple(words[k][i : i + width]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < k:
                gone[i : i + width] = [True] * width
        out[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("width,limit", [(10, None), (10, 2), (4, None), (50, None)])
def test_substring_dedup(spark, monkeypatch, width, limit):
    if limit:  # many shards for one minimizer
        monkeypatch.setattr(substring_dedup, "SHARD_CONTENTS", limit)
    rows = rows_of(corpus(width))
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA), width).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_removed([x[:2] for x in rows], width)


def test_substring_dedup_on_odd_tables(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(str(k) for k in range(60))
    rows = [(5, text, 0, "p"), (5, text, 0, "p"), (None, text, 0, "p"), (9, text, 0, "p")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 60, 0), (5, 60, 0), (5, 60, 0), (9, 60, 60)]


def test_automaton_owners():
    r = random.Random(3)
    shard = [(r.randint(0, 9), [r.randint(0, 2) for _ in range(r.randint(3, 40))]) for _ in range(12)]
    for width in (3, 5, 8):
        least = {}
        for owner, s in shard:
            for i in range(len(s) - width + 1):
                key = tuple(s[i : i + width])
                least[key] = min(owner, least.get(key, owner))
        want = [[i for i in range(len(s) - width + 1) if least[tuple(s[i : i + width])] < owner] for owner, s in shard]
        assert taken_windows(shard, width) == want


def brute_components(rows, k, percent):
    sets = {}
    for doc, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("k,percent,chunk,block", [(4, 85, 4000, 512), (5, 80, 4000, 512), (2, 60, 4000, 512), (2, 60, 3, 512), (2, 60, 1, 2), (2, 60, 2, 1)])
def test_jaccard_components(spark, k, percent, chunk, block):  # small chunks: regions are cut, pairs that met in none follow, block by block
    rows = rows_of(corpus(k + percent))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), k, percent, chunk, block_sets=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components([x[:2] for x in rows], k, percent)


def test_jaccard_on_odd_tables(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(4, "a b c d e f", 0, "p"), (4, "a b c d e f", 0, "p"), (2, "A b c d e f", 0, "p"), (None, "a b c d e f", 0, "p"), (9, None, 0, "p")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(((r.doc_id or 0, r.component_id) for r in jaccard_join.jaccard_components(df).collect())) == [(0, 2), (2, 2), (4, 2), (4, 2), (9, 9)]
    kept = jaccard_join.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 9]


def test_dense_cells_join_as_regions(spark, monkeypatch):
    """Many edits of one text that hardly link with each other, in regions of several chunks and cells."""
    for name in ("SMALL", "DENSE"):
        monkeypatch.setattr(jaccard_join, name, 0)
    r = random.Random(31)
    v = vocabulary(r)
    base = [r.choice(v) for _ in range(60)]
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(60)] = r.choice(v)
        texts.append(" ".join(w))
    rows = rows_of(texts)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 10, block_sets=10).collect()
    want = brute_components([x[:2] for x in rows], 4, 85)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert 1 < len({c for _, c in want.values()}) < 80


def test_of_rows_of_one_id_always_the_same_stays(spark):
    rows = [(1, "one two three four five six", k % 3, None if k % 2 else "p") for k in range(12)]
    kept = {tuple(jaccard_join.keep_one_of_each(spark.createDataFrame(random.Random(s).sample(rows, 12), SCHEMA)).first()) for s in range(4)}
    assert len(kept) == 1 and kept <= set(rows)


def test_length_partitions_are_next_to_each_other():
    n = np.arange(1, 3000)
    part = jaccard_join.length_partitions(n, 80)
    for a in n[::7]:
        partners = n[(100 * np.minimum(a, n) >= 80 * np.maximum(a, n))]
        assert np.abs(part[partners - 1] - part[a - 1]).max() <= 1


def test_hashes_of_long_texts_take_blocks(monkeypatch):
    from tessella.llm import _text

    text = ("ab cde " * 50 + "x" * 90 + " y").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = _text.find_words(data, offsets).hashes()
    monkeypatch.setattr(_text, "SLICE_BYTES", 16)
    assert _text.find_words(data, offsets).hashes().tolist() == whole.tolist()


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def brute_tiles(p, t, least):
    """Greedy string tiling by trying all matches, longest first."""
    free_p, free_t, found = [True] * len(p), [True] * len(t), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return found
        found.append(best)
        i, j, n = best
        free_p[i : i + n] = [False] * n
        free_t[j : j + n] = [False] * n


def test_tiles_equal_brute_force():
    r = random.Random(8)
    for _ in range(60):
        p, t = [[r.randint(1, 4) for _ in range(r.randint(0, 18))] for _ in range(2)]
        for least in (2, 3):
            assert decontaminate.tiles(p, t, least) == brute_tiles(p, t, least)


def test_leaks(spark):
    r = random.Random(9)
    v = vocabulary(r, 400)
    items = [" ".join(r.choice(v) for _ in range(20)) for _ in range(5)] + ["tiny item", None, ""]
    noise = lambda n: " ".join(r.choice(v) for _ in range(n))
    half = items[1].split()
    texts = {
        1: noise(50), 2: f"{noise(9)} {items[0]} {noise(9)}", 3: items[0].upper().replace(" ", "&&& "), 4: f"{' '.join(half[10:])} {noise(5)} {' '.join(half[:10])}",
        5: f"{noise(5)} {' '.join(items[2].split()[:8])} {noise(5)}", 6: None, 7: "", 8: "a Tiny, item!", 9: f"{items[3]} {items[3]} {noise(4000)}",
    }
    docs = spark.createDataFrame([(k, t, 0, "p") for k, t in texts.items()], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(2, 0), (3, 0), (4, 1), (8, 5), (9, 3)}
    for most in (32_000_000, 200):  # the benchmark at once, and in parts
        found = decontaminate.leaked_items(docs, bench, broadcast_bytes=most).collect()
        assert {(x.doc_id, x.item_id) for x in found} == want
        assert {x.doc_id for x in decontaminate.drop_leaks(docs, bench, broadcast_bytes=most).collect()} == {1, 5, 6, 7}
    assert next(x for x in found if x.doc_id == 4).n_tiles == 2
    assert decontaminate.leaked_items(docs.limit(0), bench).count() == 0
    assert decontaminate.leaked_items(docs, bench.limit(0)).count() == 0


def test_repetitive_items_leak(spark):
    phrase = "one two three four"
    items = [" ".join([phrase] * 10), " ".join([phrase] * 3 + [f"w{k}" for k in range(30)])]
    docs = spark.createDataFrame([(1, f"so {items[0]} then", 0, "p"), (2, f"{phrase} once", 0, "p"), (3, items[1], 0, "p")], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(x.doc_id, x.item_id): x.coverage for x in decontaminate.leaked_items(docs, bench).collect()}
    assert found[1, 0] == 1.0 and found[3, 1] == 1.0 and (2, 0) not in found
    assert {x.doc_id for x in decontaminate.drop_leaks(docs, bench).collect()} == {2}


def test_fingerprints(spark):
    texts = corpus(4, 40)
    rows = rows_of(texts) + [(None, "no place", 0, "p")]
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, SCHEMA), bucket_rows=7).collect()}
    ordered = sorted((k, t or "") for k, t, *_ in rows if k is not None)
    sets = lambda x: {x[i : i + 8] for i in range(0, len(x), 8)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, (k, t) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[1][:q]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(sets(r.fingerprint), sets(r.edited_fingerprint))) < 1e-9
        assert abs(r.near_next - like(sets(r.fingerprint), sets(got[following[0]].fingerprint))) < 1e-9
    by_text = {}
    for k, t in ordered:
        by_text.setdefault(t, set()).add(got[k].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert got[None].n_chars == 8 and got[None].near_next == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(3, "to be or not", 0, "p")], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"to be or to ").hexdigest() and one[0].near_next == 1
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_signatures(text):
    """Anchors and the next two content words of each, word by word."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    common = {w.encode() for w in fingerprints.COMMON.split()}
    found = set()
    for k, w in enumerate(words):
        if w in common or not any(x in common for x in words[max(0, k - fingerprints.GAP) : k]):
            content = [x for x in words[k + 1 :] if x not in common]
            found.add((w, *(content + [None, None])[:2]))
    return found


def test_signatures_equal_brute_force():
    r = random.Random(21)
    v = vocabulary(r, 60)
    texts = [t or "" for t in corpus(5, 30)] + [" ".join(r.choice([*v, "the", "of", "Und", "être"]) for _ in range(r.randint(0, 120))) for _ in range(60)]
    found = fingerprints.signature_sets([t.encode() for t in texts])
    want = [brute_signatures(t) for t in texts]
    assert fingerprints.sizes(found, len(texts)).tolist() == [len(x) for x in want]
    own = np.split(found & np.uint64(0xFFFFFFFF), np.cumsum([len(x) for x in want])[:-1])
    for a, x in zip(own, want):
        for b, y in zip(own, want):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_signatures_are_local():
    r = random.Random(2)
    v = vocabulary(r)
    words = [r.choice([*v, "the", "of", "und"]) for _ in range(300)]
    a = fingerprints.signature_sets([" ".join(words).encode()])
    words[150] = "changed"
    b = fingerprints.signature_sets([" ".join(words).encode()])
    assert len(np.setxor1d(a, b)) < 0.1 * len(a)


def test_near_duplicates_by_signature(spark):
    rows = rows_of(corpus(12, 50))
    got = {r.doc_id: (r.n_signatures, r.class_id) for r in fingerprints.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {k: set(fingerprints.signature_sets([(t or "").encode()]).tolist()) for k, t, *_ in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {k: (len(sets[k]), find(k)) for k in sets}
