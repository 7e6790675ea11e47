"""Word finding and hashing, token counts and sharding, against plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import _text, sharding
from tessella.llm.token_counts import TokenCounter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, extra int, n_tokens string"


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\r\x0b\x0c\x00字", max_size=30)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts):
    data, offsets = _text.text_bytes(pa.array(texts, pa.string()))
    words = _text.find_words(data, offsets)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [w for ws in want for w in ws]
    assert [bytes(data[a:b]).decode() for a, b in zip(words.start, words.end)] == flat
    assert words.counts.tolist() == [len(w) for w in want]
    hashes = words.hashes().tolist()
    assert len(set(hashes)) == len(set(flat)) and len({*zip(hashes, flat)}) == len(set(flat))


def test_hashes_do_not_depend_on_the_batch():
    alone = _text.find_words(*_text.text_bytes(pa.array(["some words here"]))).hashes()
    among = _text.find_words(*_text.text_bytes(pa.array(["x" * 999, "some words here"]))).hashes()[1:]
    assert alone.tolist() == among.tolist()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_library(library, counter, texts):
    assert counter.counts(list(texts)).tolist() == library(texts)


def test_counts_of_every_code_point(library, counter):
    """Beside a sign, a letter and a digit; also those that only newer versions of Unicode know."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"¢{c} A{c}1{c}" for c in points[k : k + 16]) for k in range(0, len(points), 16)]
    for k in range(0, len(texts), 4000):
        assert counter.counts(texts[k : k + 4000]).tolist() == library(texts[k : k + 4000])


def test_counts_of_odd_texts(library, counter):
    r = random.Random(1)
    parts = ["the", "internationalization", "haha", "....", "!!!!!!", "=====", "<|endoftext|>", "<|startoftext|>", "'s", "'re", "'r", "'l", "we'll'd", "ΟΔΟΣ", "İ", "字", "9½Ⅷ", "\x1c", "\u0085"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += ["", " ", "'", "x" * 20_000, "a " * 5000, "".join(r.choice("eristhan") for _ in range(3000))]
    assert counter.counts(list(texts)).tolist() == library(texts)


def test_small_tables_start_anew(library):
    import tessella.llm.token_counts as module

    old, module.TABLE_CELLS = module.TABLE_CELLS, 1 << 12
    try:
        small = TokenCounter(PATH)
        texts = ["".join(random.Random(k).choice("abcdefghé'") for _ in range(200)) for k in range(30)]
        assert small.counts(list(texts)).tolist() == library(texts)
    finally:
        module.TABLE_CELLS = old


def test_token_query_on_odd_rows(spark, library):
    rows = [(1, None, 0, "x"), (2, "", 0, "x"), (None, "a b", 0, "x"), (2, "Hello world", 1, "y"), (2, "Hello world", 1, "y"), (3, "w " * 2049, 0, "x"), (4, "w " * 2048, 0, "x")]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, SCHEMA), PATH).collect()), key=repr)
    want = sorted(((k, len((t or "").encode()), library([t or ""])[0], library([t or ""])[0] > 2048) for k, t, *_ in rows), key=repr)
    assert got == want
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def brute_capacity(sizes, shards):
    """Smallest possible largest run, by dynamic programming."""
    best = [[float("inf")] * (shards + 1) for _ in range(len(sizes) + 1)]
    best[0] = [0] * (shards + 1)
    for i in range(1, len(sizes) + 1):
        for k in range(1, shards + 1):
            best[i][k] = min(max(best[j][k - 1], sum(sizes[j:i])) for j in range(i))
    return best[len(sizes)][shards]


@given(st.lists(st.integers(0, 30), min_size=1, max_size=12), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_cuts_are_minimax(sizes, shards):
    want = brute_capacity(sizes, shards)
    assert sharding.smallest_capacity(np.array(sizes), shards) == want
    cuts = [0, *sharding.minimax_cuts(np.array(sizes), shards).tolist(), len(sizes)]
    assert cuts == sorted(cuts) and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == want


def test_shards_of_odd_rows(spark):
    rows = [(k, f"text {k % 50} " * (k % 7), 0, "x") for k in range(400)] + [(7, None, 0, "x"), (None, "lost", 1, "y"), (7, "text 7 " * 7, 1, "y")] + [(1000 + k, "copy", 0, "x") for k in range(200)]
    got = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), shards=4).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
        texts.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in rows if k is not None)
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0
