"""Benchmark decontamination by greedy string tiling.

A document that shares a run of SEED words with a benchmark item is tiled against that item: of the matches between
unmarked words, the longest are found by Karp-Rabin hashes of falling lengths, verified word by word and marked, so
that tiles never overlap, until no match of the least length is left. The item is leaked if tiles cover a large
enough share of its words, in whatever order the passages stand in the document.

Words are lower-cased runs of letters, digits and bytes beyond ASCII; punctuation separates them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, find_words, gram_hashes, slices, text_bytes, whole_runs

SEED = 4
_PUNCTUATION = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _PUNCTUATION[_low:_high] = False

RESULT = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of the first word of each document."""
    words = find_words(data, offsets, _PUNCTUATION)
    return words.hashes(LOWER), words.first


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length) of non-overlapping longest matches.

    Among matches of equal length the one that starts first in the pattern, then in the text, is marked first.
    """
    free_p, free_t = [True] * len(pattern), [True] * len(text)
    found: list[tuple[int, int, int]] = []
    length = _longest(pattern, text, free_p, free_t, least)
    while length >= least:
        matches = _matches(pattern, text, free_p, free_t, length)
        for p, t in matches:
            if all(free_p[p : p + length]) and all(free_t[t : t + length]):
                free_p[p : p + length] = [False] * length
                free_t[t : t + length] = [False] * length
                found.append((p, t, length))
        length = min(length - 1, _longest(pattern, text, free_p, free_t, least)) if matches else length - 1
    return found


def _unmarked(words: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Start and rolling hash of every run of `length` unmarked words."""
    mask, base = (1 << 61) - 1, 1_000_003
    top = pow(base, length, mask)
    h = run = 0
    for k, w in enumerate(words):
        if not free[k]:
            h = run = 0
            continue
        h, run = (h * base + w) % mask, run + 1
        if run > length:
            h = (h - words[k - length] * top) % mask
        if run >= length:
            yield k - length + 1, h


def _matches(pattern: list[int], text: list[int], free_p: list[bool], free_t: list[bool], length: int) -> list[tuple[int, int]]:
    starts = defaultdict(list)
    for t, h in _unmarked(text, free_t, length):
        starts[h].append(t)
    return [(p, t) for p, h in _unmarked(pattern, free_p, length) for t in starts.get(h, ()) if pattern[p : p + length] == text[t : t + length]]


def _longest(pattern: list[int], text: list[int], free_p: list[bool], free_t: list[bool], least: int) -> int:
    """Length of the longest unmarked match, by binary search over Karp-Rabin passes; 0 if below least."""
    low, high = least - 1, min(len(pattern), len(text))
    while low < high:
        middle = (low + high + 1) // 2
        there = {h for _, h in _unmarked(text, free_t, middle)}
        if any(h in there for _, h in _unmarked(pattern, free_p, middle)):
            low = middle
        else:
            high = middle - 1
    return low if low >= least else 0


@dataclass
class Benchmark:
    """Items as word hashes, and for each seed length a sorted index of their seeds."""

    ids: list
    words: list[list[int]]
    grams: list[np.ndarray]  # seeds by first word
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # sorted seeds, item of each, sieve

    @classmethod
    def of(cls, rows: pa.Table, seed: int) -> Benchmark:
        data, offsets = text_bytes(rows["text"])
        hashes, first = word_hashes(data, offsets)
        items = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        every = [gram_hashes(own, min(seed, len(own))) if len(own) else np.zeros(0, np.uint64) for own in items]
        by_length: dict[int, list] = defaultdict(list)
        for k, own in enumerate(items):
            if len(own):  # an item shorter than a seed is its own seed
                grams = np.unique(every[k])
                by_length[min(seed, len(own))].append((grams, np.full(len(grams), k)))
        index = {}
        for n, parts in by_length.items():
            grams, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((owners, grams))
            sieve = np.zeros(1 << 20, bool)
            sieve[grams >> np.uint64(44)] = True
            index[n] = grams[order], owners[order], sieve
        return cls(rows["item_id"].to_pylist(), [x.tolist() for x in items], every, index)

    def leaks(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, coverage, tiles, longest tile) of each pair that reaches the threshold."""
        hashes, first = word_hashes(data, offsets)
        for n, (seeds, owners, sieve) in self.seeds.items():
            grams = gram_hashes(hashes, n)
            at = np.flatnonzero(sieve[grams >> np.uint64(44)] & whole_runs(first, n, len(grams)))
            low = np.searchsorted(seeds, grams[at], "left")
            times = np.searchsorted(seeds, grams[at], "right") - low
            at, low, times = at[times > 0], low[times > 0], times[times > 0]
            if not len(at):
                continue
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item = owners[np.repeat(low, times) + within]
            word = np.repeat(at, times)
            doc = np.searchsorted(first, word, "right") - 1
            order = np.lexsort((word, item, doc))
            doc, item, word = doc[order], item[order], word[order]
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
            for d, i, hits in zip(doc[np.concatenate([[0], cuts])].tolist(), item[np.concatenate([[0], cuts])].tolist(), np.split(word, cuts), strict=True):
                pattern = self.words[i]
                if coverable(self.grams[i], np.unique(grams[hits]), n) < threshold * len(pattern):
                    continue  # a tile holds only words of the item that shared seeds cover
                found = tiles(pattern, _covered(hashes, hits, n), n)
                coverage = sum(x[2] for x in found) / len(pattern)
                if coverage >= threshold:
                    yield d, i, coverage, len(found), max(x[2] for x in found)


def coverable(own: np.ndarray, shared: np.ndarray, n: int) -> int:
    """Words of an item that shared seeds cover at all their places; own are its seeds by first word."""
    at = np.flatnonzero(np.isin(own, shared))
    return int(np.minimum(np.diff(at), n).sum()) + n if len(at) else 0


def _covered(hashes: np.ndarray, hits: np.ndarray, n: int) -> list[int]:
    """The words that seeds cover, with a mark between runs; no match of n words reaches beyond them."""
    out: list[int] = []
    breaks = np.flatnonzero(np.diff(hits) > n) + 1  # runs that touch or overlap stay together
    for k, run in enumerate(np.split(hits, breaks)):
        out += [-1 - k, *hashes[int(run[0]) : int(run[-1]) + n].tolist()]
    return out


def _shards(benchmark: DataFrame, most_bytes: int, seed: int) -> Iterator[Benchmark]:
    """The benchmark in parts of about most_bytes at most, so that what is broadcast has a bound."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // most_bytes) or 1
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield Benchmark.of(part.toArrow().sort_by("item_id"), seed)


def _judged(column: pa.Array, benchmark: Benchmark, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        for d, *rest in benchmark.leaks(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], threshold):
            yield i + d, *rest


def leaked_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = SEED, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """doc_id, item_id, coverage (share of the item's words under tiles), n_tiles and longest (words of the longest
    tile), of each document and benchmark item with a coverage of threshold or more.

    seed is both the least tile and the length of seeds; an item with fewer words must occur whole. Texts without
    words, null ones too, leak nothing. Repeated rows, of documents or items, are judged one by one. A benchmark
    larger than broadcast_bytes is gone through in parts, with a pass over the documents for each. Empty tables
    give an empty result. Of docs only doc_id and text are read, of benchmark item_id and text.
    """
    spark, results = docs.sparkSession, []
    for part in _shards(benchmark, broadcast_bytes, seed):
        sent = spark.sparkContext.broadcast(part)

        def judge(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_judged(batch["text"], sent.value, threshold))
                doc, item, coverage, count, longest = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.record_batch(
                    [batch["doc_id"].take(pa.array(doc, pa.int64())).cast(pa.int64()), pa.array([sent.value.ids[i] for i in item], pa.int64()), pa.array(coverage, pa.float64()), pa.array(count, pa.int32()), pa.array(longest, pa.int32())],
                    ["doc_id", "item_id", "coverage", "n_tiles", "longest"],
                )

        results.append(docs.select("doc_id", "text").mapInArrow(judge, RESULT))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = SEED, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """The rows of docs, with all columns, that leak no benchmark item, as leaked_items judges."""
    for part in _shards(benchmark, broadcast_bytes, seed):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[row[0] for row in _judged(batch["text"], sent.value, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
