"""Substring dedup by suffix automata of reference shards.

A window is `words` consecutive words of one document; a word goes if a window over it also starts in a document with
a smaller doc_id.

Reference shards cannot be broadcast to all documents once they grow with them, so both are routed by content. The
minimizer of a window, the smallest hash of its GRAM-word runs, depends on the window alone; maximal runs of windows
with one minimizer are segments, and equal windows always lie in segments of the same minimizer. Segments are first
told apart by their minimizer and a hash of their content, 128 bits together: of equal ones, all but those of the smallest doc_id go as a whole. A
minimizer with several contents is a reference shard: a suffix automaton of its contents carries the smallest
doc_id of every substring, and each content is streamed through it for the matching statistics of its windows.
The contents of one minimizer are split into shards of bounded size; the windows that a shard leaves, less those that
a sketch of fixed size shows to be in no other, are then compared between shards by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import blocks, packed_texts, unpacked
from ._shared import materialize, shuffle_partitions
from ._text import _power_tables, find_words, gram_hashes, mix, slices, text_bytes

GRAM = 8
SHARD_CONTENTS = 100
SHARD_WORDS = 30_000
SKETCH_BITS = 22
SALTS = 16  # a window of many documents is compared in so many parts


@dataclass
class Segments:
    """Runs of windows with one minimizer: document, first word, number of windows, minimizer and content hash."""

    doc: np.ndarray
    start: np.ndarray  # word number within the slice
    windows: np.ndarray
    minimizer: np.ndarray
    content: np.ndarray


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of the word hashes h[start:end] of each run."""
    power, inverse = _power_tables(len(h) + 1)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mix(h + np.uint64(salt)) * power[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def segments(h: np.ndarray, first: np.ndarray, words: int) -> Segments:
    n = len(h) - words + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    gram = min(GRAM, words)
    least = _sliding_minimum(gram_hashes(h, gram), words - gram + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[:n] == doc[words - 1 :]
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    at = np.flatnonzero(begins)
    stops = whole.copy()
    stops[:-1] &= ~whole[1:] | (least[1:] != least[:-1])
    end = np.flatnonzero(stops) + 1
    return Segments(doc[at], at, end - at, least[at], run_hashes(h, at, end + words - 1, 1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Automaton:
    """Suffix automaton of several sequences, with the smallest owner of every substring."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[tuple[int, int]] = []  # state of a prefix, owner

    def extend(self, last: int, word: int) -> int:
        following = self.next[last].get(word)
        if following is not None:  # a substring of an earlier sequence
            return following if self.length[following] == self.length[last] + 1 else self.split(last, word, following)
        new = self.state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, word, q)
        return new

    def state(self, length: int, following: dict) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def split(self, p: int, word: int, q: int) -> int:
        copy = self.state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], owner: int) -> None:
        last = 0
        for word in sequence:
            last = self.extend(last, word)
            self.ends.append((last, owner))

    def finish(self) -> None:
        """Smallest owner of each state: prefixes in order of owner mark the suffixes not yet marked."""
        self.least: list[int | None] = [None] * len(self.next)
        for state, owner in sorted(self.ends, key=lambda x: x[1]):
            while state > 0 and self.least[state] is None:
                self.least[state] = owner
                state = self.link[state]

    def owners(self, sequence: list[int], width: int) -> Iterator[tuple[int, int | None]]:
        """Start of each window of the sequence, and its smallest owner (None where no sequence has it)."""
        state = matched = 0
        for k, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= width:
                state = self.link[state]
                matched = self.length[state]
            if k >= width - 1:
                yield k - width + 1, self.least[state] if matched >= width else None


def taken_windows(shard: list[tuple[int, list[int]]], width: int) -> list[list[int]]:
    """Of each (owner, sequence) of a shard, the starts of the windows that a smaller owner has too."""
    if len(shard) == 1:
        return [[]]
    machine = Automaton()
    for owner, sequence in shard:
        machine.add(sequence, owner)
    machine.finish()
    return [[k for k, least in machine.owners(sequence, width) if least is not None and least < owner] for owner, sequence in shard]


def _segment_rows(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        ids = batch["doc_id"].cast(pa.int64())
        for i, j in slices(offsets):
            found = find_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            s = segments(found.hashes(), found.first, words)
            yield pa.record_batch([ids.take(pa.array(i + s.doc)), _signed(s.minimizer), _signed(s.content), pa.array(s.windows.astype(np.int32))], ["doc_id", "minimizer", "content", "windows"])


def _requested_words(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Words of the asked contents of each document, as bytes of their hashes."""
    for batch in batches:
        for i, j, blobs in blocks(batch["packed"]):
            data, offsets = unpacked(blobs)
            found = find_words(data, offsets)
            h = found.hashes()
            s = segments(h, found.first, words)
            out: tuple[list, ...] = ([], [], [], [], [], [])
            bounds = np.searchsorted(s.doc, np.arange(j - i + 1))
            content, minimizer = s.content.view(np.int64).tolist(), s.minimizer.view(np.int64).tolist()
            for k, (doc, asked) in enumerate(zip(batch["doc_id"][i:j].to_pylist(), batch["asked"][i:j].to_pylist(), strict=True)):
                shard = {x["content"]: (x["part"], x["split"]) for x in asked}
                for n in range(bounds[k], bounds[k + 1]):
                    if content[n] in shard:
                        run = h[s.start[n] : s.start[n] + s.windows[n] + words - 1]
                        for column, value in zip(out, (doc, minimizer[n], content[n], *shard.pop(content[n]), run.tobytes()), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "minimizer", "content", "part", "split", "run"])


def _shard_verdicts(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by minimizer and part. Gives the windows of each content that a smaller doc_id of its shard has
    and, where the minimizer has several shards, the others with their hashes."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        runs = [np.frombuffer(row[-1], np.uint64) for row in rows]
        _, number = np.unique(np.concatenate(runs), return_inverse=True)
        cuts = np.cumsum([len(r) for r in runs])[:-1]
        taken = taken_windows([(row[2], part.tolist()) for row, part in zip(rows, np.split(number, cuts), strict=True)], words)
        out = []
        for (_, _, doc, content, split, _), run, gone in zip(rows, runs, taken, strict=True):
            left = np.setdiff1d(np.arange(len(run) - words + 1), gone) if split else np.zeros(0, np.int64)
            if gone or len(left):
                hashes = [run_hashes(run, left, left + words, salt).view(np.int64) for salt in (2, 3)]
                out.append((doc, content, gone or None, left, *hashes))
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "content", "taken", "left", "hash_a", "hash_b"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("minimizer", "part", "doc_id", "content", "split", "run")), strict=True):
            if rows and rows[0][:2] != row[:2]:
                yield from settle(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from settle(rows)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _window_sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often (0, 1, or 2 and more) each cell has a window; a row for each task."""
    cells = np.zeros(1 << SKETCH_BITS, np.uint8)
    for batch in batches:
        values = batch["hash_a"].flatten().to_numpy()
        at, times = np.unique(_cells(values), return_counts=True)
        cells[at] = np.minimum(cells[at] + np.minimum(times, 2), 2)
    yield pa.record_batch([pa.array([zstandard.compress(cells.tobytes())], pa.binary())], ["sketch"])


def _add_sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(1 << SKETCH_BITS, np.uint8)
    for batch in batches:
        for blob in batch["sketch"].to_pylist():
            cells = np.minimum(cells + np.frombuffer(zstandard.decompress(blob), np.uint8), 2)
    yield pa.record_batch([pa.array([zstandard.compress(cells.tobytes())], pa.binary())], ["sketch"])


def _window_rows(batches: Iterable[pa.RecordBatch], cells) -> Iterator[pa.RecordBatch]:
    """A row for each left window whose cell has several."""
    for batch in batches:
        size = np.diff(batch["left"].offsets.to_numpy())
        row = np.repeat(np.arange(len(batch)), size)
        a, b, at = (batch[c].flatten().to_numpy() for c in ("hash_a", "hash_b", "left"))
        keep = cells.value[_cells(a)] > 1
        own = pa.array(row[keep])
        yield pa.record_batch([batch["doc_id"].take(own), batch["content"].take(own), pa.array(at[keep]), pa.array(a[keep]), pa.array(b[keep])], ["doc_id", "content", "at", "hash_a", "hash_b"])


def _kept_words(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, blobs in blocks(batch["packed"]):
            data, offsets = unpacked(blobs)
            found = find_words(data, offsets)
            gone = np.zeros(len(found.start) + 1, np.int64)
            verdicts = batch["verdicts"][i:j].to_pylist()
            if any(verdicts):
                s = segments(found.hashes(), found.first, words)
                bounds = np.searchsorted(s.doc, np.arange(j - i + 1))
                content = s.content.view(np.int64).tolist()
                for k, listed in enumerate(verdicts):
                    said: dict = {}
                    for v in listed or ():  # a content may have verdicts from its shard and from between shards
                        said[v["content"]] = None if v["taken"] is None else said.get(v["content"], []) + v["taken"]
                    for n in range(bounds[k], bounds[k + 1]) if said else ():
                        if content[n] in said:
                            taken, at = said[content[n]], int(s.start[n])
                            if taken is None:
                                gone[at] += 1
                                gone[at + int(s.windows[n]) + words - 1] -= 1
                            else:
                                begin = at + np.array(taken)
                                np.add.at(gone, begin, 1)
                                np.add.at(gone, begin + words, -1)
            gone = np.cumsum(gone)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[found.first[1:]] - sums[found.first[:-1]]
            kept, raw = ~gone, data.tobytes()
            pieces = list(map(raw.__getitem__, map(slice, found.start[kept].tolist(), found.end[kept].tolist())))
            ends = np.concatenate([[0], np.cumsum(kept)])[found.first].tolist()
            texts = [b" ".join(pieces[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch(
                [batch["doc_id"][i:j], pa.array(found.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


def remove_repeats(docs: DataFrame, words: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words joined by one space) of each document.

    Only doc_id and text are read. A null text has no words. Documents are told apart by doc_id alone: rows of one
    doc_id never take from each other, and each of them loses what smaller ids have. A row without doc_id keeps
    everything and takes nothing. Windows are judged on the input. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(partial(_segment_rows, words=words), "doc_id long, minimizer long, content long, windows int")
    rows = materialize(rows, "segments")
    contents = rows.groupBy("minimizer", "content").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), F.max("windows").alias("windows"))
    parts = F.ceil(F.greatest(F.col("n") / SHARD_CONTENTS, F.col("size") / SHARD_WORDS)).cast("int")
    shards = contents.groupBy("minimizer").agg(F.count("*").alias("n"), F.sum(F.col("windows") + words).alias("size"), F.min("owner").alias("low"), F.max("other").alias("high")).where("low < high")
    active = contents.join(shards, "minimizer").select("minimizer", "content", "owner", "other", (F.col("n") > 1).alias("mixed"), F.pmod(F.xxhash64("content"), parts).cast("int").alias("part"), (parts > 1).alias("split"))
    active = materialize(active, "active")

    whole = rows.select("doc_id", "minimizer", "content").join(active.where("owner < other").select("minimizer", "content", "owner"), ["minimizer", "content"]).where("doc_id > owner").select("doc_id", "content", F.lit(None).cast("array<int>").alias("taken"))

    asked = active.where("mixed").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_set(F.struct("content", "part", "split")).alias("asked"))
    runs = packed_texts(docs).join(asked, "doc_id").mapInArrow(partial(_requested_words, words=words), "doc_id long, minimizer long, content long, part int, split boolean, run binary")
    runs = runs.repartition(shuffle_partitions(spark), "minimizer", "part").sortWithinPartitions("minimizer", "part", "doc_id", "content")
    judged = materialize(runs.mapInArrow(partial(_shard_verdicts, words=words), "doc_id long, content long, taken array<int>, left array<int>, hash_a array<long>, hash_b array<long>"), "judged")
    some = judged.where("taken is not null").select("doc_id", "content", "taken")
    between = judged.where("size(left) > 0").select("doc_id", "content", "left", "hash_a", "hash_b")
    sketches = between.select("hash_a").mapInArrow(_window_sketch, "sketch binary").repartition(16).mapInArrow(_add_sketches, "sketch binary").collect()
    cells = np.zeros(1 << SKETCH_BITS, np.uint8)
    for sketch in sketches:
        cells = np.minimum(cells + np.frombuffer(zstandard.decompress(sketch[0]), np.uint8), 2)
    windows = between.mapInArrow(partial(_window_rows, cells=spark.sparkContext.broadcast(cells)), "doc_id long, content long, at int, hash_a long, hash_b long")
    least = windows.groupBy("hash_a", "hash_b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    more = salted.join(least, ["hash_a", "hash_b", "salt"]).where("doc_id > low").groupBy("doc_id", "content").agg(F.collect_set("at").alias("taken"))

    verdicts = whole.unionByName(some).unionByName(more).groupBy("doc_id").agg(F.collect_list(F.struct("content", "taken")).alias("verdicts"))
    return packed_texts(docs).join(verdicts, "doc_id", "left").mapInArrow(partial(_kept_words, words=words), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
