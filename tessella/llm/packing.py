"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

Documents are dealt by a hash into groups of bounded size, and each group is packed on its own, so no task sees an
unbounded group and hot sources or duplicate clusters spread over all groups. Within a group, pieces go from large
to small; bins are kept ordered by residual capacity, and each carries bitmaps of the duplicate clusters and sources
it holds. The search starts at the smallest residual that fits and moves on to its successors until a bin without a
conflict is found, which is the tightest compatible one; without any, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import shuffle_partitions
from ._text import find_words, slices, text_bytes

RESULT = "doc_id long, piece int, offset long, n_words long, bin string, position int, fill long"


class Bins:
    """Bins of one group, ordered by residual capacity."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # residual, bin
        self.clusters: list[int] = []  # bitmap of each bin
        self.sources: list[list[int]] = []  # bit-sliced counters: bitmap k has the sources held more than k times
        self.filled: list[int] = []
        self.held: list[int] = []

    def place(self, size: int, cluster_bit: int, source_bit: int) -> tuple[int, int]:
        """Bin and position in it; a bit of 0 conflicts with nothing."""
        for k in range(bisect_left(self.open, (size, -1)), len(self.open)):
            residual, b = self.open[k]
            if not self.clusters[b] & cluster_bit and not self.sources[b][-1] & source_bit:
                del self.open[k]
                break
        else:
            b, residual = len(self.filled), self.capacity
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
            self.filled.append(0)
            self.held.append(0)
        self.clusters[b] |= cluster_bit
        for k, bits in enumerate(self.sources[b] if source_bit else ()):
            if not bits & source_bit:
                self.sources[b][k] = bits | source_bit
                break
        found = b, self.held[b]
        self.held[b] += 1
        self.filled[b] += size
        if residual > size:
            insort(self.open, (residual - size, b))
        return found


def pack(rows: list[tuple], capacity: int, per_source: int) -> list[tuple]:
    """(key, piece, offset, size, bin, position, fill of the bin) of each row (key, size, cluster, source).

    A document longer than the capacity is cut into full pieces, each a bin of its own, and a rest; an empty one is
    a piece of no words.
    """
    shared = [c for c, n in Counter(c for _, _, c, _ in rows if c is not None).items() if n > 1]
    shared += [c for _, size, c, _ in rows if c is not None and size > capacity]  # pieces of one document
    clusters = {c: 1 << k for k, c in enumerate(dict.fromkeys(shared))}
    sources = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for *_, s in rows if s is not None))}
    pieces = []
    for key, size, cluster, source in rows:
        full = max(0, size - 1) // capacity
        pieces += [(min(capacity, size - k * capacity), key, k, cluster, source) for k in range(full + 1)]
    pieces.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0, x[2]))
    bins, out = Bins(capacity, per_source), []
    for size, key, piece, cluster, source in pieces:
        b, position = bins.place(size, clusters.get(cluster, 0), sources.get(source, 0))
        out.append((key, piece, piece * capacity, size, b, position))
    return [(*x, bins.filled[x[4]]) for x in out]


def pack_documents(docs: DataFrame, capacity: int = 2048, per_source: int = 2, group_rows: int = 2048, cluster: Column | None = None) -> DataFrame:
    """Pieces of documents in bins of `capacity` words: doc_id, piece, offset, n_words, bin, position in the bin and
    the bin's fill.

    Uses doc_id, text and source (where there). No bin holds two pieces of one duplicate cluster, by default the
    documents of equal text, or more than per_source pieces of one source; a null cluster or source conflicts with
    nothing. Every row is packed, repeated ones too; an empty or null text is one piece of no words. Ties go to the
    smaller doc_id and the older bin. Groups have about group_rows documents and at most twice as many; each is
    packed on its own, and a bin's name starts with its group. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // group_rows))
    source = F.xxhash64("source") if "source" in docs.columns else F.lit(None).cast("long")
    slim = docs.select(
        "doc_id",
        "text",
        F.when(F.col("source").isNotNull(), source).alias("source") if "source" in docs.columns else source.alias("source"),
        (F.when(F.length("text") > 0, F.xxhash64("text")) if cluster is None else cluster).cast("long").alias("cluster"),
    )

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            counts = np.concatenate([np.zeros(0, np.int64), *(find_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).counts for i, j in slices(offsets))])
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(counts.astype(np.int64)), batch["cluster"], batch["source"]], ["doc_id", "size", "cluster", "source"])

    sizes = slim.mapInArrow(measure, "doc_id long, size long, cluster long, source long")
    dealt = sizes.withColumn("deal", F.pmod(F.xxhash64("doc_id", "size", "cluster"), F.lit(groups)))
    dealt = dealt.repartition(shuffle_partitions(spark), "deal").sortWithinPartitions("deal", "doc_id", "size", "cluster", "source")

    def packed(group: int, part: int, rows: list[tuple]) -> pa.RecordBatch:
        out = pack(rows, capacity, per_source)
        columns = list(zip(*out, strict=True))
        columns[4] = [f"{group}-{part}-{b}" for b in columns[4]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "offset", "n_words", "bin", "position", "fill"])

    def consume(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, rows = -1, 0, []
        for batch in batches:
            for group, *row in zip(*(batch[c].to_pylist() for c in ("deal", "doc_id", "size", "cluster", "source")), strict=True):
                if rows and (group != now or len(rows) >= 2 * group_rows):
                    yield packed(now, part, rows)
                    part, rows = (part + 1 if group == now else 0), []
                now, part = group, part if group == now else 0
                rows.append(tuple(row))
        if rows:
            yield packed(now, part, rows)

    return dealt.mapInArrow(consume, RESULT)
