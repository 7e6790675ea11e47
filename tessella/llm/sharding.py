"""Sharding by minimax contiguous partition over ordered atomic groups.

Documents with equal texts form one atomic group and stay together. Groups are ordered by a hash of their text;
a fixed number of hash ranges (units_per_shard * shards) are the atomic sizes that the driver sees, so what it
collects does not grow with the data. The smallest feasible shard capacity is found by binary search with a
greedy check over prefix sums. Among the cuts that this capacity allows, each is set as near as possible to its
equal share, which keeps the last shard from being left short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

ROW_BYTES = 16


def feasible(prefix: np.ndarray, shards: int, capacity: int) -> bool:
    """Greedy check: do at most `shards` runs of at most `capacity` hold all groups?"""
    at = 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if at == len(prefix) - 1:
            return True
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Smallest capacity with which the ordered groups fit in `shards` contiguous runs (0 without groups)."""
    if not len(sizes):
        return 0
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high = max(int(sizes.max()), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if feasible(prefix, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shards - 1 group numbers at which to cut; no shard exceeds the smallest feasible capacity."""
    sizes = np.asarray(sizes, np.int64)
    capacity = smallest_capacity(sizes, shards)
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    earliest = [len(sizes)]
    for _ in range(shards - 1):  # from the right: the rest must still fit
        earliest.append(int(np.searchsorted(prefix, prefix[earliest[-1]] - capacity, "left")))
    earliest = earliest[::-1]
    cuts, at = [], 0
    for k in range(1, shards):
        latest = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        share = prefix[-1] * k / shards
        near = int(np.searchsorted(prefix, share, "left"))
        near -= near > 0 and (near > len(sizes) or share - prefix[near - 1] < prefix[near] - share)
        at = min(max(near, earliest[k], at), latest)
        cuts.append(at)
    return np.array(cuts, np.int64)


def _cut_number(value: Column, cuts: list[int], low: int = 0) -> Column:
    """Number of cuts at or below value, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(low)
    middle = len(cuts) // 2
    return F.when(value < cuts[middle], _cut_number(value, cuts[:middle], low)).otherwise(_cut_number(value, cuts[middle + 1 :], low + middle + 1))


def assign_shards(docs: DataFrame, shards: int = 40, units_per_shard: int = 1024, slot_units: int = 64) -> DataFrame:
    """Shard and slot of each document, under the law that shard sizes in bytes are near equal.

    Uses doc_id and text; other columns are ignored. A null text counts as empty: its size is 16 and its group is
    that of the empty text. Repeated rows are rows of their own, and their order among equals is arbitrary. An
    empty table gives an empty result. Slots number each shard's rows without gaps; they are dealt by a hash of
    doc_id, so that a large group of equal texts is spread over many tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(shards * units_per_shard)).cast("int").alias("_unit"),
    )
    slim = materialize(slim, "shard-sizes")
    found = slim.groupBy("_unit").agg(F.sum("size").alias("size")).toArrow()
    sizes = np.zeros(shards * units_per_shard, np.int64)
    sizes[found["_unit"].to_numpy()] = found["size"].to_numpy()
    cuts = minimax_cuts(sizes, shards)
    dealt = slim.withColumn("shard", _cut_number(F.col("_unit"), [int(c) for c in cuts])).withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(slot_units)).cast("int"))
    held = dealt.groupBy("shard", "_deal").count().toArrow().to_pylist()
    base, rows = 0, []
    for k, cell in enumerate(sorted(held, key=lambda x: (x["shard"], x["_deal"]))):
        base = 0 if not k or rows[-1][0] != cell["shard"] else base
        rows.append((cell["shard"], cell["_deal"], base))
        base += cell["count"]
    offsets = docs.sparkSession.createDataFrame(rows, "shard int, _deal int, _base long")  # at most shards * slot_units rows
    order = Window.partitionBy("shard", "_deal").orderBy("doc_id", "text_crc32", "size")
    return dealt.join(F.broadcast(offsets), ["shard", "_deal"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_base") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
