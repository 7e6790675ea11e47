"""First-seen deduplication, by one key or by either of two."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize
from .ordered import spare


def first_seen(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Of the rows of each key the first in order, as a partial aggregate: a hot key leaves one row for each task."""
    row = F.struct(*(F.col(c) for c in order), F.struct(*(F.col(c) for c in df.columns if c not in order)).alias("_rest"))
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    best = df.groupBy(*named).agg(F.min(row).alias("_row"))
    return best.select(*(F.col("_row")[c].alias(c) if c in order else F.col("_row")["_rest"][c].alias(c) for c in df.columns))


def last_written(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of each key the last in order."""
    value = F.max_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct(*order))
    return df.groupBy(*keys).agg(value.alias("_row")).select(*(c if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


REPLAY_ROWS = 500_000
WIDEST = 62  # ranges of one round at most: a key's ranges are bits of a long, whose lowest marks registered keys
REGISTERED, UNSURE = 1, 2


def _replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays one range: first what is known of its keys, then its rows in order. Rows that stay come back, and rows
    that wait for an earlier range as open."""
    known: dict = {}
    for batch in batches:
        told, one, two = (batch[c].to_numpy(zero_copy_only=False).tolist() for c in ("_told", "_one", "_two"))
        verdict = bytearray(len(told))
        for k, (state, a, b) in enumerate(zip(told, one, two, strict=True)):
            if state:
                known[a] = state
                continue
            x, y = known.get(a, 0), known.get(b, 0)
            if x != REGISTERED and y != REGISTERED:
                known[a] = known[b] = verdict[k] = UNSURE if x or y else REGISTERED
        found = np.frombuffer(verdict, np.uint8)
        rows = batch.select(["_at", "_one", "_two", "_piece"]).append_column("_open", pa.array(found == UNSURE))
        yield rows.filter(pa.array(found > 0))


def admitted_by_either_key(df: DataFrame, first: str, second: str, order: str, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """Replays rows in order; a row stays if none of its keys, in one shared namespace, was registered by a row that
    stayed. A null key registers nothing, and a row without keys stays. Nulls come first in the order; ties go by the
    first key, then the second (each stands in for the other where that is null). Of rows alike in order and keys one
    stays, the least by the other columns that can be ordered.

    By rounds: the open rows are cut into ranges of the order, of about replay_rows at most, and each range is replayed
    in a task of its own. A key that an earlier range's open rows have is unsure there, and so are the keys of a row
    that waits for one; such a row stays open, all others are settled for good. The first range never waits, so
    every round settles a range or more; a round takes twice as many ranges when the last one settled half of its rows.
    """
    one, two = spare(df, "one", "two")
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in (first, second))
    a, b = (F.col(c).cast("bigint" if whole else "string") for c in (first, second))
    keyed = df.withColumns({one: F.coalesce(a, b), two: F.coalesce(b, a)})
    named = ["_at", "_one", "_two"]
    rows = keyed.where(F.col(one).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip((order, one, two), named, strict=True)))
    pieces = max(1, -(-rows.count() // max(1, replay_rows // 4)))
    cut = materialize(rows.repartitionByRange(pieces, *named).withColumn("_piece", F.spark_partition_id()), "replay")
    sizes = {x["_piece"]: x["count"] for x in cut.groupBy("_piece").count().collect()}
    out = T.StructType([*cut.schema.fields, T.StructField("_open", T.BooleanType())])
    left, begun, width, stays = None, 0, 1, []
    while sizes:
        starts, filled, upto = [], 0, -1
        for piece in sorted(sizes):
            if not starts or filled + sizes[piece] > replay_rows:
                if len(starts) == width:
                    break
                starts, filled = [*starts, piece], 0
            filled, upto = filled + sizes[piece], piece
        parts = len(starts)
        now = [x for x in (left, cut.where(F.col("_piece").between(begun, upto)) if upto >= begun else None) if x is not None]
        now = reduce(DataFrame.unionByName, now).withColumn("_part", reduce(add, ((F.col("_piece") >= k).cast("int") for k in starts[1:]), F.lit(0)))
        bit = F.call_function("shiftleft", F.lit(2).cast("bigint"), F.col("_part"))
        bits = [now.select(F.explode(F.array("_one", "_two")).alias("_key"), bit.alias("_bits"))]
        bits += [x.select(F.explode(F.array("_one", "_two")).alias("_key"), F.lit(1).cast("bigint").alias("_bits")) for x in stays]
        keys = reduce(DataFrame.unionByName, bits).groupBy("_key").agg(F.bit_or("_bits").alias("_bits"))
        keys = keys.where(F.col("_bits").bitwiseAND(F.col("_bits") - 1) != 0).withColumn("_part", F.explode(F.array(*map(F.lit, range(parts)))))
        keys = keys.where((F.col("_bits").bitwiseAND(bit) != 0) & (F.col("_bits").bitwiseAND(bit - 1) != 0))
        told = F.when(F.col("_bits").bitwiseAND(F.lit(1)) != 0, REGISTERED).otherwise(UNSURE)
        none = {c: F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in ("_at", "_piece")}
        told = keys.select("_part", none["_at"], F.col("_key").alias("_one"), F.col("_key").alias("_two"), none["_piece"], told.alias("_told"))
        sent = told.unionByName(now.withColumn("_told", F.lit(0))).repartitionById(parts, "_part")
        done = materialize(sent.sortWithinPartitions("_at", F.col("_told") == 0, "_one", "_two").mapInArrow(_replay, out), "replay")
        stays.append(done.where(~F.col("_open")).select(*named))
        left = done.where("_open").drop("_open")
        open_now = {x["_piece"]: x["count"] for x in left.groupBy("_piece").count().collect()}
        if 2 * sum(open_now.values()) <= sum(sizes[k] for k in sizes if k <= upto):
            width = min(2 * width, WIDEST)
        sizes, begun = open_now | {k: v for k, v in sizes.items() if k > upto}, max(begun, upto + 1)
    admitted = reduce(DataFrame.unionByName, stays, cut.where("false").select(*named))
    same = keyed[order].eqNullSafe(admitted["_at"]) & (keyed[one] == admitted["_one"]) & (keyed[two] == admitted["_two"])
    rank = [f.name for f in df.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    kept = keyed.join(admitted, same, "left_semi").groupBy(order, one, two).agg(F.min_by(F.struct(*df.columns), F.struct(*rank)).alias("_row"))
    return kept.select("_row.*").unionByName(keyed.where(F.col(one).isNull()).select(*df.columns))
