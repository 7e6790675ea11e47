"""Intervals and word timings: merging, shifting, splitting at gaps, packing between silences, overlapped chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str, pad: float = 0.0) -> DataFrame:
    """Padded intervals of each group, overlapping and touching ones joined."""
    rows = df.select(*by, F.greatest(F.col(start) - pad, F.lit(0.0)).alias("start"), (F.col(end) + pad).alias("end"))
    earlier = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = rows.withColumn("_new", (F.coalesce(F.max("end").over(earlier) < F.col("start"), F.lit(True))).cast("int"))
    island = opens.withColumn("_island", F.sum("_new").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def shifted(items: Column, by: Column) -> Column:
    """Word timings moved by some seconds."""
    return F.transform(items, lambda w: F.struct(w["word"].alias("word"), (w["start"] + by).alias("start"), (w["end"] + by).alias("end")))


def split_at_gaps(starts: list[float], ends: list[float], longest: float, fewest: int = 4) -> list[tuple[int, int]]:
    """Word ranges; a range that lasts too long and has enough words is cut at its widest gap (the last of equals)."""
    todo, out = [(0, len(starts))], []
    while todo:
        a, b = todo.pop()
        if b - a < max(fewest, 2) or ends[b - 1] - starts[a] <= longest:
            out.append((a, b))
            continue
        cut = max(range(a, b - 1), key=lambda k: (starts[k + 1] - ends[k], k)) + 1
        todo += [(cut, b), (a, cut)]
    return out


def segments_of(items: Column, longest: float) -> Column:
    """Array of (start, end) seconds of the ranges that split_at_gaps finds in word timings."""

    @F.pandas_udf(T.ArrayType(SPAN))
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for words in rows:
            s, e = ([float(w[k]) for w in words] for k in ("start", "end")) if words is not None else ([], [])
            out.append([{"start": s[a], "end": e[b - 1]} for a, b in split_at_gaps(s, e, longest)] if s else [])
        return pd.Series(out, dtype=object)

    return run(items)


def silence_cuts(decibels: np.ndarray, frame: float, below: float, least_silence: float) -> list[float]:
    """Middles, in seconds, of runs of frames that are `below` under the loudest for least_silence or longer."""
    quiet = np.concatenate([[False], decibels < decibels.max() + below, [False]]) if len(decibels) else np.zeros(2, bool)
    edge = np.flatnonzero(np.diff(quiet.astype(int)))
    need = int(least_silence / frame)
    return [int(a + b) // 2 * frame for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= need]


def packed_between(cuts: list[float], total: float, shortest: float, longest: float) -> list[tuple[float, float]]:
    """Spans between cuts, each as soon as it is long enough; one that is too long is cut evenly."""
    out, start = [], 0.0
    for cut in [*cuts, total]:
        length = cut - start
        if length < shortest:
            continue
        parts = 1 if length <= longest else int(np.ceil(length / longest))
        edges = [start + k * length / parts for k in range(parts)] + [cut]
        out += [(a, b) for a, b in zip(edges, edges[1:], strict=False) if shortest <= b - a <= longest]
        start = cut
    return out


def overlapped_chunks(seconds: Column, length: float = 30.0, carry: float = 5.0) -> Column:
    """Array of (start, end) of chunks that each repeat the last `carry` seconds of the one before."""
    hop = length - carry
    count = F.greatest(F.ceil((seconds - carry) / hop).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((k * hop).cast("double").alias("start"), F.least(k * hop + length, seconds).cast("double").alias("end")))
