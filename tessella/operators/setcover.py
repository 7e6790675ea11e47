"""Greedy weighted set cover: terms gained per second, until nothing is gained or the budget is reached."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

DRIVER_ROWS = 50_000
WRITE_EACH = 8  # picks between writes of the pool, so that its plan stays short


def _exact(rows: list[tuple], covered: set[str], spent: float, budget: float) -> list[tuple]:
    """Lazy greedy on rows (key, seconds, terms), which come ordered by key: a stale gain is computed anew when its
    row comes to the top."""
    heap = [(-len(set(terms) - covered) / max(seconds, 1.0), k) for k, (_, seconds, terms) in enumerate(rows)]
    heapq.heapify(heap)
    picked = []
    while heap and spent < budget:
        _, k = heapq.heappop(heap)
        key, seconds, terms = rows[k]
        new = set(terms) - covered
        gain = -len(new) / max(seconds, 1.0)
        if not new:
            continue
        if heap and (gain, k) > heap[0]:
            heapq.heappush(heap, (gain, k))
            continue
        picked.append((key, len(picked) + 1, len(new)))
        covered |= new
        spent += seconds
    return picked


def greedy_cover(df: DataFrame, key: str, seconds: Column, terms: Column, budget: float = float("inf")) -> DataFrame:
    """key, pick (order from 1) and gained terms of each picked row.

    Ties go to the smaller key. A row can only be picked if it is the best of some term set, so of rows with equal
    terms only the shortest one (then the smallest key) competes; this leaves as many candidates as there are term
    sets. While these are too many for the driver, rows are picked one by one with a distributed arg-max.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), seconds.cast("double").alias("_seconds"), F.array_sort(F.array_distinct(terms)).alias("_terms"))
    weight = F.greatest(F.col("_seconds"), F.lit(1.0))
    best = rows.groupBy("_terms").agg(F.min(F.struct(weight.alias("w"), F.col("_key").alias("k"), F.col("_seconds").alias("s"))).alias("_best"))
    pool = materialize(best.select(F.col("_best")["k"].alias("_key"), F.col("_best")["s"].alias("_seconds"), "_terms"), "cover").where("size(_terms) > 0")  # before the write, the filter would compute the terms once more
    covered: set[str] = set()
    spent, picked = 0.0, []
    while spent < budget:
        if pool.limit(DRIVER_ROWS + 1).count() <= DRIVER_ROWS:
            later = _exact(sorted(map(tuple, pool.collect())), covered, spent, budget)
            picked += [(k, n + len(picked), g) for k, n, g in later]
            break
        top = pool.select(F.struct((F.size("_terms") / F.greatest("_seconds", F.lit(1.0))).alias("g"), (-F.col("_key")).alias("nk"), "_seconds", "_terms").alias("r")).agg(F.max("r").alias("r")).first()["r"]
        picked.append((-top["nk"], len(picked) + 1, len(top["_terms"])))
        covered |= set(top["_terms"])
        spent += top["_seconds"]
        gone = F.array(*map(F.lit, sorted(top["_terms"])))  # terms that are covered by now leave the pool
        pool = pool.withColumn("_terms", F.array_except("_terms", gone)).where("size(_terms) > 0")
        if len(picked) % WRITE_EACH == 0:
            pool = materialize(pool, "cover")
    return spark.createDataFrame(picked, f"{key} {dict(df.dtypes)[key]}, pick int, gained int")
