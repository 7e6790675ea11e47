"""Caps, quotas and round robin over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import budget_prefix, hash_bucket, spare, with_running


def cap_per_group(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group. Spark turns the rank limit into one per task before the shuffle, so a hot group
    sends at most `most` rows from each."""
    (rank,) = spare(df, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= most).drop(rank)


def round_robin_budget(df: DataFrame, by: str, order: list[Column], bucket: Column, value: str, budget: float) -> DataFrame:
    """One row of each group in turn, groups by name, until the values reach the budget; adds `turn`."""
    (before,) = spare(df, "b")
    turns = with_running(df, order, bucket, groups=[by], number="turn", before=before).drop(before)
    return budget_prefix(turns, [F.col("turn"), F.col(by)], F.floor(F.log2(F.col("turn"))).cast("int") * 64 + F.floor(64 * F.col("turn") / F.pow(F.lit(2), F.floor(F.log2(F.col("turn"))))).cast("int") - 64, F.col(value), budget)


def quota_with_topup(df: DataFrame, by: str, hashed: str, key: str, quota: int, total: int) -> DataFrame:
    """The first `quota` rows of each group in hash order, filled up to `total` from the rest in the same order."""
    rank, before = spare(df, "rank", "b")
    ranked = with_running(df, [F.col(hashed), F.col(key)], hash_bucket(F.col(hashed)), groups=[by], number=rank, before=before).drop(before)
    first = ranked.where(F.col(rank) <= quota)
    room = max(0, total - first.count())
    return first.unionByName(ranked.where(F.col(rank) > quota).orderBy(hashed, key).limit(room)).drop(rank)


def largest_first_by_depth(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """Depth first over groups: the first rows of all groups, larger groups first, then the second rows, and so on."""
    depth, size, name = spare(df, "depth", "size", "by")
    first = df.withColumn(depth, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(depth) <= most)  # one limit a task before the shuffle
    sizes = df.groupBy(F.col(by).alias(name)).agg(F.count("*").alias(size))
    ranked = first.join(sizes, F.col(by).eqNullSafe(F.col(name)))
    return ranked.orderBy(depth, F.desc(size), by).limit(most).drop(size, depth, name)
