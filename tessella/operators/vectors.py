"""Vectors in array columns: similarity, centroids, dispersion, and nearest neighbours against a checked small side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

BROADCAST_ROWS = 20_000
ANCHOR_BLOCK = 8_192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    return bound(F.nullif(norm(a), F.lit(0.0)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def mixed(a: Column, b: Column, weight: float) -> Column:
    """(1 - weight) * a + weight * b, element by element."""
    return F.zip_with(a, b, lambda x, y: x * (1 - weight) + y * weight)


def steered(a: Column, direction: Column, scale: float) -> Column:
    """a moved along a unit direction, with its old norm."""
    moved = F.zip_with(a, direction, lambda x, d: x + d * scale)
    return bound(norm(a), lambda n: F.transform(unit(moved), lambda x: x * n))


def centroids(df: DataFrame, vector: str, by: str) -> DataFrame:
    """Unit mean of unit vectors of each group, partially aggregated per dimension."""
    parts = df.select(by, F.posexplode(unit(F.col(vector))).alias("_dim", "_x")).groupBy(by, "_dim").agg(F.avg("_x").alias("_x"))
    whole = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_dim", "_x"))).alias("_parts"))
    return whole.select(by, unit(F.col("_parts._x")).alias("centroid"))


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is known to have few rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def nearest(df: DataFrame, key: str, vector: str, anchors: DataFrame, anchor_key: str, anchor_vector: str, block: int = ANCHOR_BLOCK) -> DataFrame:
    """Of each row the anchor with the largest cosine (rounded to nine places); ties go to the smaller anchor.

    Anchors go in blocks of about `block` rows, each broadcast for one pass over df; the partial aggregate keeps one row
    for each key and task, so no pairs leave a task.
    """
    few, best = anchors.select(F.col(anchor_key).alias("_anchor"), F.col(anchor_vector).alias("_vector")), None
    parts = max(1, -(-few.count() // block))
    for k in range(parts):
        part = few.where(F.pmod(F.xxhash64("_anchor"), F.lit(parts)) == k) if parts > 1 else few
        pairs = df.select(key, vector).join(F.broadcast(part))
        scored = pairs.select(key, "_anchor", F.round(cosine(F.col(vector), F.col("_vector")), 9).alias("_cos"))
        own = scored.groupBy(key).agg(F.min(F.struct((-F.col("_cos")).alias("c"), F.col("_anchor").alias("a"))).alias("_best"))
        best = own if best is None else best.unionByName(own)
    if parts > 1:
        best = best.groupBy(key).agg(F.min("_best").alias("_best"))
    return best.select(key, F.col("_best")["a"].alias("nearest"), (-F.col("_best")["c"]).alias("cosine"))


def pair_statistics(df: DataFrame, vector: str, by: str) -> DataFrame:
    """Pairs, and mean cosine over all pairs of each group, without forming pairs: the sum of unit vectors has all
    pair products in its square."""
    rows = df.select(by, unit(F.col(vector)).alias("_u")).where("_u is not null")
    sums = rows.select(by, F.posexplode("_u").alias("_dim", "_x")).groupBy(by, "_dim").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n"))
    total = sums.groupBy(by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.max("_n").alias("_n"))
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    return total.select(by, pairs.cast("long").alias("n_pairs"), ((F.col("_ss") - F.col("_n")) / 2 / F.nullif(pairs, F.lit(0.0))).alias("mean_cosine"))
