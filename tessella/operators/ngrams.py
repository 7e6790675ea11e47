"""Contamination and near duplicates by exact n-gram overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_words, word_gram_hashes
from .vectors import small_side


INDEX_ROWS = 500_000  # an index of no more grams is broadcast


def gram_sets(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, grams (64-bit hashes of the distinct n-word runs of the canonical text) and n_grams."""
    return df.select(F.col(key), word_gram_hashes(canonical_words(F.col(text)), n).alias("grams")).withColumn("n_grams", F.size("grams"))


def overlap_by_gram(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Shared grams of each pair of sets with any, by an inverted index; right is the small, indexed side."""
    a = left.select(key, F.col("n_grams").alias("_na"), F.explode_outer("grams").alias("_gram"))  # an inner one would compute
    b = small_side(right.select(other, F.col("n_grams").alias("_nb"), F.explode_outer("grams").alias("_gram")), INDEX_ROWS)  # the grams once more, in a filter
    pairs = a.join(b, "_gram").groupBy(key, other).agg(F.count("*").alias("shared"), F.first("_na").alias("_na"), F.first("_nb").alias("_nb"))
    return pairs.withColumn("jaccard", F.col("shared") / (F.col("_na") + F.col("_nb") - F.col("shared"))).drop("_na", "_nb")


def best_match(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Of each left set the right set with most shared grams; ties go to the smaller key."""
    pairs = overlap_by_gram(left, key, right, other)
    best = pairs.groupBy(key).agg(F.min(F.struct((-F.col("shared")).alias("s"), F.col(other).alias("o"), "jaccard")).alias("_b"))
    return best.select(key, F.col("_b.o").alias(other), (-F.col("_b.s")).alias("shared"), F.col("_b.jaccard").alias("jaccard"))


def similar_pairs(sets: DataFrame, key: str, percent: int) -> DataFrame:
    """key, other (the larger one) and jaccard of all pairs of gram sets that reach percent / 100; empty sets are in none.

    Each set is sought by its rarest grams, as many as any partner must share one of, and by its size; only pairs that
    meet there are compared. All in built-ins, without a group in one task. The caller joins equal texts first.
    """
    rows = sets.where("n_grams > 0").select(F.col(key).alias("_key"), F.col("n_grams").alias("_n"), F.explode("grams").alias("_gram"))
    often = rows.groupBy("_gram").agg(F.count("*").alias("_c")).where("_c > 1")
    shared = rows.join(often, "_gram").groupBy("_key", "_n").agg(F.array_sort(F.collect_list(F.struct("_c", "_gram"))).alias("_shared"))
    least = F.ceil(F.col("_n") * percent / 100)
    first = F.greatest(F.lit(0), (F.col("_n") - least + 1 - (F.col("_n") - F.size("_shared"))).cast("int"))  # grams of its own come before
    places = shared.select("_key", "_n", F.explode(F.slice(F.col("_shared")["_gram"], F.lit(1), first)).alias("_gram"))
    a, b = (places.select("_gram", F.col("_key").alias(f"_{x}"), F.col("_n").alias(f"_n{x}")) for x in "ab")
    near = F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent
    pairs = a.join(b, "_gram").where((F.col("_a") < F.col("_b")) & near).select("_a", "_b").distinct()
    own = lambda x: sets.select(F.col(key).alias(f"_{x}"), F.col("grams").alias(f"_g{x}"))
    common = F.size(F.array_intersect("_ga", "_gb"))
    judged = pairs.join(own("a"), "_a").join(own("b"), "_b").select(F.col("_a").alias(key), F.col("_b").alias("other"), common.alias("_s"), (F.size("_ga") + F.size("_gb") - common).alias("_u"))
    return judged.where(F.col("_s") * 100 >= F.col("_u") * percent).select(key, "other", (F.col("_s") / F.col("_u")).alias("jaccard"))
