"""Joins by role: routing, fallback, positional, looked-up rows, and enrichment from small tables of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import range_bucket, with_running
from .vectors import small_side


def routed(todo: DataFrame, done: DataFrame, keys: list[str], same: str) -> DataFrame:
    """todo with `route`: seed where done has the key and the same value, changed where it differs, new otherwise."""
    known = done.select(*keys, F.col(same).alias("_known"), F.lit(True).alias("_there"))
    route = F.when(F.col("_there").isNull(), "new").when(F.col(same).eqNullSafe(F.col("_known")), "seed").otherwise("changed")
    return todo.join(known, keys, "left").withColumn("route", route).drop("_known", "_there")


def first_match(df: DataFrame, key: str, *candidates: tuple[str, DataFrame], value: str) -> DataFrame:
    """Value and name of the first candidate table that has the key."""
    values, names = [], []
    for k, (name, table) in enumerate(candidates):
        df = df.join(table.select(key, F.col(value).alias(f"_v{k}")), key, "left")
        values.append(F.col(f"_v{k}"))
        names.append(F.when(F.col(f"_v{k}").isNotNull(), name))
    return df.withColumns({value: F.coalesce(*values), "found_in": F.coalesce(*names)}).drop(*(f"_v{k}" for k in range(len(candidates))))


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two tables by position; an error if they differ in length."""
    a = with_running(left, [F.col(left_order)], range_bucket(left, left_order), number="_position", before="_b").drop("_b")
    b = with_running(right, [F.col(right_order)], range_bucket(right, right_order), number="_position", before="_b").drop("_b")
    joined = a.withColumn("_left", F.lit(True)).join(b.withColumn("_right", F.lit(True)), "_position", "full_outer")
    paired = F.when(F.col("_left").isNull() | F.col("_right").isNull(), F.raise_error(F.lit("tables of different length"))).otherwise(F.col("_position"))
    return joined.withColumn("_position", paired).where("_position is not null").drop("_left", "_right", "_position")


def own_or_any(df: DataFrame, own: DataFrame, key: str, anyone: DataFrame, group: str, value: str) -> DataFrame:
    """Value of the row's own key, else the one of its group; `is_own` tells which."""
    joined = df.join(own.select(key, F.col(value).alias("_own")), key, "left").join(small_side(anyone.select(group, F.col(value).alias("_any"))), group, "left")
    return joined.withColumns({value: F.coalesce("_own", "_any"), "is_own": F.col("_own").isNotNull()}).drop("_own", "_any")


def every_combination(*sides: DataFrame) -> DataFrame:
    """Grid of several lists, each of checked size."""
    out = sides[0]
    for side in sides[1:]:
        out = out.join(small_side(side))
    return out


def looked_up(wanted: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by their place (file, row number): an equi-join, with the wanted places sent out where they are few."""
    return rows.join(small_side(wanted.select(*keys).distinct()), keys)


def prefix_replaced(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def prefix_replaced_strictly(text: Column, old: str, new: str) -> Column:
    """An error for a text without the prefix."""
    return F.when(text.startswith(old), prefix_replaced(text, old, new)).otherwise(F.raise_error(F.concat(F.lit("without prefix: "), text)))
