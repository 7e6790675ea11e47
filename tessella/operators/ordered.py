"""Row numbers and running sums in one global order, without a one-partition window.

The order is cut into buckets by a column that never decreases along it. Bucket totals (a bounded table) give each
bucket's offset, and only rows within a bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3  # 4,096 buckets


def hash_bucket(key: Column) -> Column:
    """Bucket of an order by a hexadecimal hash."""
    return F.conv(F.substring(key, 1, HASH_DIGITS), 16, 10).cast("int")


def range_bucket(df: DataFrame, column: str, buckets: int = 256) -> Column:
    """Bucket of an order by a number, by approximate quantiles."""
    shares = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(df.agg(F.percentile_approx(column, shares, 20 * buckets)).first()[0] or []))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column))) if bounds else F.lit(0)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names behind a prefix that no column of df has, so that columns of the caller are never overwritten."""
    k = 0
    while any(c.lower().startswith(f"_{k}_") for c in df.columns):
        k += 1
    return [f"_{k}_{n}" for n in names]


def with_running(df: DataFrame, order: list[Column], bucket: Column, value: Column | None = None, number: str = "rn", before: str = "before", groups: list[str] | None = None) -> DataFrame:
    """Adds the row number from 1 and the sum of value over all earlier rows, in the order, within each group."""
    groups = groups or []
    in_bucket, amount, count, total, at, row0, sum0, *own = spare(df, "bucket", "value", "rows", "sum", "at", "row0", "sum0", *(f"g{k}" for k in range(len(groups))))
    rows = df.withColumn(in_bucket, bucket).withColumn(amount, F.lit(0) if value is None else value)
    totals = rows.groupBy(*groups, in_bucket).agg(F.count("*").alias(count), F.sum(amount).alias(total))
    earlier = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, in_bucket, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(row0), F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(sum0))
    offsets = offsets.select(*(F.col(g).alias(o) for g, o in zip(groups, own, strict=True)), F.col(in_bucket).alias(at), row0, sum0)
    match = F.col(in_bucket) == F.col(at)
    for g, o in zip(groups, own, strict=True):
        match = match & F.col(g).eqNullSafe(F.col(o))
    local = Window.partitionBy(*groups, in_bucket).orderBy(*order)
    done = local.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, match).withColumn(number, (F.col(row0) + F.row_number().over(local)).cast("long"))
    out = out.withColumn(before, F.col(sum0) + F.coalesce(F.sum(amount).over(done), F.lit(0)))
    return out.drop(in_bucket, amount, at, row0, sum0, *own)


def budget_prefix(df: DataFrame, order: list[Column], bucket: Column, value: Column, budget: Column | float, groups: list[str] | None = None) -> DataFrame:
    """Rows in order until their sum reaches the budget; the row that crosses it stays."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    number, before = spare(df, "rn", "before")
    return with_running(df, order, bucket, value, number, before, groups).where(F.col(before) < limit).drop(number, before)
