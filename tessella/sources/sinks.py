"""Sinks: JSON lines, Parquet shards by row count or bytes, buckets, delimited text, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import range_bucket, with_running


def jsonl(df: DataFrame, path: str, buckets: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*buckets) if buckets else writer).json(path)


def parquet(df: DataFrame, path: str, compression: str = "zstd", most_rows: int = 0) -> None:
    df.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", most_rows).parquet(path)


def shard_by_bytes(df: DataFrame, size: Column, order: str, budget: int, by: str) -> DataFrame:
    """Adds `shard`: a new one of each source starts once the bytes before reach a multiple of the budget."""
    run = with_running(df, [F.col(order)], range_bucket(df, order), size, "_rn", "_before", [by])
    return run.withColumn("shard", F.floor(F.col("_before") / budget).cast("long")).drop("_rn", "_before")


def shard_by_rows(df: DataFrame, order: str, rows: int) -> DataFrame:
    run = with_running(df, [F.col(order)], range_bucket(df, order), None, "_rn", "_before")
    return run.withColumn("shard", F.floor((F.col("_rn") - 1) / rows).cast("long")).drop("_rn", "_before")


def sharded_parquet(df: DataFrame, path: str, shard: str = "shard", by: str | None = None) -> None:
    """One folder for each shard; rows of a shard meet in one task, so each folder has one file."""
    keys = [by, shard] if by else [shard]
    df.repartition(*keys).write.mode("overwrite").option("compression", "zstd").partitionBy(*keys).parquet(path)


def tsv(df: DataFrame, path: str) -> None:
    """Tabs and line breaks in strings become blanks."""
    clean = [F.translate(c, "\t\n\r", "   ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def csv_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def report(df: DataFrame, most: int = 10_000) -> str:
    """A small aggregate as a JSON array; an error if it is not small."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=1)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a Markdown table; an error if it is not small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows")
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
