"""Incremental work: file streams, windows with watermarks, deduplication, sessions, resumable sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; `ts` becomes a timestamp, which watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    sums = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_by_key(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Drops rows whose keys were seen; state goes once the watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; a later call with the same checkpoint goes on from there."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Bounded micro-batches into any sink; `each` must be idempotent by batch number."""
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stop_at_target(stream: DataFrame, by: str, order: str, seconds: str, target: float) -> DataFrame:
    """Rows of each key, as they come (within a batch by `order`), until their seconds reach the target; the row that
    crosses it stays. The state of a key is one sum."""
    kinds = dict(stream.dtypes)

    def keep(key: tuple, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values(order)
        before = spent + rows[seconds].cumsum().shift(fill_value=0.0)
        state.update((float(spent + rows[seconds].sum()),))
        yield rows[before < target]

    columns = ", ".join(f"`{c}` {kinds[c]}" for c in stream.columns)
    return stream.groupBy(by).applyInPandasWithState(keep, columns, "spent double", "append", "NoTimeout")


def not_done(todo: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a row in the append-only log."""
    return todo.join(log.select(*keys).distinct(), keys, "left_anti")


def progress(log: DataFrame, by: str, seconds: str, target: float) -> DataFrame:
    """Done rows and seconds by key, what is left, and whether the target is reached."""
    sums = log.groupBy(by).agg(F.count("*").alias("done"), F.sum(seconds).alias("spent"))
    return sums.withColumns({"left": F.greatest(F.lit(target) - F.col("spent"), F.lit(0.0)), "reached": F.col("spent") >= target})


def until_target(log: DataFrame, by: str, order: str, seconds: str, target: float) -> DataFrame:
    """The rows of each key, in order, up to the one that reaches its target."""
    from ..operators.ordered import budget_prefix, range_bucket

    return budget_prefix(log, [F.col(order)], range_bucket(log, order), F.col(seconds), target, groups=[by])


def stale(log: DataFrame, by: str, now, seconds: float = 600.0) -> DataFrame:
    """Keys whose last row is older than so many seconds."""
    last = log.groupBy(by).agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    return last.withColumn("stale", F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros("last") / 1e6 > seconds)
