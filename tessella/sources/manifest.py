"""Manifest sources: JSON lines, parsed leniently or strictly, several sources with tags, lexicons, logs, listings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])

#: The canonical utterance: training fields, alignment, and quality metadata, all nullable.
UTTERANCE = T.StructType(
    [
        T.StructField("audio_filepath", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("label_kind", T.StringType()),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("style", T.StringType()),
        T.StructField("words", T.ArrayType(WORD)),
        T.StructField("cer_wer_metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("spk_overlap_percent", T.DoubleType()),
        T.StructField("low_cer_count", T.DoubleType()),
        T.StructField("available_cer_count", T.DoubleType()),
        T.StructField("dnsmos_mean", T.DoubleType()),
        T.StructField("language_seconds", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Text lines with their file and, in it, a stable order."""
    return spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def parsed(rows: DataFrame, schema: T.StructType = UTTERANCE, pattern: str | None = None, value: str = "value") -> DataFrame:
    """Lines that are JSON objects, as columns; others are skipped. A pattern rules lines out before the parse."""
    kept = rows.where(F.col(value).rlike(pattern)) if pattern else rows
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    row = F.from_json(value, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    others = [c for c in rows.columns if c != value]
    return kept.select(*others, row.alias("_row")).where("_row is not null and _row._bad is null").select(*others, *(F.col("_row")[f.name].alias(f.name) for f in schema.fields))


def bad_lines(rows: DataFrame, schema: T.StructType = UTTERANCE, value: str = "value") -> DataFrame:
    """Count of lines and of those that do not parse."""
    good = parsed(rows.select(value), schema, value=value).agg(F.count("*").alias("good"))
    return rows.agg(F.count("*").alias("lines")).crossJoin(good).select("lines", (F.col("lines") - F.col("good")).alias("bad"))


def strict_lines(spark: SparkSession, path: str, schema: T.StructType = UTTERANCE) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def tagged_sources(sources: Iterable[tuple[str, DataFrame, Callable[[DataFrame], Column] | None]]) -> DataFrame:
    """Sources in order, each with its tag, its place and its own gate."""
    out = None
    for place, (tag, df, gate) in enumerate(sources):
        df = df if gate is None else df.where(gate(df))
        df = df.withColumns({"source": F.lit(tag), "source_order": F.lit(place)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that are there, by the file system each belongs to; missing ones are left out."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            found.append(path)
    return found


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str | None:
    return next(iter(existing(spark, paths)), None)


def listing(spark: SparkSession, root: str, glob: str = "*", without: tuple[str, ...] = ("rejection", "backup", ".trash")) -> DataFrame:
    """Files below root, but those with an excluded word in their path; the label is the parent folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    for word in without:
        files = files.where(~F.contains("path", F.lit(word)))
    return files.withColumn("label", F.regexp_extract("path", "([^/]+)/[^/]*$", 1))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """First tab-separated column of each line, without comments and blank lines."""
    word = F.trim(F.split("value", "\t")[0])
    return spark.read.text(path).where(~F.ltrim("value").startswith("#")).select(word.alias("word")).where("word <> ''").distinct()


def transcripts(rows: DataFrame, value: str = "value") -> DataFrame:
    """`id text` lines, split at the first white space."""
    parts = F.split(F.trim(value), "\\s+", 2)
    return rows.where(F.trim(value) != "").select(parts[0].alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def training_log(rows: DataFrame, value: str = "value") -> DataFrame:
    """set, step, metric and reading of `valid[set] @ step N: {'metric': '0.1'}` lines; the set may be missing."""
    pairs = F.regexp_extract_all(value, F.lit("'([A-Za-z_]+)': '?(-?[0-9.]+(?:e-?[0-9]+)?)'?"), F.lit(0))
    marked = rows.select(F.nullif(F.regexp_extract(value, "valid\\[([a-z]+)\\]", 1), F.lit("")).alias("set"), F.try_to_number(F.regexp_extract(value, "step ([0-9]+)", 1), F.lit("999999999")).cast("long").alias("step"), F.explode(pairs).alias("_pair"))
    return marked.where("step is not null").select("set", "step", F.regexp_extract("_pair", "'([A-Za-z_]+)'", 1).alias("metric"), F.regexp_extract("_pair", ": '?([^']+)'?$", 1).cast("double").alias("reading"))


def detected(df: DataFrame, *names: str) -> str | None:
    """The first of several possible columns that is there."""
    return next((n for n in names if n in df.columns), None)


def coalesced(df: DataFrame, *names: str, empty_is_missing: bool = True) -> Column:
    """First value over alias columns; with empty_is_missing, '' and 0 count as missing."""
    there = [F.col(n) for n in names if n in df.columns]
    kinds = dict(df.dtypes)
    if empty_is_missing:
        there = [F.nullif(c, F.lit("") if kinds[n] == "string" else F.lit(0).cast(kinds[n])) for c, n in zip(there, [n for n in names if n in df.columns], strict=True)]
    return F.coalesce(*there) if there else F.lit(None)
