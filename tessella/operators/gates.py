"""Quality gates as boolean columns. What a missing metric means is part of each gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def language_in(lang: Column, *names: str) -> Column:
    return F.lower(F.trim(lang)).isin(*names)


def in_range(value: Column, low: float | None = None, high: float | None = None, open_low: bool = False) -> Column:
    """Closed range; a bound that is None or not above 0 does not count."""
    ok = F.lit(True)
    if low is not None and low > 0:
        ok = ok & ((value > low) if open_low else (value >= low))
    if high is not None and high > 0:
        ok = ok & (value <= high)
    return ok


def has_text(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def at_least(value: Column, threshold: float, missing: bool = True) -> Column:
    return F.coalesce(value >= threshold, F.lit(missing))


def at_most(value: Column, threshold: float, missing: bool = True) -> Column:
    return F.coalesce(value <= threshold, F.lit(missing))


def worst_metric(metrics: Column, prefix: str) -> Column:
    """Largest value among the map's keys with the prefix; null without any."""
    return F.array_max(F.map_values(F.map_filter(metrics, lambda k, v: k.startswith(prefix))))


def error_gate(metrics: Column, overlap: Column, prefix: str = "cer_", most: float = 0.10, most_overlap: float = 5.0) -> Column:
    return at_most(worst_metric(metrics, prefix), most) & at_most(overlap, most_overlap)


def consensus(available: Column, agreeing: Column, least: int = 2) -> Column:
    return F.when(available >= least, F.coalesce(agreeing >= least, F.lit(False))).otherwise(True)


def lexicon_share(tokens: Column, lexicon: Column) -> Column:
    """Share of tokens in the lexicon array; 1 without tokens."""
    known = F.size(F.filter(tokens, lambda w: F.array_contains(lexicon, w)))
    return F.when(F.size(tokens) > 0, known / F.size(tokens)).otherwise(F.lit(1.0))


def readable(text: Column, least: int, most: int, joiner: str = "्", lone: str = "।") -> Column:
    """Word count in range, no one-character word but `lone`, no word that ends in the joiner."""
    tokens = words(text)
    odd = F.exists(tokens, lambda w: ((F.length(w) == 1) & (w != lone)) | w.endswith(joiner))
    return F.size(tokens).between(least, most) & ~odd


def long_enough(text: Column, more_words: int = 4, more_chars: int = 50) -> Column:
    return (F.size(words(text)) > more_words) | (F.length(text) > more_chars)


def alignable(duration: Column, tokens: Column, frames_per_second: float = 12.5, least: float = 1.3) -> Column:
    return duration * frames_per_second / F.greatest(tokens, F.lit(1)) >= least


def all_timed(items: Column) -> Column:
    """Every word of an array of (word, start, end) has both times, and there is one."""
    return (F.size(items) > 0) & F.forall(items, lambda w: w["start"].isNotNull() & w["end"].isNotNull())


def joined_reasons(*checks: tuple[Column, str]) -> Column:
    """`; `-joined names of the checks that fail; empty if none does."""
    return F.concat_ws("; ", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks))


def first_reason(*checks: tuple[Column, str], otherwise: str = "") -> Column:
    out = F.lit(otherwise)
    for failed, name in reversed(checks):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out


def square_codes(codes: Column, books: int = 16) -> Column:
    """Time by codebook matrix; one given codebook by time is turned; anything else is null."""
    by_time = F.forall(codes, lambda r: F.size(r) == books)
    even = F.forall(codes, lambda r: F.size(r) == F.size(codes[0]))
    turned = F.transform(F.sequence(F.lit(0), F.size(codes[0]) - 1), lambda i: F.transform(codes, lambda r: F.get(r, i)))
    return F.when((F.size(codes) > 0) & by_time, codes).when((F.size(codes) == books) & even & (F.size(codes[0]) > 0), turned)


def funnel(df: DataFrame, gates: dict[str, Column], by: str, seconds: Column) -> DataFrame:
    """Rows and hours that pass each gate after all earlier ones, by group, in one pass."""
    passed, sums = F.lit(True), [F.count("*").alias("n_in"), F.round(F.sum(seconds) / 3600, 6).alias("hours_in")]
    for name, gate in gates.items():
        passed = passed & F.coalesce(gate, F.lit(False))
        sums += [F.count_if(passed).alias(f"n_{name}"), F.round(F.sum(F.when(passed, seconds).otherwise(0.0)) / 3600, 6).alias(f"hours_{name}")]
    return df.groupBy(by).agg(*sums)


def label_fits(ids: Column, most: int = 448) -> Column:
    """Label ids of no more than `most`; a null fails."""
    return F.coalesce(F.size(ids) <= most, F.lit(False)) & ids.isNotNull()


def truncated(ids: Column, most: int = 448) -> Column:
    return F.slice(ids, 1, most)


def mask_restored(ids: Column, pad: int, mask: int = -100) -> Column:
    """Masked places hold the pad id again."""
    return F.transform(ids, lambda x: F.when(x == mask, F.lit(pad)).otherwise(x))


def collated(df: DataFrame, batch: str, ids: str, pad: int) -> DataFrame:
    """ids padded to the longest of the batch, and mask (1 for ids, 0 for pads). A null row is all pads."""
    longest = df.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.greatest(F.size(ids), F.lit(0))).alias("_longest"))
    own = F.coalesce(F.col(ids), F.array().cast(dict(df.dtypes)[ids]))
    rest = F.col("_longest") - F.size(own)
    padded = df.join(longest, F.col(batch).eqNullSafe(F.col("_batch"))).withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(own)), F.array_repeat(F.lit(0), rest)))
    return padded.withColumn(ids, F.concat(own, F.array_repeat(F.lit(pad), rest))).drop("_batch", "_longest")
