"""Text functions as Column builders. Classes are spelled out, since `\\w` and `\\s` differ between engines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits, zero-width characters, and the fold of typographic signs.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
ZERO_WIDTH = "\u200c\u200d\u00ad\ufeff"
SIGNS, PLAIN_SIGNS = "\u2018\u2019\u201c\u201d\u2013\u2014\u2015\u2026\u00a0", "''\"\"---  "
EVAL_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।॥"
SPACES = "[\\t\\n\\u000B\\f\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
ASCII_SPACES = "[ \\t\\n\\r]+"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null. Spark has no built-in."""
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def without_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def folded_signs(text: Column) -> Column:
    return F.translate(text, SIGNS, PLAIN_SIGNS)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def collapsed(text: Column, spaces: str = SPACES) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, spaces, " "))


def cleaned_lines(text: Column) -> Column:
    """Line breaks, with blanks around them, as one blank; other white space collapsed."""
    return collapsed(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), "[ \\t]*\\n[ \\t]*", " "))


def canonical(text: Column) -> Column:
    """Composed, lower case, everything but letters, numbers, underscore and blanks dropped: for leak checks."""
    return F.trim(F.regexp_replace(F.lower(nfc(text)), "[^\\p{L}\\p{N}_]+", " "))


def canonical_words(text: Column) -> Column:
    return F.filter(F.split(canonical(text), " "), lambda w: w != "")


def eval_normalized(text: Column) -> Column:
    return collapsed(F.lower(F.translate(nfc(text), EVAL_PUNCTUATION, " " * len(EVAL_PUNCTUATION))))


def script_kept(text: Column) -> Column:
    """Devanagari with its signs, letters and digits stay; danda and other punctuation go."""
    return collapsed(F.regexp_replace(F.lower(text), "[^\\u0900-\\u0963\\u0966-\\u097Fa-z0-9 ]", " "))


def nasal_folded(text: Column) -> Column:
    return F.translate(text, "ँ", "ं")


def without_language_tag(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<\\|?[A-Za-z]{2}(-[A-Za-z]{2})?\\|?>", " "))


def without_gloss(text: Column) -> Column:
    """Bracketed Latin glosses dropped."""
    return F.regexp_replace(text, "[(\\[{][A-Za-z0-9 .,'&-]*[)\\]}]", " ")


def symbols_as_words(text: Column, words: dict[str, str]) -> Column:
    for sign, word in words.items():
        text = F.replace(text, F.lit(sign), F.lit(f" {word} "))
    return text


def phrases_replaced(text: Column, readings: dict[str, str]) -> Column:
    """Case-insensitive, longest phrase first."""
    for phrase in sorted(readings, key=len, reverse=True):
        text = F.regexp_replace(text, "(?i)\\Q" + phrase + "\\E", readings[phrase])
    return text


def only(text: Column, kept_class: str) -> Column:
    """Characters outside the class are dropped."""
    return F.regexp_replace(text, f"[^{kept_class}]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(collapsed(text, ASCII_SPACES), " "), lambda w: w != "")


def devanagari_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([\\u0900-\\u097F]+)"), F.lit(1))


def sentences(text: Column) -> Column:
    """Split after sentence-final signs before white space, and at line breaks."""
    marked = F.regexp_replace(F.regexp_replace(text, "([.।?!])[ \\t\\r\\n]+", "$1\n"), "\\n+", "\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def class_count(text: Column, kept_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept_class}]", ""))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def script_share_of_letters(text: Column, script: str, other: str) -> Column:
    """Script / (script + other) over single characters."""
    a, b = class_count(text, script), class_count(text, other)
    return a / F.greatest(a + b, F.lit(1))


def script_share_of_marks(text: Column, script: str) -> Column:
    """Over characters that are neither blank nor punctuation."""
    return _ratio(class_count(text, script), class_count(text, "\\p{L}\\p{M}\\p{N}"))


def script_share_of_alphabetic(text: Column, script: str) -> Column:
    """Over letters proper; combining signs are none."""
    return _ratio(F.length(F.regexp_replace(F.regexp_replace(text, "[^\\p{L}]", ""), f"[^{script}]", "")), class_count(text, "\\p{L}"))


def script_share_of_solid(text: Column, script: str) -> Column:
    """Over the length without blanks."""
    return _ratio(class_count(text, script), F.length(F.replace(text, F.lit(" "), F.lit(""))))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once for each row even where use has it under a lambda."""
    return F.transform(F.array(value), use)[0]


def word_grams(tokens: Column, n: int) -> Column:
    """Distinct n-word runs; none for fewer words."""

    def runs(t: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - F.lit(n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")))

    return bound(tokens, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(F.array().cast("array<string>")))


def word_gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the distinct n-word runs; none for fewer words."""

    def runs(t: Column) -> Column:
        hashed = F.transform(t, lambda w: F.xxhash64(w))  # each word once
        return bound(hashed, lambda h: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(n)), lambda i: F.xxhash64(*(h[i + k] for k in range(n))))))

    return bound(tokens, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(F.array().cast("array<bigint>")))


def jaccard(a: Column, b: Column) -> Column:
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def hash_prefix(value: Column, digits: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, digits)


def hash_seed(value: Column) -> Column:
    """The first eight hexadecimal digits of md5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def safe_name(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def number_suffix(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, "([0-9]+)$", 1), F.lit("")).cast("int")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def speaker_key(path: Column, speaker: Column) -> Column:
    """A bare SPEAKER_nn label counts only within its directory."""
    return F.when(speaker.rlike("^SPEAKER_[0-9]+$"), F.concat_ws("/", file_name(directory(path)), speaker)).otherwise(speaker)
