"""Edit distances and error rates. Micro rates sum edits over sums of lengths; macro rates average row rates."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def char_edits(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis)


def char_error(reference: Column, hypothesis: Column) -> Column:
    """Edits by reference length; 0 or 1 for an empty reference."""
    return F.when(F.length(reference) > 0, F.levenshtein(reference, hypothesis) / F.length(reference)).otherwise((F.length(hypothesis) > 0).cast("double"))


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t\\r\\n]+", "")


def sequence_edits(a: list, b: list) -> int:
    """Edit distance of two sequences; each row of the table is one vectorised step."""
    _, codes = np.unique(np.array([*a, *b], dtype=object).astype(str), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    at = np.arange(len(y) + 1)
    row = at.copy()
    for k, token in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != token))
        row = np.minimum.accumulate(np.concatenate([[k], best]) - at) + at
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def word_edits(references: pd.Series, hypotheses: pd.Series) -> pd.Series:
    """Word edit distance of blank-separated texts; null with a null."""
    return pd.Series([None if r is None or h is None else sequence_edits(r.split(), h.split()) for r, h in zip(references, hypotheses, strict=True)], dtype="Int32")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("size", T.IntegerType())])))
def matching_blocks(references: pd.Series, hypotheses: pd.Series) -> pd.Series:
    """Longest matching word blocks, in order."""

    def blocks(r: str, h: str) -> list[dict]:
        found = difflib.SequenceMatcher(None, r.split(), h.split(), autojunk=False).get_matching_blocks()
        return [{"a": m.a, "b": m.b, "size": m.size} for m in found if m.size]

    return pd.Series([None if r is None or h is None else blocks(r, h) for r, h in zip(references, hypotheses, strict=True)], dtype=object)
