"""Sub-word pieces and unknown pieces of texts, by a sentencepiece model file that every executor has."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField("pieces", T.LongType()), T.StructField("unknown", T.LongType())])


@cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_ids(text: Column, path: str) -> Column:
    """Ids of the pieces; null for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        found = iter(_processor(path).encode([t for t in texts if t is not None], num_threads=1))
        return pd.Series([None if t is None else next(found) for t in texts], dtype=object)

    return run(text)


def piece_counts(text: Column, path: str) -> Column:
    """Struct of pieces and unknown ones; a null text has none."""

    @F.pandas_udf(COUNTS)
    def run(texts: pd.Series) -> pd.DataFrame:
        model = _processor(path)
        ids = model.encode([t or "" for t in texts], num_threads=1)
        return pd.DataFrame({"pieces": [len(x) for x in ids], "unknown": [x.count(model.unk_id()) for x in ids]})

    return run(text)


def representable(chars: Column, path: str) -> Column:
    """Whether a character has pieces of its own: no unknown piece and no byte piece."""

    @F.pandas_udf(T.BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        model = _processor(path)
        known = {c: not any(model.is_unknown(i) or model.is_byte(i) for i in model.encode(c)) for c in set(texts.dropna())}
        return texts.map(known)

    return run(chars)
