"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_GRAIN = 1 << 30


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; 0 for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def bounded_sample(rows: DataFrame, by: str, key: str, most: dict, salt: int = 17) -> DataFrame:
    """About most[v] rows of each value v of column `by`, chosen by a hash of `key`.

    The rows kept do not depend on order or partitioning. most maps each value to (wanted rows, rows there are).
    """
    dealt = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(SAMPLE_GRAIN))
    keep = F.lit(False)
    for value, (wanted, there) in most.items():
        keep = keep | ((F.col(by) == F.lit(value)) & (dealt < int(SAMPLE_GRAIN * min(1.0, wanted / max(1, there)))))
    return rows.where(keep)
