"""Whole texts compressed for a shuffle, and read back from it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text of each row; a null text is packed as an empty one."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw = batch["text"].cast(pa.binary()).to_pylist()
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array([squeeze(x or b"") for x in raw], pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, packed binary")


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of compressed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(x) for x in blobs]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def blocks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows whose compressed texts hold about `most` bytes, or a single larger one."""
    blobs = column.to_pylist()
    i, held = 0, 0
    for j, blob in enumerate(blobs):
        if held and held + len(blob) > most:
            yield i, j, blobs[i:j]
            i, held = j, 0
        held += len(blob)
    if i < len(blobs):
        yield i, len(blobs), blobs[i:]
