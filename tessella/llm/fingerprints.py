"""Document fingerprints from spot signatures.

A signature is an anchor, that is a common word, and the chain of the next CHAIN content words. To cover stretches
without common words (tables, lists), a word with none among the GAP words before it is an anchor too; this rule is
local, so an edit changes signatures only near it. A fingerprint is the sorted set of a document's 32-bit signatures, written in hexadecimal; fingerprints are compared by Jaccard.
Words are lower-cased runs of letters, digits and bytes beyond ASCII.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shuffle_partitions
from ._text import LOWER, find_words, mix
from .jaccard_join import jaccard_components

CHAIN = 2
GAP = 6
BLOCK_CHARS = 1 << 20
#: Common words of English, French, German and Spanish.
COMMON = (
    "a about after all an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so than that the their them there they this to up was we were what when which who will with would you "
    "au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur mais même ne nous on ou où par pas pour plus que qui sa se ses son sont sur un une vous "
    "als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wenn werden wie wir zu zum zur "
    "al como con cuando de del desde el ella en entre era es esta este fue ha hasta la las lo los más me muy ni no nos o para pero por porque que se sin sobre son su sus también un una y ya"
)

_SEPARATE = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _SEPARATE[_low:_high] = False


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(data, offsets, _SEPARATE)
    return words.hashes(LOWER), words.first


_COMMON_HASHES = np.unique(_word_hashes(*_joined([w.encode() for w in COMMON.split()]))[0])
_SIEVE = np.zeros(1 << 16, bool)
_SIEVE[_COMMON_HASHES >> np.uint64(48)] = True


def signature_sets(texts: list[bytes]) -> np.ndarray:
    return signatures(*_joined(texts))


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers (text << 32 | signature) of all texts.

    Chains end with their text; a text without words has no signature.
    """
    h, first = _word_hashes(data, offsets)
    if not len(h):
        return np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    common = _SIEVE[h >> np.uint64(48)]
    at = np.flatnonzero(common)
    near = np.minimum(np.searchsorted(_COMMON_HASHES, h[at]), len(_COMMON_HASHES) - 1)
    common[at] = _COMMON_HASHES[near] == h[at]
    content = ~common
    word = np.arange(len(h))
    last_common = np.maximum.accumulate(np.where(common, word, -1))
    anchor = common | (word - last_common > GAP) | (last_common < first[doc])
    spots = np.flatnonzero(anchor)
    places = np.flatnonzero(content)
    until = np.cumsum(content)  # content words up to and with each word
    last = until[np.maximum(first[1:] - 1, 0)]  # content words up to each text's end
    chained = np.append(h[places], np.zeros(CHAIN, np.uint64))
    signature = h[spots] * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(CHAIN):
        following = until[spots] + k
        inside = following < last[doc[spots]]
        signature = mix(signature + np.where(inside, chained[np.minimum(following, len(chained) - 1)], np.uint64(k + 1)))
    return np.unique(doc[spots].astype(np.uint64) << np.uint64(32) | signature >> np.uint64(32))


def sizes(sets: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((sets >> np.uint64(32)).astype(np.int64), minlength=n)


def hexadecimal(sets: np.ndarray, n: int) -> list[str]:
    raw = (sets & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    ends = np.cumsum(sizes(sets, n)) * 8
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard of the n pairs of sets; two empty sets are alike."""
    common = sizes(np.intersect1d(a, b, assume_unique=True), n)
    union = sizes(a, n) + sizes(b, n) - common
    return np.where(union == 0, 1.0, common / np.maximum(union, 1))


def spot_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Signature set of each text, spread over 64 bits."""
    found, n = signatures(data, offsets), len(offsets) - 1
    spread = mix(found & np.uint64(0xFFFFFFFF))
    return [np.sort(x) for x in np.split(spread, np.cumsum(sizes(found, n))[:-1])] if n else []


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_signatures and class_id (the smallest doc_id reachable by links) of each document.

    Documents link where the Jaccard of their signature sets is percent / 100 or more. Sets are partitioned by length,
    so that linked ones lie in one partition or in neighbours, and meet where they share a signature there; what the
    lengths or the shared signatures cannot raise to the threshold is pruned before sets are compared. Nulls, empty
    texts, repeated rows and empty tables are handled as in jaccard_components.
    """
    found = jaccard_components(docs, percent=percent, sets_of=spot_sets, by_length=True)
    return found.select("doc_id", F.col("n_shingles").alias("n_signatures"), F.col("component_id").alias("class_id"))


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _edits(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    n = len(texts)
    edited = [edited_text(a, b).encode("utf-8", "surrogatepass") for a, b in zip(texts, following, strict=True)]
    encode = lambda xs: [x.encode("utf-8", "surrogatepass") for x in xs]
    if following[:-1] == texts[1:]:  # a run of neighbours: each set serves twice
        both = signature_sets(encode([*texts, following[-1]]))
        own, after = both[both < np.uint64(n) << np.uint64(32)], both[both >= np.uint64(1) << np.uint64(32)] - (np.uint64(1) << np.uint64(32))
    else:
        own, after = signature_sets(encode(texts)), signature_sets(encode(following))
    changed = signature_sets(edited)
    return pa.record_batch(
        [
            pa.array(ids, pa.int64()),
            pa.array(np.fromiter(map(len, texts), np.int64, n)),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
            pa.array(hexadecimal(own, n)),
            pa.array(hexadecimal(changed, n)),
            pa.array(likeness(own, changed, n)),
            pa.array(likeness(own, after, n)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OWN, AFTER, UNPLACED = range(3)


def fingerprint_edits(docs: DataFrame, bucket_rows: int = 500, most_buckets: int = 20_000) -> DataFrame:
    """Fingerprint of each text, of its text edited with the next document's, and their likenesses.

    The next document is the one with the next larger doc_id, for the last the first; rows of equal doc_id are
    ordered by crc32 of their text. A row without doc_id has no place in this order: its next text is empty. A null
    text counts as empty. A table of one row is its own next. Only doc_id and text are read.

    Texts are dealt to ranges of doc_id, compressed, in one shuffle; the first rows of a range are also sent to the
    range before it, so that no range waits for another.
    """
    spark = docs.sparkSession
    count = docs.select("doc_id").count()
    buckets = int(min(most_buckets, max(1, count // bucket_rows)))
    shares = [k / buckets for k in range(buckets)]
    found = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, 20 * buckets).alias("at")).first()
    least = found["least"] if found["least"] is not None else 0
    bounds = np.array(sorted({least, *(found["at"] or [])}), np.int64)  # ids that are there, so no range is empty

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            raw = batch["text"].cast(pa.binary()).to_pylist()
            for doc, text in zip(batch["doc_id"].to_pylist(), raw, strict=True):
                text = text or b""
                tie, packed = zlib.crc32(text), squeeze.compress(text)
                if doc is None:
                    rows = [(-1 - tie % 1024, UNPLACED)]
                else:
                    b = int(np.searchsorted(bounds, doc, "right")) - 1
                    rows = [(b, OWN)] + [((b - 1) % len(bounds), AFTER)] * int(doc == bounds[b])
                for b, part in rows:
                    for column, value in zip(columns, (b, part, doc, tie, packed), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "part", "doc_id", "tie", "packed"])

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "bucket int, part byte, doc_id long, tie long, packed binary")
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "part", "doc_id", "tie")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        ids, texts, held, now = [], [], 0, None
        closed = False
        for batch in batches:
            for bucket, part, doc, packed in zip(*(batch[c].to_pylist() for c in ("bucket", "part", "doc_id", "packed")), strict=True):
                if bucket != now:
                    ids, texts, held, now, closed = [], [], 0, bucket, False
                if closed:
                    continue  # other rows of the next range's first id
                text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                if part == UNPLACED:
                    yield _edits([None], [text], [""])
                    continue
                texts.append(text)
                held += len(text)
                if part == AFTER:
                    closed = True
                else:
                    ids.append(doc)
                if closed or held > BLOCK_CHARS and len(texts) > 1:
                    done = len(texts) - 1
                    yield _edits(ids[:done], texts[:done], texts[1:])
                    ids, texts, held = ids[done:], texts[done:], len(texts[-1])

    return dealt.mapInArrow(read, RESULT)
