"""Language identification by nearest centroid.

A document is the normalised TF-IDF vector of its byte trigrams (of letters, lower case; hashed). Each language has
several centroids, found by spherical k-means; a document gets the language of the centroid with the largest cosine
and is rejected where even that centroid is too far. Document frequencies cover all learning rows; only the
clustering runs on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._folds import bounded_sample, fold
from ._text import slices, text_bytes

GRAMS = 4096
LONG = 200  # bytes; shorter texts have a bound of their own
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)  # letters and all bytes beyond ASCII stay, other bytes are blank
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts, a row for each document."""
    docs = len(offsets) - 1
    if len(data) == 0:
        return np.zeros((docs, GRAMS), np.float32)
    b = _FOLD[np.concatenate([[0x20], data, [0x20]]).astype(np.uint8)].astype(np.uint32)
    grams = b[:-2] * np.uint32(0x9E3779B1)
    grams ^= b[1:-1] * np.uint32(0x85EBCA77)
    grams ^= b[2:] * np.uint32(0xC2B2AE3D)
    grams *= np.uint32(0x27D4EB2F)
    grams >>= np.uint32(20)
    sizes = np.diff(offsets)
    at = np.repeat(np.arange(docs, dtype=np.int64) * GRAMS, sizes)
    at += grams
    kept = b[1:-1] != 0x20
    # A gram must not reach into the next document.
    firsts, lasts = offsets[:-1][sizes > 0], offsets[1:][sizes > 0] - 1
    kept[firsts] = False
    kept[lasts] = False
    return np.bincount(at[kept], minlength=docs * GRAMS).reshape(docs, GRAMS).astype(np.float32)


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.maximum(norms, 1e-12)[:, None]


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit_rows(np.log1p(counts) * idf)


def clusters(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's direction, each next one the farthest point."""
    centres = [unit_rows(points.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(points)):
        centres.append(points[int(np.argmin((points @ np.array(centres).T).max(axis=1)))])
    centres = np.array(centres)
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T, axis=1)
        moved = [points[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))]
        centres = unit_rows(np.array(moved))
    return centres


def held_out_cosines(points: np.ndarray, sizes: np.ndarray, centroids: int) -> list[np.ndarray]:
    """Cosines of a language's short and long texts, each with centroids of the half of the sample that it is not in."""
    near, odd = np.zeros(len(points)), np.arange(len(points)) % 2 == 1
    if len(points) > 1:
        for half in (odd, ~odd):
            near[half] = (points[half] @ clusters(points[~half], centroids).T).max(axis=1)
    return [near[(sizes >= 24) & (sizes < LONG)], near[sizes >= LONG]]


def bounds(near: list[list[np.ndarray]], share: float, enough: int = 200) -> np.ndarray:
    """The share quantiles by language and length; a language with fewer than enough texts of a length takes all
    languages' texts of it. A quantile of n texts counts n / (n + 20) times, as a small sample shows few lows."""
    out = np.zeros((len(near), 2))
    for band in range(2):
        every = np.concatenate([x[band] for x in near])
        for k, x in enumerate(near):
            own = x[band] if len(x[band]) >= enough else every
            out[k, band] = np.quantile(own, share) * len(own) / (len(own) + 20) if len(own) else 0.0
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row for each centroid
    owner: np.ndarray  # language number of each centroid
    least: np.ndarray  # smallest cosine that is not rejected, a row for each language: of short texts, of long ones

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine of each document's nearest centroid."""
        cosines = vectors(gram_counts(data, offsets), self.idf) @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        return self.owner[best], np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(GRAMS + 1, np.int64), 0
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for i, j in slices(offsets, 1 << 20):
            total[:GRAMS] += (gram_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) > 0).sum(axis=0)
        docs += len(batch)
    total[GRAMS] = docs
    there = np.flatnonzero(total)
    yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(total[there])], ["gram", "docs"])


def fit_languages(docs: DataFrame, per_language: int = 600, sample_rows: int = 4000, centroids: int = 3, reject_share: float = 0.002) -> LanguageModel:
    """Learn from all rows of docs (text, lang; doc_id only to choose the sample) whose lang and text are not null.

    Document frequencies are counted over all of them. The centroids are clustered on a bounded sample of at most
    about per_language rows of each language and sample_rows in all. The rejection bounds, by language and length, are
    the reject_share quantiles of the sample's held-out cosines (see bounds).
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return LanguageModel([UNKNOWN], np.ones(GRAMS, np.float32), np.zeros((1, GRAMS), np.float32), np.zeros(1, np.int64), np.zeros((1, 2)))
    found = known.select("text").mapInArrow(_frequencies, "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toArrow()
    total = np.zeros(GRAMS + 1)
    total[found["gram"].to_numpy()] = found["docs"].to_numpy()
    idf = (np.log((1 + total[GRAMS]) / (1 + total[:GRAMS])) + 1).astype(np.float32)
    languages = sorted(sizes)
    wanted = max(1, min(per_language, sample_rows // len(languages)))
    chosen = bounded_sample(known, "lang", "doc_id", {v: (wanted, n) for v, n in sizes.items()}).toArrow()
    centres, owner, near = [], [], [[np.zeros(0)] * 2 for _ in languages]
    for k, language in enumerate(languages):
        part = chosen.filter(pc.equal(chosen["lang"], language)).sort_by("doc_id").slice(0, 2 * wanted)
        data, offsets = text_bytes(part["text"])
        counts = gram_counts(data, offsets)
        there = counts.sum(axis=1) > 0
        points, sizes_of = vectors(counts, idf)[there], np.diff(offsets)[there]
        if not len(points):
            continue
        own = clusters(points, centroids)
        centres.append(own)
        owner += [k] * len(own)
        near[k] = held_out_cosines(points, sizes_of, centroids)
    if not centres:
        return LanguageModel(languages, idf, np.zeros((1, GRAMS), np.float32), np.zeros(1, np.int64), np.zeros((len(languages), 2)))
    return LanguageModel(languages, idf, np.concatenate(centres).astype(np.float32), np.array(owner), bounds(near, reject_share))


def _judged(column: pa.Array, model: LanguageModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: language numbers (one beyond the last for no letter), scores and rejections."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, 1 << 20):
        for k in range(i, j, 1000):  # rows of a slice may be many and empty
            m = min(j, k + 1000)
            part, own = data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k]
            language, score = model.predict(part, own)
            sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part])])
            letters = np.diff(sums[own]) > 0
            for x in np.flatnonzero(~letters & (np.diff(own) > 0)).tolist():
                letters[x] = any(map(str.isalpha, bytes(part[own[x] : own[x + 1]]).decode("utf-8", "replace")))
            rejected = ~letters | ((score < model.least[language, (np.diff(own) >= LONG).astype(int)]) & (np.diff(own) >= 24))
            yield k, m, np.where(letters, language, len(model.languages)), np.where(letters, score, 0.0), rejected


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, with all columns, that identify_languages does not reject."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = np.concatenate([np.zeros(0, bool), *(r for *_, r in _judged(batch["text"], model))])
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest centroid) and rejected, of each document.

    A null text, and a text without any letter, is `und` with score 0 and is rejected. A text with letters always
    gets a learned language; it is rejected where it has at least 24 bytes and its cosine is below the model's bound
    for that language and length. Ties go to the language that sorts first. Rows are judged one by one; an empty table gives an empty
    result. Other columns are ignored.
    """

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for i, j, language, score, rejected in _judged(batch["text"], model):
                yield pa.record_batch([batch["doc_id"][i:j].cast(pa.int64()), pa.array(names[language], pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def language_query(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those outside fold 2 of 4."""
    held_out = fold("doc_id", 4) == 2
    model = fit_languages(docs.where(~held_out))
    return identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
