"""Quality classifier: Naive Bayes support vectors.

Features are indicators of byte trigrams and of word-shape n-grams (a word's form, and which of the preceding
words it repeats), hashed to FEATURES places. Each indicator is scaled by the log-count ratio of the classes, which
is counted over a bounded sample of labelled rows; a linear hinge-loss model is then fitted on the scaled
indicators by dual coordinate descent, and its margin is mapped to a probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._folds import bounded_sample, fold
from ._text import find_words, slices, text_bytes

GRAM_BITS, SHAPE_BITS = 14, 12
FEATURES = (1 << GRAM_BITS) + (1 << SHAPE_BITS)
_STEP = 1 << 19

_KIND = np.full(256, 4, np.uint8)  # blank, digit, lower, upper, sign, beyond ASCII
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x30:0x3A], _KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x80:] = 1, 2, 3, 5


def indicators(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which features each document has: a boolean row for each."""
    docs = len(offsets) - 1
    has = np.zeros((docs, FEATURES), bool)
    if len(data) < 1:
        return has
    flat, n = has.reshape(-1), len(data)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(docs, dtype=np.int64) * FEATURES, sizes)
    if n >= 3:
        b = data.astype(np.uint32)
        gram = b[:-2] * np.uint32(0x9E3779B1)
        gram ^= b[1:-1] * np.uint32(0x85EBCA77)
        gram ^= b[2:] * np.uint32(0xC2B2AE3D)
        gram *= np.uint32(0x27D4EB2F)
        gram >>= np.uint32(32 - GRAM_BITS)
        inside = np.ones(n - 2, bool)
        for back in (1, 2):
            at = offsets[1:-1] - back
            inside[at[(at >= 0) & (at < n - 2)]] = False
        flat[(row[: n - 2] + gram)[inside]] = True
    words = find_words(data, offsets)
    if len(words.start):
        h, doc = words.hashes(), words.doc()
        length = np.minimum(words.end - words.start, 31)
        first, last = _KIND[data[words.start]], _KIND[data[words.end - 1]]
        shape = (first.astype(np.uint32) * 6 + last) * 6 + _KIND[data[(words.start + words.end) // 2]]
        shape = shape * np.uint32(6) + np.searchsorted([2, 4, 8, 12, 20], length).astype(np.uint32)
        repeats = np.zeros(len(h), np.uint32)
        for back in range(1, 5):
            same = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
            repeats[back:] |= same.astype(np.uint32) << np.uint32(back - 1)
        before = np.concatenate([[0], repeats[:-1]]).astype(np.uint32)
        at = doc * FEATURES + (1 << GRAM_BITS)
        for salt, part in ((1, shape), (2, repeats * np.uint32(16) + before)):
            flat[at + ((part * np.uint32(0x9E3779B1) + np.uint32(salt * 0x632BE5AB)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - SHAPE_BITS))] = True
        pair = shape[1:] * np.uint32(1297) + shape[:-1]
        flat[(at[1:] + ((pair * np.uint32(0x85EBCA77) + np.uint32(3)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - SHAPE_BITS)))[doc[1:] == doc[:-1]]] = True
    return has


def each_slice(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = text_bytes(batch["text"])
    for i, j in slices(offsets, _STEP):
        for k in range(i, j, 1000):  # rows of a slice may be many and empty
            m = min(j, k + 1000)
            yield k, m, indicators(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, cost: np.ndarray, rounds: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear model of the hinge loss over rows of feature numbers, each with value scale[feature], and a bias."""
    w, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] for r in rows]
    diagonal = [float(v @ v) + 1.0 for v in values]
    alpha = np.zeros(len(rows))
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        for i in order.permutation(len(rows)).tolist():
            y = sign[i]
            gradient = y * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            if (change := (new - alpha[i]) * y) != 0:
                alpha[i] = new
                w[rows[i]] += change * values[i]
                bias += change
    return w * scale, bias


def sigmoid_fit(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton steps, with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - target)
        q = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, has: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(has)
        margin = np.bincount(at // FEATURES, self.weights[at % FEATURES], minlength=len(has)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _class_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        label = batch["label"].to_numpy()
        for i, j, has in each_slice(batch):
            for c in (0, 1):
                counts[c] += has[label[i:j] == c].sum(axis=0)
    there = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(counts[0, there]), pa.array(counts[1, there])], ["feature", "n0", "n1"])


def _feature_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, has in each_slice(batch):
            at = np.flatnonzero(has)
            bounds = np.searchsorted(at, np.arange(j - i + 1) * FEATURES).astype(np.int32)
            yield pa.record_batch([batch["doc_id"][i:j], batch["label"][i:j], pa.ListArray.from_arrays(bounds, pa.array((at % FEATURES).astype(np.int32)))], ["doc_id", "label", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 24_000, fit_per_class: int = 3000, rounds: int = 12, cost: float = 0.05, smoothing: float = 1.0) -> QualityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, label 0 or 1; other labels and nulls are ignored).

    Learning is bounded: log-count ratios cover at most about per_class labelled rows of each class, and the
    hinge-loss model at most about fit_per_class of these, both chosen by a hash of doc_id. Only the sample's ids and
    labels are broadcast. Probabilities are weighted back to the classes' shares over all labels; of a document
    with several labels the smallest counts. Without rows of both classes every score is the share of class 1, or
    0.5 without any.
    """
    known = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        share = {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(sizes)]
        return QualityModel(np.zeros(FEATURES), 0.0, 1.0, 60.0 * (share - 0.5))

    def labelled(most: int) -> DataFrame:
        chosen = bounded_sample(known, "label", "doc_id", {c: (most, n) for c, n in sizes.items()})
        return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    found = labelled(per_class).mapInArrow(_class_counts, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most FEATURES rows
    held = [min(per_class, sizes[c]) for c in (0, 1)]
    counts = np.full((2, FEATURES), smoothing)
    for c in (0, 1):
        counts[c, found["feature"].to_numpy()] += found[f"n{c}"].to_numpy()
    ratio = np.log(counts[1] / (held[1] + 2 * smoothing)) - np.log(counts[0] / (held[0] + 2 * smoothing))
    chosen = labelled(fit_per_class).mapInArrow(_feature_lists, "doc_id long, label int, features array<int>").toArrow().sort_by([("doc_id", "ascending")])
    good = chosen["label"].to_numpy() == 1
    keep = np.sort(np.concatenate([np.flatnonzero(good)[: 2 * fit_per_class], np.flatnonzero(~good)[: 2 * fit_per_class]]))
    good = good[keep]
    if good.all() or not good.any():
        return QualityModel(np.zeros(FEATURES), 0.0, 1.0, float(np.log(sizes[1] / sizes[0])))
    lists = chosen["features"].combine_chunks()
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    features = [flat[bounds[k] : bounds[k + 1]].astype(np.int64) for k in keep.tolist()]
    weight = np.where(good, sizes[1] / good.sum(), sizes[0] / (~good).sum())
    even = np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))
    scale = ratio / np.sqrt(np.mean([np.square(ratio[f]).sum() for f in features]) + 1e-9)
    weights, bias = dual_coordinate_descent(features, scale, np.where(good, 1.0, -1.0), 20 * cost * even, rounds)
    margin = np.array([weights[f].sum() + bias for f in features])
    slope, shift = sigmoid_fit(margin, good, weight / weight.mean())
    return QualityModel(weights, bias, slope, shift)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted (1 from 0.5 on) of each document.

    A null text counts as empty; an empty text has no features and gets the model's score for none. Rows are
    scored one by one, so equal texts get equal scores; an empty table gives an empty result. Other columns are
    ignored.
    """

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, has in each_slice(batch):
                score = model.scores(has)
                yield pa.record_batch([batch["doc_id"][i:j].cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double, predicted int")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from the labels outside fold 1 of 3."""
    held_out = fold("doc_id", 3) == 1
    model = fit_quality(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
