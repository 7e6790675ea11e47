"""Average-linkage clustering of each group's vectors, cut at a cosine threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 4000


def linkage_labels(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Merges the two clusters of the largest mean cosine while it reaches the threshold; labels by first member."""
    n = len(vectors)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    v = vectors / np.where(norms == 0, 1, norms)
    sim = v @ v.T
    np.fill_diagonal(sim, -np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    while alive.sum() > 1:
        i, j = divmod(int(np.argmax(sim)), n)
        if sim[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (sim[i] * size[i] + sim[j] * size[j]) / (size[i] + size[j])
        sim[i], sim[:, i] = merged, merged
        sim[i, i] = -np.inf
        sim[j], sim[:, j] = -np.inf, -np.inf
        sim[i, ~alive] = sim[~alive, i] = -np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return label


def chain_labels(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """linkage_labels, but for ties, in memory that grows with the rows: the mean cosine of two clusters is the product
    of their sums of unit vectors over their sizes. Identical vectors are joined first. A chain of nearest neighbours
    finds the same merges, as a merge brings no third cluster nearer; those below the threshold are left out."""
    n = len(vectors)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    v = vectors / np.where(norms == 0, 1, norms)
    label = np.arange(n)
    if threshold < 1 - 1e-9:
        _, first, same = np.unique(v, axis=0, return_index=True, return_inverse=True)
        label = np.where(norms[:, 0] == 0, label, first[same.ravel()])
    heads, at, size = np.unique(label, return_inverse=True, return_counts=True)
    sums, size, owner = v[heads] * size[:, None], size.astype(float), np.arange(len(heads))
    alive, chain, start = np.ones(len(heads), bool), [], 0
    while True:
        if not chain:
            while start < len(heads) and not alive[start]:
                start += 1
            if start == len(heads):
                break
            chain.append(start)
        top = chain[-1]
        sim = np.where(alive, sums @ sums[top] / (size * size[top]), -np.inf)
        sim[top] = -np.inf
        best = int(np.argmax(sim))
        if len(chain) > 1 and sim[chain[-2]] >= sim[best] - 1e-12:
            best = chain[-2]
        if sim[best] < threshold:  # the nearest is too far, and no later merge is nearer
            alive[top] = False
            chain.pop()
        elif len(chain) > 1 and best == chain[-2]:
            i, j = min(top, best), max(top, best)
            sums[i] += sums[j]
            size[i] += size[j]
            alive[j] = False
            owner[owner == j] = i
            del chain[-2:]
        else:
            chain.append(best)
    return heads[owner[at.ravel()]]


def average_linkage(df: DataFrame, key: str, vector: str, by: str, threshold: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """key, group and cluster (smallest key in it). A group is clustered as a whole, in one task and in quadratic time;
    above group_rows rows without the matrix of all pairs."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable").reset_index(drop=True)
        labels = linkage_labels if len(part) <= group_rows else chain_labels
        label = labels(np.stack(part[vector].to_numpy()).astype(float), threshold)
        return pd.DataFrame({key: part[key], by: part[by], "cluster": part[key].to_numpy()[label]})

    kinds = dict(df.dtypes)
    return df.select(key, vector, by).where(F.col(by).isNotNull()).groupBy(by).applyInPandas(run, f"{key} {kinds[key]}, {by} {kinds[by]}, cluster {kinds[key]}")
