"""Clustering of embeddings, one recording at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Recordings with fewer rows aren't clustered: all get label 1. With more than MOST their affinities would outgrow a task.
FEWEST, MOST = 10, 10_000


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return unit(a) @ unit(b).T


def prune(affinity: np.ndarray, share: float, least: int) -> np.ndarray:
    """Sets the smallest entries of each row to 0, keeping at least ``least``."""
    drop = min(int((1 - share) * len(affinity)), len(affinity) - least)
    out = affinity.copy()
    if drop > 0:
        np.put_along_axis(out, np.argsort(affinity, axis=1, kind="stable")[:, :drop], 0, axis=1)
    return out


def k_means(rows: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Labels by Lloyd's rounds from farthest-first centres, so without chance."""
    centres = [int(np.argmax(((rows - rows.mean(0)) ** 2).sum(1)))]
    while len(centres) < k:
        distance = ((rows[:, None] - rows[centres][None]) ** 2).sum(2).min(1)
        centres.append(int(distance.argmax()))
    middle, labels = rows[centres], np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        labels = ((rows[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        moved = np.stack([rows[labels == c].mean(0) if (labels == c).any() else middle[c] for c in range(k)])
        if np.allclose(moved, middle):
            break
        middle = moved
    return labels


def spectral(rows: np.ndarray, fewest: int = 1, most: int = 15, share: float = 0.02, least: int = 6, count: int | None = None) -> np.ndarray:
    affinity = prune(cosines(rows, rows), share, least)
    affinity = (affinity + affinity.T) / 2
    np.fill_diagonal(affinity, 0)
    values, vectors = np.linalg.eigh(np.diag(np.abs(affinity).sum(1)) - affinity)
    k = count or int(np.argmax(np.diff(values[fewest - 1 : most + 1]))) + fewest
    return k_means(vectors[:, :k], k)


def average_link(rows: np.ndarray, cut: float = 0.2) -> np.ndarray:
    """Joins the two groups of highest mean cosine while it is at least ``cut``."""
    similar = cosines(rows, rows)
    np.fill_diagonal(similar, -np.inf)
    size, label, alive = np.ones(len(rows)), np.arange(len(rows)), np.ones(len(rows), bool)
    while alive.sum() > 1:
        i, j = sorted(np.unravel_index(int(similar.argmax()), similar.shape))
        if similar[i, j] < cut:
            break
        mean = (similar[i] * size[i] + similar[j] * size[j]) / (size[i] + size[j])
        similar[i], similar[:, i] = mean, mean
        similar[i, i] = similar[j] = similar[:, j] = -np.inf
        size[i] += size[j]
        alive[j], label[label == j] = False, i
    return np.unique(label, return_inverse=True)[1]


def _sums(index: np.ndarray, count: int, rows: np.ndarray) -> np.ndarray:
    """The sum of each cluster's rows; its cosines are those of the mean."""
    total = np.zeros((count, rows.shape[1]))
    np.add.at(total, index, rows)
    return total


def absorb_small(labels: np.ndarray, rows: np.ndarray, least: int = 4) -> np.ndarray:
    """Rows of clusters under ``least`` rows go to the most similar of the others; if there is no other, all rows get 0."""
    names, index, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    stays = sizes >= least
    if not stays.any():
        return np.zeros_like(labels)
    similar = np.where(stays, cosines(rows, _sums(index, len(names), rows)), -np.inf)
    return names[np.where(stays[index], index, similar.argmax(axis=1))]


def merge_similar(labels: np.ndarray, rows: np.ndarray, cut: float) -> np.ndarray:
    """Joins clusters, the most similar two first, while the cosine of their means is ``cut`` or more.

    Only sums are kept: a joined cluster's sum is that of both, and just its
    own row of the similarities changes.
    """
    if not 0 < cut <= 1:
        raise ValueError("the cosine from which clusters are joined must lie above 0 and be 1 at most")
    names, index = np.unique(labels, return_inverse=True)
    total = _sums(index, len(names), rows)
    parent = np.arange(len(names))
    similar = cosines(total, total)
    similar[np.tril_indices(len(names))] = -np.inf
    while similar.size and similar.max() >= cut:
        low, high = divmod(int(similar.argmax()), len(names))
        total[low] += total[high]
        parent[parent == high] = low
        similar[high], similar[:, high] = -np.inf, -np.inf
        again = cosines(total[low : low + 1], total)[0]
        again[[k for k in range(len(names)) if parent[k] != k or k == low]] = -np.inf
        similar[low, low + 1 :], similar[:low, low] = again[low + 1 :], again[:low]
    return names[parent][index]


METHODS = {"spectral": spectral, "average_link": average_link}


def cluster(rows: DataFrame, group: str, key: str, vector: str, method: str = "spectral", least: int = 4, merge: float | None = None, **options) -> DataFrame:
    """group, key and label of every embedding; a recording, of MOST rows at most, is one unit of work."""
    if method not in METHODS:
        raise ValueError(f"{method} isn't available: its packages aren't installed or it isn't known")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(data: pa.Table) -> pa.Table:
        if data.num_rows > MOST:
            raise ValueError(f"a recording has {data.num_rows} rows; {MOST} are the most: divide it")
        data = data.sort_by([(key, "ascending")])
        x = np.array(data[vector].to_pylist(), dtype=np.float64)
        if len(x) < FEWEST:
            labels = np.ones(len(x), np.int64)
        else:
            labels = absorb_small(METHODS[method](x, **options), x, least)
            labels = labels if merge is None else merge_similar(labels, x, merge)
        return data.select([group, key]).append_column("label", pa.array(labels.astype(np.int32)))

    return rows.select(group, key, vector).groupBy(group).applyInArrow(run, f"`{group}` {fields[group]}, `{key}` {fields[key]}, label int")


def suppress(boxes: np.ndarray, scores: np.ndarray, cut: float, keep: int = -1, candidates: int = 200) -> list[int]:
    """Non-maximum suppression over (left, top, right, bottom): places that stay, best first.

    Of the ``candidates`` boxes with the highest scores one stays unless it
    shares more than ``cut`` with a better one that stays. ``keep`` limits the
    result (0 or less: no limit).
    """
    order = np.argsort(-scores, kind="stable")[:candidates]
    low, high = boxes[order, None, :2], boxes[order, None, 2:]
    shared = np.maximum(np.minimum(high, high.swapaxes(0, 1)) - np.maximum(low, low.swapaxes(0, 1)), 0).prod(axis=2)
    area = np.diag(shared)
    covers = np.triu(shared / (area[:, None] + area - shared + 1e-5) > cut, 1)
    stays = np.ones(len(order), bool)
    for place in range(len(order)):
        stays &= ~covers[place] | ~stays[place]
    return order[stays][: keep if keep > 0 else None].tolist()
