"""Bounded labelled samples and the small linear models fitted on them."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


ENTRIES = 1_000_000  # of a sparse table that are spread out at a time


def per_class(labels: DataFrame, label: str, bound: int, keep: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and label of about `bound` labelled rows of each class, and the rows there are of each class.

    A class with more rows is thinned by a hash of the id, so that the same rows come out on any cluster; the sample
    never grows with the input. Rows without id or label take no part. An id that is labelled twice counts with its
    largest label.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep))
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy(label).count().collect()}
    every = F.lit(1)
    for value, n in counts.items():
        every = F.when(F.col(label) == value, max(1, -(-n // bound))).otherwise(every)
    thinned = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), every) == 0)
    sample = thinned.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    return sample, counts


def with_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, label of the sampled rows. The sample's size is bounded by its parameter, hence the broadcast."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_label").alias("label"))


def class_weights(labels: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give each class of the sample the share it has among all labelled rows; their mean is 1."""
    weights = np.ones(len(labels))
    for value in (0, 1):
        rows = labels == value
        if rows.any():
            weights[rows] = counts.get(value, 0) / rows.sum()
    return weights / weights.mean() if weights.mean() > 0 else np.ones(len(labels))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic_sparse(starts: np.ndarray, places: np.ndarray, scale: np.ndarray, labels: np.ndarray, weights: np.ndarray, l2: float,
                    rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; row i has the places starts[i]:starts[i+1], each with its `scale` as value.

    Beside the places themselves only vectors over rows or places are held, and the entries of `ENTRIES` places at a time.
    """
    n, width = len(labels), len(scale)
    blocks, first = [], 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + ENTRIES, side="right")) - 1)
        blocks.append((first, last))
        first = last

    def per_row(value: np.ndarray) -> np.ndarray:
        out = np.empty(n)
        for a, b in blocks:
            some = value[places[starts[a]:starts[b]]]
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), np.diff(starts[a:b + 1])), some, minlength=b - a)
        return out

    def per_place(value: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        for a, b in blocks:
            out += np.bincount(places[starts[a]:starts[b]], np.repeat(value[a:b], np.diff(starts[a:b + 1])), minlength=width)
        return out * scale

    squared = per_row(scale ** 2) + 1
    step = 4 / (float((squared * weights).mean()) + l2)
    w, b = np.zeros(width), float(np.log((weights @ labels + 1) / (weights @ (1 - labels) + 1)))
    vw, vb, last = w.copy(), b, np.inf
    for t in range(rounds):
        z = per_row(vw * scale) + vb
        gap = weights * (sigmoid(z) - labels) / n
        loss = float(weights @ np.logaddexp(0, np.where(labels == 1, -z, z))) / n + l2 / 2 * float(vw @ vw)
        if loss > last * 1.5:  # too large a step
            step, vw, vb = step / 4, w.copy(), b
            last = np.inf
            continue
        last = loss
        nw = vw - step * (per_place(gap) + l2 * vw)
        nb = vb - step * float(gap.sum())
        push = t / (t + 3)
        vw, vb = nw + push * (nw - w), nb + push * (nb - b)
        w, b = nw, nb
    return w, b


def logistic_dense(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, l2: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the intercept is not penalised."""
    n, k = x.shape
    full = np.hstack([x, np.ones((n, 1))])
    penalty = np.diag([l2] * k + [1e-6])
    w = np.zeros(k + 1)
    for _ in range(rounds):
        p = sigmoid(full @ w)
        gradient = full.T @ (weights * (p - labels)) + penalty @ w
        hessian = (full * (weights * p * (1 - p))[:, None]).T @ full + penalty
        move = np.linalg.solve(hessian, gradient)
        w -= move * min(1.0, 5 / max(float(np.abs(move).max()), 1e-12))
        if float(np.abs(move).max()) < 1e-8:
            break
    return w[:-1], float(w[-1])


def auc(scores: Sequence[float], labels: Sequence[int]) -> float:
    """Area under the ROC curve, ties counted by half."""
    s, y = np.asarray(scores), np.asarray(labels)
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    good = y.sum()
    return float((ranks[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good)))
