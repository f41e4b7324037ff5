"""Toxicity: a character n-gram linear classifier with features scaled by naive Bayes log-count ratios.

A document's features are the n-grams of 3 to 5 characters of its lower-cased text, hashed to `SLOTS` places, each
counted as present or not. From a bounded labelled sample (`SAMPLE` documents of each class at most, the documented
limit) the log-count ratio r of every place is computed, and a logistic regression is fitted on presence times r, over all
places that two or more of the sampled documents have. The model is one number per place, so scoring is a sum over the
text's distinct places. Every text is scored whole.

Defined results: null, empty and very short texts have no features and get the score of the bias. Without
labelled rows of both classes every score is the share of toxic labels (0.5 if there are none). Repeated rows
score alike, null ids are scored and never used for learning. Columns other than the id and the text are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from telltale.llm import learn
from telltale.llm.common import in_batches, texts
from telltale.session import materialize

SIZES = (3, 4, 5)
BITS = 20
SLOTS = 1 << BITS
SAMPLE = 2500
SMOOTH = 0.5
SPREAD, FINAL = 2654435761, 2246822519


@dataclass
class Model:
    weights: np.ndarray  # float32, one per slot; 0 where the slot is not a feature
    bias: float


def slots(text: bytes) -> list[np.ndarray]:
    """Slot of every n-gram, one array for each size."""
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out, run = [], codes.astype(np.uint32)
    for n in range(2, max(SIZES) + 1):
        if len(run) < 2:
            break
        run = run[:-1] * np.uint32(SPREAD) + codes[n - 1:]
        if n in SIZES:
            mixed = (run ^ (run >> np.uint32(15))) * np.uint32(FINAL + 2 * n)
            out.append(mixed >> np.uint32(32 - BITS))
    return out


def present(text: bytes) -> np.ndarray:
    found = slots(text)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def _counts(sample: DataFrame) -> np.ndarray:
    """Documents of each class that have each slot: 2 x SLOTS. Every batch of the bounded sample gives one partial count."""
    def run(batch: pa.RecordBatch) -> dict:
        out = np.zeros((2, SLOTS), np.int32)
        for text, label in zip(texts(batch), batch.column("label").to_pylist()):
            out[label, present(text)] += 1
        some = np.flatnonzero(out.any(axis=0)).astype(np.int32)
        return {"slots": [some.tobytes()], "counts": [out[:, some].tobytes()]}

    total = np.zeros((2, SLOTS), np.int64)
    for row in in_batches(sample, run, "slots binary, counts binary").toLocalIterator():
        at = np.frombuffer(row["slots"], np.int32)
        total[:, at] += np.frombuffer(row["counts"], np.int32).reshape(2, -1)
    return total


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, bound: int = SAMPLE) -> Model:
    """The model from labels (doc_id, toxic) for which `keep` holds; at most about `bound` documents of each class."""
    sample, counts = learn.per_class(labels, "toxic", bound, keep)
    sample = materialize(learn.with_texts(docs, materialize(sample)).repartition(
        docs.sparkSession.sparkContext.defaultParallelism, "doc_id"))
    seen = _counts(sample)
    whole = sum(counts.values())
    if min(counts.get(0, 0), counts.get(1, 0)) == 0 or not seen[0].any() or not seen[1].any():
        share = counts.get(1, 0) / whole if whole else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(SLOTS, np.float32), float(np.log(share / (1 - share))))
    clean, toxic = (seen + SMOOTH) / (seen + SMOOTH).sum(axis=1, keepdims=True)
    ratio = np.log(toxic / clean)
    chosen = np.flatnonzero(seen.sum(axis=0) > 1)
    place = np.full(SLOTS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def rows(batch: pa.RecordBatch) -> dict:
        found = [place[p][place[p] >= 0].tobytes() for p in map(present, texts(batch))]
        return {"label": batch.column("label"), "places": found, "doc_id": batch.column("doc_id")}

    found, y, ends = [], [], [0]
    for r in in_batches(sample, rows, "doc_id long, label int, places binary").orderBy("doc_id").toLocalIterator():
        found.append(np.frombuffer(r["places"], np.int32))
        y.append(r["label"])
        ends.append(ends[-1] + len(found[-1]))
    flat, y = np.empty(ends[-1], np.int32), np.array(y)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        flat[a:b], found[i] = found[i], None
    w, bias = learn.logistic_sparse(np.array(ends), flat, ratio[chosen], y, learn.class_weights(y, counts), l2=1e-3)
    weights = np.zeros(SLOTS, np.float32)
    weights[chosen] = w * ratio[chosen]
    return Model(weights, bias)


def score_text(text: bytes, model: Model, used: np.ndarray) -> float:
    hits = [s[used[s]] for s in slots(text)]
    total = float(model.weights[np.unique(np.concatenate(hits))].sum(dtype=np.float64)) if hits else 0.0
    return total + model.bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score from 0 to 1."""
    used = model.weights != 0

    def run(batch: pa.RecordBatch) -> dict:
        z = np.array([score_text(t, model, used) for t in texts(batch)])
        return {"doc_id": batch.column("doc_id"), "score": learn.sigmoid(z)}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that are never learnt from: CRC-32 of the id's text divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
