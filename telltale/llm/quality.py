"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier on a dozen plain measures of the text, fitted on a bounded labelled sample (`SAMPLE` documents
of each class at most, the documented limit), gives each document's own evidence: the log odds of its probability
against the share of good labels. Hosts and paths add what their other documents look like. With soft counts (the
sum of probabilities) by host and by path, grouped with map-side combine,

    host mean = (good of the host + k1 * global mean) / (documents of the host + k1)
    path mean = (good of the path + k2 * host mean) / (documents of the path + k2)

where the document's own probability is left out of both. The prior strengths k1 and k2 are estimated from the
spread of the group means beyond sampling noise (method of moments), so sparse sites shrink towards the level above
and large ones speak for themselves. The posterior adds the document's evidence to the log odds of its path mean.

Defined results: null and empty texts have measures of zero and are scored; null hosts and paths are groups of their
own. Without labels of both classes the document evidence is zero, and with no documents the result is empty.
Repeated rows count each for itself. Input columns pass through `accepted` unless they are named `_host`, `_path`
or `_p`.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from telltale.llm import learn
from telltale.llm.common import in_batches, texts
from telltale.session import materialize

SAMPLE = 10000
SYMBOLS = b"#*$%&|<>"
NAMES = ("log_words", "word_length", "symbols", "capitals", "marks", "digits", "duplicate_lines", "line_words", "kinds",
         "same_next", "top_word", "wide", "brackets", "short_words")
KEEP = 0.5
LIMITS = (1e-4, 1 - 1e-4)


def measures(text: bytes) -> np.ndarray:
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES))
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = max(1, int(at[:128].sum() + at[192:].sum() - at[9:14].sum() - at[32]))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    letters = max(1, int(at[65:91].sum() + at[97:123].sum()))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return np.array([
        np.log(n), points / n, min(3.0, sum(int(at[s]) for s in SYMBOLS) / n), at[65:91].sum() / letters,
        min(3.0, (at[33] + at[63]) / n), at[48:58].sum() / points, 1 - len(set(lines)) / len(lines), np.log(n / len(lines)),
        len(counts) / n, same / n, max(counts.values()) / n, at[128:].sum() / len(text),
        min(3.0, sum(int(at[c]) for c in b"{}[]()=;_") / n), sum(len(w) < 3 for w in words) / n])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    share: float  # of good labels

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return learn.sigmoid((rows - self.centre) / self.scale @ self.weights + self.bias)


@dataclass
class Priors:
    mean: float
    host_strength: float
    path_strength: float


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """The document classifier from labels (doc_id, quality)."""
    sample, counts = learn.per_class(labels, "quality", bound)
    sample = learn.with_texts(docs, materialize(sample))

    def run(batch: pa.RecordBatch) -> dict:
        rows = [measures(t).tolist() for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.array(rows, pa.list_(pa.float64()))}

    got = in_batches(sample, run, "doc_id long, label int, x array<double>").orderBy("doc_id", "label").collect()
    y = np.array([r["label"] for r in got], float)
    whole = sum(counts.values())
    share = min(max(counts.get(1, 0) / whole if whole else 0.5, 0.01), 0.99)
    k = len(NAMES)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(share / (1 - share))), share)
    x = np.array([r["x"] for r in got])
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - centre) / scale
    w, b = learn.logistic_dense(z, y, learn.class_weights(y, counts), l2=0.5)
    return Model(centre, scale, w, b, share)


def probability(model: Model):
    """The classifier as a column function of the text."""
    @F.pandas_udf("double")
    def own(text: pd.Series) -> pd.Series:
        rows = [measures(b"" if t is None else t.encode("utf-8", "replace")) for t in text]
        return pd.Series(model.probability(np.array(rows).reshape(-1, len(NAMES))))

    return own


def _strength(between: float | None, within: float | None, mean: float) -> float:
    """Prior documents worth of the level above: mean (1 - mean) over the true variance of group means, less 1."""
    variance = max((between or 0.0) - (within or 0.0), 1e-6)
    return float(min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6))


def site_counts(evidence: DataFrame) -> DataFrame:
    """_host, _path, docs, good of every path. Input: _host, _path, _p."""
    return evidence.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("docs"), F.sum("_p").alias("good"))


def priors(paths: DataFrame) -> tuple[DataFrame, Priors]:
    """The path table with its host's counts, and the global mean and strengths (three numbers) by moments.

    The variance of group means is weighted by documents; sampling noise of a group of n documents is mean (1 - mean) / n.
    """
    hosts = paths.groupBy("_host").agg(F.sum("docs").alias("host_docs"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_good").alias("g"), F.count(F.lit(1)).alias("k")).first()
    if not total["n"]:
        mean, k = 0.5, 0
    else:
        mean, k = min(max(total["g"] / total["n"], LIMITS[0]), LIMITS[1]), total["k"]
    n = float(total["n"] or 1)
    spread = hosts.agg(F.sum(F.col("host_docs") * F.pow(F.col("host_good") / F.col("host_docs") - mean, 2))).first()[0]
    host_strength = _strength((spread or 0.0) / n, k * mean * (1 - mean) / n, mean)
    named = hosts.withColumnRenamed("_host", "_site")
    placed = paths.join(named, F.col("_host").eqNullSafe(F.col("_site"))).drop("_site")
    inner = placed.agg(F.sum(F.col("docs") * F.pow(F.col("good") / F.col("docs") - F.col("host_good") / F.col("host_docs"), 2)).alias("s"),
                       F.count(F.lit(1)).alias("k")).first()
    path_strength = _strength((inner["s"] or 0.0) / n, inner["k"] * mean * (1 - mean) / n, mean)
    return placed, Priors(mean, host_strength, path_strength)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(LIMITS[0])), F.lit(LIMITS[1]))
    return F.log(q / (1 - q))


def posterior(level: Priors, share: float) -> Column:
    """From _p, docs, good, host_docs, host_good: the document's posterior, its own probability left out of the priors."""
    p = F.col("_p")
    host = (F.col("host_good") - p + level.host_strength * level.mean) / (F.col("host_docs") - 1 + level.host_strength)
    path = (F.col("good") - p + level.path_strength * host) / (F.col("docs") - 1 + level.path_strength)
    z = _logit(p) - float(np.log(share / (1 - share))) + _logit(path)
    return 1 / (1 + F.exp(-z))


def _sites(evidence: DataFrame) -> tuple[DataFrame, Priors]:
    placed, level = priors(materialize(site_counts(evidence)))
    return materialize(placed).withColumnsRenamed({"_host": "_site", "_path": "_way"}), level


def _same_site() -> Column:
    return F.col("_host").eqNullSafe(F.col("_site")) & F.col("_path").eqNullSafe(F.col("_way"))


def scores(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """doc_id, own (the classifier's probability), prior counts and score (the posterior), without the text."""
    evidence = materialize(docs.select("doc_id", host.alias("_host"), path.alias("_path"), probability(model)("text").alias("_p")))
    sites, level = _sites(evidence)
    return evidence.join(sites, _same_site()).select(
        "doc_id", F.col("_p").alias("own"), F.col("docs").alias("path_docs"), "host_docs", posterior(level, model.share).alias("score"))


def accepted(docs: DataFrame, model: Model, host: Column, path: Column, keep: float = KEEP) -> DataFrame:
    """The documents whose posterior reaches `keep`; the columns are those of the input.

    The probabilities are computed once for the site counts and again for the verdict, so the texts are not shuffled
    or stored in between; only where the table of sites is too large for the planner to broadcast are they shuffled once.
    """
    own = probability(model)
    sites, level = _sites(docs.select(host.alias("_host"), path.alias("_path"), own("text").alias("_p")))
    judged = docs.withColumns({"_host": host, "_path": path, "_p": own("text")}).join(sites, _same_site())
    return judged.where(posterior(level, model.share) >= keep).select(*docs.columns)
