"""Language identification by Bayesian evidence fusion over web pages.

Four kinds of evidence are added as log probabilities of each language:

* the text: a naive Bayes model of character 1- to 3-grams, fitted on a bounded sample of texts of known language (`SAMPLE`
  documents of each, the documented limit). n-grams of one text are far from independent, so the sum over the whole text is
  tempered: it counts as much as `WORTH` n-grams at most;
* the language that the page declares in its markup;
* the suffix of its address (top-level domain and a leading language folder);
* the host: how often it has each language, smoothed towards its domain and that towards all pages.

How much declarations and suffixes are worth is not assumed: the probabilities of each declaration and suffix given the
language, and the host counts, are sums over all pages of what the text alone says (soft counts), grouped with map-side
combine. A host's counts leave out the page itself.

Defined results: a page without text, declaration or host (nulls, empty) is judged by what is left, at least by the shares of
all pages; a null address has no host and no suffix. Very long pages are read whole, in linear time. Repeated rows count each for itself. Without texts of known language,
or without pages, the result is empty. Ties go to the language that comes first in code point order. Other columns are not read.
"""
from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from telltale.llm.common import in_batches
from telltale.session import materialize

SAMPLE = 400
BITS = 16
SLOTS = 1 << BITS
WORTH = 60.0
HOST_STRENGTH, DOMAIN_STRENGTH, SMOOTH = 8.0, 20.0, 0.5
# A tag ends at the next angle bracket, and no quantifier gives back what it took: every pattern runs once through the page.
SCRIPT = re.compile(r"<(script|style|noscript)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
TAG = re.compile(r"<[^<>]*+>")
ROOT = re.compile(r"<html\b([^<>]*+)", re.I)
DECLARED = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})", re.I)
SLICE = 1 << 18  # code points counted at once


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray   # SLOTS x languages: log probability of each slot
    shares: np.ndarray  # log share of each language


def visible(page: str) -> str:
    return entities.unescape(TAG.sub(" ", SCRIPT.sub(" ", page)))


def declared(page: str) -> str:
    """The language that the first html tag declares, or nothing."""
    root = ROOT.search(page)
    found = DECLARED.search(root[1]) if root else None
    return found[1].lower() if found else ""


def counted(text: str) -> np.ndarray:
    """How often each slot has a 1- to 3-gram of the lower-cased letters; all else is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xAA)
    out = np.zeros(SLOTS, np.int64)
    if not letter.any():
        return out
    codes = np.where(letter, codes, 32).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    for at in range(0, len(codes), SLICE):  # the n-grams that begin in this slice
        part = codes[at:at + SLICE + 2]
        own, run = min(SLICE, len(part)), np.zeros(len(part), np.uint32)
        for n in (1, 2, 3):
            run = run[:len(part) - n + 1] * np.uint32(2654435761) + part[n - 1:]
            mixed = (run ^ (run >> np.uint32(15))) * np.uint32(2246822519 + 2 * n)
            out += np.bincount((mixed >> np.uint32(32 - BITS))[:own], minlength=SLOTS)
    return out


def fit(texts: DataFrame, language: str = "lang", bound: int = SAMPLE) -> Model | None:
    """The text model from rows of text and language; about `bound` rows of each language at most."""
    known = texts.where(F.col(language).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: int(r[1]) for r in known.groupBy(language).count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    every = F.lit(1)
    for name, n in counts.items():
        every = F.when(F.col(language) == name, max(1, -(-n // bound))).otherwise(every)
    number = {name: i for i, name in enumerate(languages)}
    some = known.select("text", F.col(language).alias("lang")).where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), every) == 0)

    def run(batch: pa.RecordBatch) -> dict:
        out = np.zeros((SLOTS, len(languages)), np.int32)
        for text, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            out[:, number[name]] += counted(text).astype(np.int32)
        used = np.flatnonzero(out.any(axis=1)).astype(np.int32)
        return {"slots": [used.tobytes()], "counts": [out[used].tobytes()]}

    total = np.zeros((SLOTS, len(languages)))
    for row in in_batches(some, run, "slots binary, counts binary").toLocalIterator():
        total[np.frombuffer(row["slots"], np.int32)] += np.frombuffer(row["counts"], np.int32).reshape(-1, len(languages))
    seen = total + 0.1
    shares = np.array([counts[name] for name in languages], float)
    return Model(languages, np.log(seen / seen.sum(axis=0)), np.log(shares / shares.sum()))


def text_logs(text: str, model: Model) -> np.ndarray:
    """Tempered log likelihood of each language, the largest of them 0."""
    counts = counted(text)
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(model.languages))
    z = counts[used] @ model.logs[used] * min(1.0, WORTH / int(counts.sum()))
    return z - z.max()


def _host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _domain(host: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def _suffix(url: Column, host: Column) -> Column:
    top = F.coalesce(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))
    folder = F.coalesce(F.lower(F.regexp_extract(url, r"^[^/]*//[^/]*/([A-Za-z]{2})(?:[/?#-]|$)", 1)), F.lit(""))
    return F.concat(top, F.lit("/"), folder)


def evidence(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, declared, host, domain, suffix, logs (text evidence), soft (what the text alone says)."""
    def run(batch: pa.RecordBatch) -> dict:
        rows = [p or "" for p in batch.column("html").to_pylist()]
        logs = [text_logs(visible(p), model) for p in rows]
        soft = [np.exp(z + model.shares) for z in logs]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"),
                "declared": [declared(p) for p in rows],
                "logs": pa.array([z.tolist() for z in logs], pa.list_(pa.float64())),
                "soft": pa.array([(s / s.sum()).tolist() for s in soft], pa.list_(pa.float64()))}

    rows = in_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run,
                      "page_id long, url string, declared string, logs array<double>, soft array<double>")
    host = _host(F.col("url"))
    return rows.select("page_id", "declared", host.alias("host"), _domain(host).alias("domain"),
                       _suffix(F.col("url"), host).alias("suffix"), "logs", "soft")


def _sums(found: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Soft counts of each language by key, as one array; doubles are added map-side first."""
    parts = found.groupBy(*keys).agg(*[F.sum(F.get("soft", i)).alias(f"_{i}") for i in range(size)])
    return parts.select(*keys, F.array(*[f"_{i}" for i in range(size)]).alias(name))


def identify(pages: DataFrame, model: Model | None) -> DataFrame:
    """page_id, lang, probability, text_lang (by the text alone), declared, host."""
    spark = pages.sparkSession
    if model is None:
        return spark.createDataFrame([], "page_id long, lang string, probability double, text_lang string, declared string, host string")
    k = len(model.languages)
    found = materialize(evidence(pages, model))
    by_declared, by_suffix = (materialize(_sums(found, [c], k, f"{c}_n")) for c in ("declared", "suffix"))
    by_host = materialize(_sums(found, ["host", "domain"], k, "host_n"))
    by_domain = materialize(by_host.groupBy("domain").agg(*[F.sum(F.get("host_n", i)).alias(f"_{i}") for i in range(k)]).select(
        "domain", F.array(*[f"_{i}" for i in range(k)]).alias("domain_n")))
    whole = by_domain.agg(*[F.sum(F.get("domain_n", i)).alias(f"_{i}") for i in range(k)], F.count(F.lit(1)).alias("_n")).first()
    total = np.array([float(whole[f"_{i}"] or 0) for i in range(k)]) + SMOOTH
    kinds = {c: int(t.count()) for c, t in (("declared", by_declared), ("suffix", by_suffix))}
    rows = found
    for table, keys in ((by_declared, ["declared"]), (by_suffix, ["suffix"]), (by_host, ["host"]), (by_domain, ["domain"])):
        named = table.withColumnsRenamed({c: f"_k_{c}" for c in keys}).drop(*([] if keys == ["domain"] else ["domain"]))
        rows = rows.join(named, F.col(keys[0]).eqNullSafe(F.col(f"_k_{keys[0]}"))).drop(f"_k_{keys[0]}")
    size_h, size_d = F.aggregate("host_n", F.lit(0.0), lambda a, x: a + x), F.aggregate("domain_n", F.lit(0.0), lambda a, x: a + x)

    def score(i: int) -> Column:
        own, n = F.get("soft", i), F.lit(float(total[i]))
        share = float(total[i] / total.sum())
        domain = (F.get("domain_n", i) - own + DOMAIN_STRENGTH * share) / (size_d - 1 + DOMAIN_STRENGTH)
        host = (F.get("host_n", i) - own + HOST_STRENGTH * domain) / (size_h - 1 + HOST_STRENGTH)
        prior = F.when(F.col("host").isNull(), F.lit(share)).otherwise(F.greatest(host, F.lit(1e-9)))
        z = F.get("logs", i) + F.log(prior)
        for c in ("declared", "suffix"):
            given = (F.get(f"{c}_n", i) - own + SMOOTH) / (n - own + SMOOTH * kinds[c])
            silent = F.col(c).isin("", "/")
            z = z + F.when(silent, 0.0).otherwise(F.log(F.greatest(given, F.lit(1e-9))))
        return z

    scored = rows.withColumn("_z", F.array(*[score(i) for i in range(k)]))
    names = F.array(*[F.lit(n) for n in model.languages])
    top = F.array_max("_z")
    spread = F.aggregate("_z", F.lit(0.0), lambda a, z: a + F.exp(z - top))
    texts = F.zip_with("logs", F.array(*[F.lit(float(s)) for s in model.shares]), lambda a, b: a + b)
    return scored.select(
        "page_id", F.get(names, (F.array_position("_z", top) - 1).cast("int")).alias("lang"), (1 / spread).alias("probability"),
        F.get(names, (F.array_position(texts, F.array_max(texts)) - 1).cast("int")).alias("text_lang"), "declared", "host")
