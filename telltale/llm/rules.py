"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per document and stores the failures as bits of one long
besides the measurements. A policy is a named, versioned set of rules, that is a mask: its
verdict is `fail_bits & mask = 0`, so a new policy never reads a text again. `ablations` asks
what each rule of a policy decides alone, by bitwise aggregation over the ledger only.

Defined results: a null text has no words; so does an empty or all-blank one, and both fail
`few_words`. Repeated rows, ties and null ids are judged row by row. An empty table gives an
empty ledger. Columns of the input other than the id and the text are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from telltale.llm.common import in_batches, texts

WINDOW = 8
# Fixed values of the contract: symbol characters.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters",
            "n_marks")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def _rules() -> dict[str, Column]:
    """Rule name -> failure, in bit order. Rules are only ever appended, so old bits keep their meaning."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_words": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "short_or_long_words": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "duplicate_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "capitals": 2 * c("n_capitals") > c("n_letters"),
        "marks": 2 * c("n_marks") > c("n_words"),
    }


RULES = ("few_words", "repeated_words", "symbols", "short_or_long_words", "duplicate_lines", "capitals", "marks")
BASE = ("few_words", "repeated_words")
# Versioned policies; one that is in use is never changed, a new version is added.
POLICIES = {"base-1": BASE, "web-1": BASE + ("symbols", "short_or_long_words"), "web-2": RULES}


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` (a power of two) words found twice or more."""
    size = 1
    while size < window:
        if len(ids) <= size + 1:
            return 0
        kinds = int(ids.max()) + 1
        pairs = ids[:-size] * kinds + ids[size:]
        _, ids = np.unique(pairs, return_inverse=True)
        size *= 2
        if int(ids.max()) + 1 == len(ids):  # every shorter window is the only one of its kind
            return 0
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(ids) + window, np.int64)
    edges[again] += 1
    edges[again + window] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    seen = dict.fromkeys(words)
    number = dict(zip(seen, range(len(seen))))
    again = repeated(np.array([number[w] for w in words], np.int64)) if len(words) > WINDOW else 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    starts = int(bytes_of[:128].sum() + bytes_of[192:].sum())
    blank = int(bytes_of[9:14].sum() + bytes_of[32])
    capitals = int(bytes_of[65:91].sum())
    return (len(words), starts - blank, int(sum(bytes_of[ord(s)] for s in SYMBOLS)), len(lines) - len(set(lines)), again,
            len(lines), capitals, capitals + int(bytes_of[97:123].sum()), int(bytes_of[33] + bytes_of[63]))


def measurements(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([measure(t) for t in texts(batch)], np.int64)
        return {"doc_id": batch.column("doc_id")} | {m: found[:, i] for i, m in enumerate(MEASURES)}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, LEDGER)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits with bit i set where rule i of `RULES` fails."""
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(_rules().items()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs).withColumn("fail_bits", bits)


def verdict(policy: str, fail_bits: str | Column = "fail_bits") -> Column:
    """True where the policy keeps the document."""
    bits = F.col(fail_bits) if isinstance(fail_bits, str) else fail_bits
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, those only it fails, and those kept without it.

    The bit patterns are counted first; there are at most 2 ** rules of them, however many documents.
    """
    whole = F.lit(mask(policy)).cast("long")
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(whole).alias("bits")).agg(F.count(F.lit(1)).alias("docs"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
                      for r in POLICIES[policy]])
    each = patterns.select("bits", "docs", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("docs")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("docs")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("docs")).otherwise(0)).alias("kept_without"))


def failures(book: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: which rules any document fails, and which every document fails."""
    return book.groupBy(*keys).agg(F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"),
                                   F.count(F.lit(1)).alias("docs"))
