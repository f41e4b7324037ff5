"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into as many blocks as it takes for some block of a pair within the threshold to
differ in at most one bit. In every block the anchors are the words of a perfect Hamming code of
length 2^m - 1, whose covering radius is 1: each block value has one anchor, its own, within one bit.
A fingerprint stands once at its own anchor and visits every anchor within radius plus one, that is
within two bits (at most 2^(m-1) of them). Two block values that differ in at most one bit meet there,
so comparing owners with visitors per anchor finds every pair within the threshold. For the threshold
3 there are two blocks with codes of 31 bits: 2^26 anchors each, 16 visits.

Only distinct fingerprints are compared, so copies cost one row whatever their number. The compare is an
equi-join by shuffle with a bit count as its condition; it gives linked pairs only, and the planner splits a crowded
anchor. Groups are connected components; every round of that is written to the shared folder.

Defined results: a null text counts as empty; a text without words has fingerprint 0, linked like any
other; with fewer words than a shingle the whole sequence is the only shingle. Repeated rows get the
same fingerprint and group. A null id takes part but is never a group's name unless all are null. An
empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from telltale.llm.common import in_batches, texts
from telltale.session import materialize

BITS = 64
SEED = 42
THRESHOLD = 3
SHINGLE = 3


def hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle in order, repeats included; one of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, dtype="<u8")
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    last = max(1, len(words) - shingle + 1)
    starts = [0, *ends[:last - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1:][:last] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")


def majority(found: np.ndarray) -> int:
    """Bit b is set if it is set in more than half of the hashes; 0 without any."""
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in more than half of the shingles' hashes (repeats included)."""
    return majority(hashes(text.lower().split(), shingle))  # of bytes: only A-Z change


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long with the same bits."""
    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, shingle) for t in texts(batch)], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _with_keys(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, shingle) for t in texts(batch)], dtype=np.uint64)
        return {c: batch.column(c) for c in ("doc_id", "_k", "_h")} | {"fp": found.view(np.int64)}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_k", "_h"), run,
                      "doc_id long, _k long, _h long, fp long")


def _blocks(threshold: int) -> tuple[int, int]:
    """Number of blocks, and m of the largest code of 2^m - 1 bits that fits into one."""
    count = threshold // 2 + 1
    m = (BITS // count + 1).bit_length() - 1
    return count, m


def _syndrome(block: Column, m: int) -> Column:
    """XOR of the places (from 1) of the bits that are set; 0 for a code word."""
    out = F.lit(0)
    for j in range(m):
        places = sum(1 << (p - 1) for p in range(1, 2 ** m) if p >> j & 1)
        odd = F.bit_count(block.bitwiseAND(F.lit(places).cast("long"))).bitwiseAND(F.lit(1))
        out = out + F.shiftleft(odd, j)
    return out


def _moves(m: int) -> tuple[list[int], list[list[int]]]:
    """By syndrome: the flip that leads to the own anchor, and all flips of at most two bits that lead to anchors."""
    own, all_ = [0], [[0]]
    for s in range(1, 2 ** m):
        own.append(1 << (s - 1))
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 2 ** m) if i < i ^ s]
        all_.append([1 << (s - 1), *pairs])
    return own, all_


def _anchored(fps: DataFrame, threshold: int, visits: bool) -> DataFrame:
    """block, anchor, fp: one row at the own anchor of each block, or one per visited anchor."""
    count, m = _blocks(threshold)
    own, all_ = _moves(m)
    wide = BITS // count
    used = F.lit((1 << (2 ** m - 1)) - 1).cast("long")
    parts = []
    for b in range(count):
        block = F.shiftrightunsigned("fp", b * wide).bitwiseAND(used)
        at = _syndrome(block, m) + 1
        if visits:
            table = F.array(*[F.array(*[F.lit(f).cast("long") for f in row]) for row in all_])
        else:
            table = F.array(*[F.array(F.lit(f).cast("long")) for f in own])
        parts.append(F.struct(F.lit(b).alias("block"), block.alias("value"), F.element_at(table, at).alias("flips")))
    rows = fps.select("fp", F.inline(F.array(*parts)))
    rows = rows.select("fp", "block", "value", F.explode("flips").alias("flip"))
    return rows.select("block", F.col("value").bitwiseXOR(F.col("flip")).alias("anchor"), "fp")


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs a < b (as signed longs) of distinct fingerprints that differ in at most `threshold` bits, each once.

    The planner takes a table after an explode for as long as before, so it would broadcast all visits of a small table of
    fingerprints; the hint has them joined by a shuffle at every size.
    """
    owners = _anchored(fps, threshold, visits=False).withColumnRenamed("fp", "a").hint("merge")
    visitors = _anchored(fps, threshold, visits=True).withColumnRenamed("fp", "b")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold) & (F.col("a") < F.col("b"))
    return owners.join(visitors, (owners["block"] == visitors["block"]) & (owners["anchor"] == visitors["anchor"]) & near
                       ).select("a", "b").distinct()


def components(nodes: DataFrame, pairs: DataFrame, named_by_node: bool = False) -> DataFrame:
    """node, label: the smallest `rank` that each node reaches, or its smallest node. Input: node, rank; a, b.

    Labels move along the links by grouped minima (combined map-side) and every node then takes the label
    of the node its label stands for, so a chain's length halves at least each round. Only nodes with
    a link take part in the rounds.
    """
    both = materialize(pairs.select("a", "b").union(pairs.select("b", "a")))
    # Links carry node values; the smallest rank of the own component is sought by relabelling nodes with nodes.
    linked = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        offers = both.join(linked, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("offer"))
        lower = materialize(linked.join(offers, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("was"), F.least("label", "offer").alias("label")))
        target = lower.select(F.col("node").alias("_t"), F.col("label").alias("_next"))
        linked = materialize(lower.join(target, F.col("label") == F.col("_t")).select(
            "node", F.col("_next").alias("label"), (F.col("_next") != F.col("was")).alias("moved")))
        if linked.where("moved").isEmpty():
            break
    found = nodes.join(linked.select("node", "label"), "node", "left").select(
        "node", "rank", F.coalesce("label", "node").alias("root"))
    if named_by_node:
        return found.select("node", F.col("root").alias("label"))
    found = materialize(found)
    best = materialize(found.groupBy("root").agg(F.min("rank").alias("label")))
    return found.join(best, "root").select("node", "label")


def groups(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that a document reaches over links."""
    rows = materialize(fingerprints(docs, shingle))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rank")).withColumnRenamed("fp", "node"))
    found = materialize(components(nodes, links(nodes.select(F.col("node").alias("fp")), threshold)))
    return rows.join(found, F.col("fp") == F.col("node")).select("doc_id", "fp", F.col("label").alias("component_id"))


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the smallest id; the columns are those of the input.

    Where rows of a group share the smallest id, or all its ids are null, the row with the smallest text
    hash stays; of rows that agree in id and text, one stays. `_k` and `_h` must not be input columns.
    """
    key = {"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)), "_h": F.xxhash64(F.coalesce("text", F.lit("")))}
    rows = materialize(docs.withColumns(key).select("doc_id", "text", "_k", "_h").transform(
        lambda d: _with_keys(d, shingle)))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rank")).withColumnRenamed("fp", "node"))
    found = materialize(components(nodes, links(nodes.select(F.col("node").alias("fp")), threshold), named_by_node=True))
    # The order of rows inside a group: id (null last), then the hash of the text.
    placed = rows.join(found, F.col("fp") == F.col("node")).select(
        F.col("label").alias("group"), F.struct(F.col("doc_id").isNull(), F.col("_k"), F.col("_h")).alias("row"))
    first = materialize(placed.groupBy("group").agg(F.min("row").alias("row")).select("row._k", "row._h"))
    stays = docs.withColumns(key).join(first, ["_k", "_h"], "left_semi")
    return stays.dropDuplicates(["_k", "_h"]).select(*docs.columns)
