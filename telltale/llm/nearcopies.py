"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First come SimHash fingerprints of the five-word shingles: `simhash.links` finds, by anchors of perfect Hamming codes, all fingerprints
that differ in three bits at most. Texts of one fingerprint meet the smallest of them, and a fingerprint its smallest and its largest
neighbour. That brings most copies together; similarities down to 0.8 mean up to eleven bits, so keys of minima find what is left.

Every distinct text gets 150 minima of its shingles' hashes, cut into 30 keys of five. Two texts share a key with
probability s ** 5 at similarity s, so a pair at exactly 0.8 has none with probability 7e-6, and one at 0.9 with 1e-12.
Texts that share a key are candidates; a link is made only if the two whole shingle sets pass the exact comparison.

A crowd of near copies does not pair up: in each key the smallest member is the pivot, and all others are compared with it: each with
the smallest of its pivots first, then, if it is in another group than one of them, with the largest such, and then with all such.
Groups are components of those links. What a pivot left apart is compared with `PIVOTS` more members, the smallest of as many
parts of the key, and what is apart even then with every member of its key that is in another group. So no pair that
could join two groups is left out, and no pair within a group is formed. Texts are fetched and compared only for pairs that a sketch
leaves: the parities of a set's shingles in 2,048 places differ in no more bits than the sets in shingles, so it rules out only
pairs below the similarity. The last step tests it within its join, so a crowd of texts that are no copies makes few rows.

Defined results: words and lower case are those of the fingerprints (bytes, only A-Z change). With fewer words than a shingle
the whole sequence is the only shingle. A null text counts as empty; texts without words are copies of one another.
Repeated rows, null ids and ties are as in `simhash.representatives`. An empty table gives an empty result. Input columns must not
be named `_k` or `_h`; others pass through.
"""
from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from telltale.llm.common import in_batches, texts
from telltale.llm.simhash import SEED, components, hashes, links as fingerprint_links, majority
from telltale.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
KEYS = 30
MINIMA = 5  # of one key
PIVOTS = 8
SKETCH = 32  # longs of a shingle set's parities
BROADCAST_KEYS = 100_000  # with more shared keys, members and keys meet by a shuffle
CACHED = 64  # shingle sets that a worker keeps while it compares
FACTORS = np.random.default_rng(SEED).integers(0, 2 ** 31, KEYS * MINIMA, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    return np.unique(hashes(words, shingle))


def keys(hashes: np.ndarray) -> list[int]:
    """One signed long for each group of minima."""
    low = np.full(KEYS * MINIMA, 2 ** 32 - 1, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(low, (short[None, at:at + 512] * FACTORS).min(axis=1), out=low)
    digest = xxhash.xxh64_intdigest
    found = [digest(low[i * MINIMA:(i + 1) * MINIMA].tobytes(), i) for i in range(KEYS)]
    return np.array(found, dtype=np.uint64).view(np.int64).tolist()


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * `SKETCH` places, dealt by hash, a bit: whether an odd number of the shingles lies there.

    A shingle that only one of two sets has changes one bit, so the sets differ in as many shingles as bits at least.
    """
    places = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((places & 1).astype(bool), bitorder="little").view(np.int64)


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """_k, _h, doc_id, the node (hash of the words in lower case), number of distinct shingles, fingerprint, keys, parities."""
    def run(batch: pa.RecordBatch) -> dict:
        nodes, sizes, prints, found, odd = [], [], [], [], []
        for text in texts(batch):
            words = text.lower().split()
            every = hashes(words, shingle)
            own = np.unique(every)
            prints.append(majority(every))
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            sizes.append(len(own))
            found.append(keys(own))
            odd.append(parities(own).tolist())
        return {c: batch.column(c) for c in ("doc_id", "_k", "_h")} | {
            "node": np.array(nodes, dtype=np.uint64).view(np.int64), "size": sizes, "fp": np.array(prints, dtype=np.uint64).view(np.int64), "keys": found, "odd": odd}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_k", "_h"), run,
                      "doc_id long, _k long, _h long, node long, size int, fp long, keys array<bigint>, odd array<bigint>")


def _alike(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """a, b of the rows whose texts reach the similarity. Input: a, b, a_text, b_text."""
    def run(batch: pa.RecordBatch) -> dict:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: bytes) -> np.ndarray:
            if node not in kept:
                kept[node] = shingles(text.lower().split(), shingle)
            kept.move_to_end(node)
            if len(kept) > CACHED:
                kept.popitem(last=False)
            return kept[node]

        out = []
        for a, b, s, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), texts(batch, "a_text"), texts(batch, "b_text")):
            x, y = of(a, s), of(b, t)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                out.append((a, b))
        return {"a": [p[0] for p in out], "b": [p[1] for p in out]}

    return in_batches(rows, run, "a long, b long")


def _checked(pairs: DataFrame, rows: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The candidate pairs whose whole texts reach the similarity."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    place = materialize(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_k", "_h")).alias("row")).select(
        "node", "row._k", "row._h"))
    whole = materialize(docs.select("_k", "_h", "text").join(place, ["_k", "_h"]).select("node", "text").dropDuplicates(["node"]))
    left, right = whole.toDF("a", "a_text"), whole.toDF("b", "b_text")
    return materialize(_alike(pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text"), similarity, shingle))


def _sizes_near(a: str, b: str, similarity: float) -> Column:
    """A similarity of s needs sizes whose ratio is s at least."""
    return F.least(a, b) >= F.greatest(a, b) * similarity - 1e-9


def _could_be_alike(a: str, b: str, similarity: float) -> Column:
    """False only if the sizes or parities (`a`_size, `a`_odd) show that the similarity is missed; no pair that reaches it is lost.

    Two sets of x and y shingles that reach s differ in (x + y) * (1 - s) / (1 + s) shingles at most.
    """
    bits = F.aggregate(F.zip_with(f"{a}_odd", f"{b}_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    most = (F.col(f"{a}_size") + F.col(f"{b}_size")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return _sizes_near(f"{a}_size", f"{b}_size", similarity) & (bits <= most)


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b that sizes and parities leave, before their texts are fetched."""
    left, right = (sketches.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("odd").alias(f"{s}_odd")) for s in "ab")
    return materialize(pairs.join(left, "a").join(right, "b").where(_could_be_alike("a", "b", similarity)).select("a", "b"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates a, b with their sizes: texts of one fingerprint, then of fingerprints within three bits; at most two for each text."""
    first = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("own")))
    equal = nodes.join(first, "fp").where("node != own.node").select(
        F.col("own.node").alias("a"), F.col("node").alias("b"), F.col("own.size").alias("a_size"), F.col("size").alias("b_size"))
    near = materialize(fingerprint_links(first.select("fp"))).groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("low"), F.max("a").alias("high"))
    ends = near.select("fp", F.explode(F.array_distinct(F.array("low", "high"))).alias("other")).join(first, "fp").withColumnRenamed("own", "mine")
    close = ends.join(first.toDF("other", "own"), "other").select(
        F.col("own.node").alias("a"), F.col("mine.node").alias("b"), F.col("own.size").alias("a_size"), F.col("mine.size").alias("b_size"))
    return equal.union(close)


def groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _k, _h, node) and labels (node, label): the groups of linked texts. Input needs _k and _h."""
    rows = materialize(_described(docs, shingle))
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("rank"), F.any_value("size").alias("size"),
                                                 F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"), F.any_value("odd").alias("odd")))
    ranked = nodes.select("node", "rank")
    members = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("pivot")).where(
        "n > 1").select("key", F.col("pivot.node").alias("pivot"), F.col("pivot.size").alias("pivot_size")))
    # The planner does not see that a text has a row for each key, and could broadcast the members instead of many shared keys.
    met = materialize(members.join(shared if shared.count() <= BROADCAST_KEYS else shared.hint("merge"), "key"))
    sketches = materialize(nodes.select("node", "size", "odd").join(met.select("node").distinct(), "node", "left_semi"))
    close = materialize(_by_fingerprint(nodes.select("node", "size", "fp")).where(_sizes_near("a_size", "b_size", similarity)).select("a", "b"))
    links = _checked(close, rows, docs, similarity, shingle)
    labels = materialize(components(ranked, links, named_by_node=True))
    for chosen in (F.min, F.max, None):
        pairs = met.join(labels, "node").join(labels.toDF("pivot", "pivot_label"), "pivot").where(
            (F.col("label") != F.col("pivot_label")) & _sizes_near("size", "pivot_size", similarity))
        pairs = pairs.select("node", "pivot").distinct() if chosen is None else pairs.groupBy("node").agg(chosen("pivot").alias("pivot"))
        pairs = materialize(pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        found = _checked(_possible(pairs, sketches, similarity), rows, docs, similarity, shingle)
        links = materialize(links.union(found))
        labels = materialize(components(ranked, links, named_by_node=True))
    # What is in another group than its key's pivot meets one more pivot of each of `PIVOTS` parts of the key. Keys of the same crowd
    # have the same pivots, so a crowd comes together in a few links per member.
    apart = materialize(met.join(labels, "node").join(labels.toDF("pivot", "pivot_label"), "pivot").where("label != pivot_label").select(
        "key", F.col("node").alias("x"), F.col("size").alias("x_size"), F.col("label").alias("x_label")))
    parted = met.join(apart.select("key").distinct(), "key", "left_semi").groupBy("key", F.pmod(F.xxhash64(F.lit("part"), "node"), F.lit(PIVOTS)).alias("part"))
    pivots = parted.agg(F.min(F.struct(F.xxhash64("node").alias("order"), "node", "size")).alias("p")).select(
        "key", F.col("p.node").alias("node"), F.col("p.size").alias("size")).join(labels, "node")
    between = materialize(apart.join(pivots, "key").where((F.col("label") != F.col("x_label")) & _sizes_near("size", "x_size", similarity)).select(
        F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())
    links = materialize(links.union(_checked(_possible(between, sketches, similarity), rows, docs, similarity, shingle)))
    labels = materialize(components(ranked, links, named_by_node=True))
    # What still is in another group than its key's pivot meets the members of the key that are in other groups than itself and
    # that its sizes and parities do not rule out.
    labelled = met.join(labels, "node").join(labels.toDF("pivot", "pivot_label"), "pivot")
    odd = sketches.select("node", "odd")
    apart = materialize(labelled.where("label != pivot_label").join(odd, "node").select(
        "key", *[F.col(c).alias(f"x_{c}") for c in ("node", "size", "label", "odd")]))
    mixed = apart.select("key").distinct()
    others = materialize(labelled.where("node != pivot").join(mixed, "key", "left_semi").join(odd, "node").select(
        "key", *[F.col(c).alias(f"y_{c}") for c in ("node", "size", "label", "odd")]))
    meet = (F.col("x_label") != F.col("y_label")) & _could_be_alike("x", "y", similarity)
    second = materialize(apart.join(others, (apart["key"] == others["key"]) & meet).select(
        F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())
    more = _checked(second, rows, docs, similarity, shingle)
    return rows, materialize(components(ranked, links.union(more), named_by_node=True))


def representatives(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the smallest id; the columns are those of the input.

    Where rows of a group share the smallest id, or all its ids are null, the row with the smallest text
    hash stays; of rows that agree in id and text, one stays.
    """
    key = {"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)), "_h": F.xxhash64(F.coalesce("text", F.lit("")))}
    keyed = docs.withColumns(key)
    rows, labels = groups(keyed, similarity, shingle)
    placed = rows.join(labels, "node").select(
        F.col("label").alias("group"), F.struct(F.col("doc_id").isNull(), F.col("_k"), F.col("_h")).alias("row"))
    first = materialize(placed.groupBy("group").agg(F.min("row").alias("row")).select("row._k", "row._h"))
    return keyed.join(first, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).select(*docs.columns)
