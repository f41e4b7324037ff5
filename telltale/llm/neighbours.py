"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Largest inner product becomes smallest distance with one more component, sqrt(M^2 - |x|^2), M the largest norm. Vectors are
then turned by one random orthogonal matrix, so that any leading components are a fair sample of the distance. They go to the
nearest of k-means centres fitted on a bounded sample (`TRAIN` vectors, the documented limit); every vector is indexed.

A query looks into its nearest lists, as many as it takes to hold `TARGET` of the neighbours that sample vectors have within the
sample. There the components are read in column blocks of `STEP`: after d of D components
a candidate is abandoned if its partial distance, scaled by D / d, lies above the k-th best distance times
(1 + EPSILON / sqrt(d)) ^ 2, that is if a test rejects the hypothesis that it is near enough. The threshold starts with what the
query's own nearest list gave. Candidates that survive are scored exactly, on the original vectors in double precision.

Lists are cut into blocks, and the queries of a list into slices, of about the mean size of a list at most, so that a list with
a third of all vectors is many tasks of the usual size. Neither list nor query is sampled or cut short.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than
the most frequent one take no part; nor do rows without id. Rows that share an id are one candidate, with its best
score; they are no candidates of their own query. With fewer candidates than asked for, all that were found are given. Ties go to the smaller id. An
empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.llm.common import in_batches
from telltale.session import materialize

TRAIN = 20_000
MAX_LISTS = 1000
TARGET = 0.96
STEP = 16
EPSILON = 2.1
GROUP = (64, 4096)  # least and most rows of a block or slice


@dataclass
class Index:
    turn: np.ndarray     # rotation, D x D
    centres: np.ndarray  # lists x D
    reach: float         # M squared
    probes: int          # lists that a query looks into


def usable(df: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x (double components), of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=kind).reshape(rows, -1)


def _widened(x: np.ndarray, reach: float, query: bool) -> np.ndarray:
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(reach - (x * x).sum(axis=1), 0))
    return np.hstack([x, more[:, None]])


def fit(rows: DataFrame, k: int = 20, seed: int = 5) -> Index | None:
    """The index from vec_id, x: the number of lists grows with the root of the number of vectors."""
    n = rows.count()
    if not n:
        return None
    squared = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    reach = float(rows.agg(F.max(squared)).first()[0])
    thin = max(1, -(-n // TRAIN))
    got = rows.where(F.pmod(F.xxhash64(F.lit("train"), "vec_id"), F.lit(thin)) == 0).orderBy("vec_id", "x").select("x").toArrow()
    if not got.num_rows:
        got = rows.limit(1).select("x").toArrow()
    sample = _widened(_matrix(got.column("x"), got.num_rows), reach, query=False)
    draw = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(draw.standard_normal((sample.shape[1],) * 2))
    sample = (sample @ turn).astype(np.float32)
    lists = int(min(max(1, np.sqrt(n)), MAX_LISTS, len(np.unique(sample, axis=0))))
    centres = np.unique(sample, axis=0)
    centres = centres[draw.permutation(len(centres))[:lists]].copy()
    for _ in range(8):
        near = _nearest(sample, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=lists)
        for j in range(sample.shape[1]):
            centres[:, j] = np.where(counts > 0, np.bincount(near, sample[:, j], minlength=lists) / np.maximum(counts, 1), centres[:, j])
    return Index(turn, centres, reach, _probes(sample, centres, reach, turn, k, draw))


def _probes(sample: np.ndarray, centres: np.ndarray, reach: float, turn: np.ndarray, k: int, draw: np.random.Generator) -> int:
    """Lists that together hold `TARGET` of the k nearest neighbours, within the sample, of some of its vectors."""
    flat = sample.astype(np.float64) @ turn.T
    some = draw.permutation(len(flat))[:400]
    query = flat[some].copy()
    query[:, -1] = 0
    score = query @ flat.T
    score[np.arange(len(some)), some] = -np.inf
    k = min(k, len(flat) - 1)
    if k < 1 or len(centres) == 1:
        return 1
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    home = _nearest(sample, centres, 1)[:, 0]
    order = _nearest((query @ turn).astype(np.float32), centres, len(centres))
    place = np.argsort(order, axis=1)  # rank of each list for each query
    ranks = np.sort(np.take_along_axis(place, home[best], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)]) + 1


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest centres, nearest first."""
    far = (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    if k == 1:
        return far.argmin(axis=1)[:, None]
    k = min(k, len(centres))
    some = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(axis=1, kind="stable"), 1)


def _placed(rows: DataFrame, index: Index, query: bool, probes: int) -> DataFrame:
    """vec_id, x, r (turned components), lists (the nearest ones)."""
    def run(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column("x"), batch.num_rows)
        r = (_widened(x, index.reach, query) @ index.turn).astype(np.float32)
        near = _nearest(r, index.centres, probes).astype(np.int32)
        return {"vec_id": batch.column("vec_id"), "x": batch.column("x"), "r": pa.array(list(r), pa.list_(pa.float32())),
                "lists": pa.array(list(near), pa.list_(pa.int32()))}

    return in_batches(rows, run, "vec_id long, x array<double>, r array<float>, lists array<int>")


def scan(queries: pa.Table, block: pa.Table, k: int, reach: float) -> pa.Table:
    """The best k of one block for each query, by the adaptive scan."""
    ids = np.asarray(block.column("vec_id").combine_chunks())
    n, m = block.num_rows, queries.num_rows
    out_q, out_v, out_s = [], [], []
    if n and m:
        x, q = _matrix(block.column("x"), n), _matrix(queries.column("x"), m)
        columns = np.ascontiguousarray(_matrix(block.column("r"), n, np.float32).T)  # one row for each component
        turned = _matrix(queries.column("r"), m, np.float32)
        qids, bounds = np.asarray(queries.column("query_id").combine_chunks()), np.asarray(queries.column("bound").combine_chunks())
        size, norms = len(columns), (q * q).sum(axis=1)
        limits = norms + reach - 2 * bounds  # squared distance of the k-th best so far
        for at in range(0, m, 256):
            i, j = np.nonzero(qids[at:at + 256, None] != ids[None, :])
            i += at
            part = np.zeros(len(i), np.float32)
            d = 0
            while d < size and len(i):
                a, b = turned[at:at + 256, d:d + STEP], columns[d:d + STEP]
                if len(i) > m * n // 4:  # most are left: all of this column block at once
                    step = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=0)[None, :] - 2 * (a @ b)
                    part = part + step[i - at, j]
                else:
                    gap = a[i - at] - b[:, j].T
                    part = part + (gap * gap).sum(axis=1)
                d = min(size, d + STEP)
                slack = (1 + EPSILON / np.sqrt(d)) ** 2 if d < size else 1.001
                stay = part * (size / d) <= limits[i] * slack + 1e-5 * (norms[i] + reach)
                i, j, part = i[stay], j[stay], part[stay]
            if len(i):
                scores, found = (x[j] * q[i]).sum(axis=1), ids[j]
                best = np.lexsort((found, -scores, i))
                if len(ids) > len(np.unique(ids)):  # an id once, with its best score
                    best = best[np.sort(np.unique(np.stack([i[best], found[best]]), axis=1, return_index=True)[1])]
                rank = np.arange(len(best)) - np.searchsorted(i[best], i[best])
                best = best[rank < k]
                out_q.append(qids[i[best]])
                out_v.append(found[best])
                out_s.append(scores[best])
    empty = [np.empty(0)]
    return pa.table({"query_id": np.concatenate(out_q or empty).astype(np.int64), "vec_id": np.concatenate(out_v or empty).astype(np.int64),
                     "score": np.concatenate(out_s or empty).astype(np.float64)})


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the best k of each query."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, is_query: Column, index: Index, k: int = 20, probes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for every row for which `is_query` holds."""
    probes = probes or index.probes
    placed = materialize(_placed(rows, index, False, 1).select("vec_id", "x", "r", F.get("lists", 0).alias("list")))
    asked = materialize(_placed(rows.where(is_query), index, True, probes).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id", "x"]))
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    visits = asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("q"))
    plan = materialize(sizes.join(visits, "list", "left").select("list", "n", F.coalesce("q", F.lit(0)).alias("q")))
    mean = plan.agg(F.avg("n"), F.avg("q")).first()
    block, part = (int(min(max(v or 0, GROUP[0]), GROUP[1])) for v in mean)
    plan = plan.select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks"),
                       F.greatest(F.ceil(F.col("q") / part), F.lit(1)).cast("int").alias("parts"))
    cells = placed.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "block", "part", "vec_id", "x", "r")
    schema = "query_id long, vec_id long, score double"
    reach = index.reach

    def run(probed: DataFrame) -> DataFrame:
        """probed: query_id, x, r, bound, list."""
        wanted = probed.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int"))
        wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        wanted = wanted.select("list", "block", "part", "query_id", "x", "r", "bound")
        keys = ("list", "block", "part")
        return wanted.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(lambda q, b: scan(q, b, k, reach), schema)

    open_bound = F.lit(float("-inf"))
    first = materialize(run(asked.select("query_id", "x", "r", open_bound.alias("bound"), F.get("lists", 0).alias("list"))))
    bounds = materialize(_best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("bound")))
    later = asked.join(bounds, F.col("query_id") == F.col("_q"), "left").select(
        "query_id", "x", "r", F.coalesce("bound", open_bound).alias("bound"), F.explode(F.slice("lists", 2, probes)).alias("list"))
    return _best(first.unionByName(run(later)), k)
