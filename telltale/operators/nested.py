"""Leave-one-group-out and nested validation of ridge candidates from sums of each group, in one pass over the rows.

A ridge fit needs only the sums of its training rows: their number, and the sums of x, y, x x', x y and y y. So every group is summed
once, the sums of a training set are the whole less those of the groups left out, and the squared error on a left-out group
follows from its own sums. No row is copied, however many groups are left out. Features are scaled by mean and deviation of the
training rows alone; these come from the same sums.

Nested selection leaves out every pair of groups. Groups are dealt into blocks of about `BLOCK`, a task meets two blocks and
gives one partial sum for each outer group and candidate, so no pair is written. The fit without two groups serves both of them, so
two blocks meet once. The pairs stay quadratic in the number of groups; a pair costs some thirty operations on long vectors for a
candidate of at most one feature, and a small system of equations for one of more.

Rows with a null or NaN group, feature or target take no part. A feature without deviation in the training rows has no weight.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from telltale.session import materialize

BLOCK = 1024
TILE = 16_384  # pairs that are computed at a time
PLACES = 400   # partitions that pairs of blocks are dealt to, at least if there are as many
Candidates = dict[str, tuple[list[str], float]]  # features and penalty


def group_sums(df: DataFrame, group: str, features: list[str], target: str) -> DataFrame:
    """group, s: number of rows, sums of (x, y) and of the products of each two of them, about the overall means."""
    names = [*features, target]
    rows = df.select(F.col(group).alias("group"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    means = rows.agg(*[F.avg(f"v{i}") for i in range(len(names))]).first()
    v = [F.col(f"v{i}") - F.lit(m) for i, m in enumerate(means)]
    sums = [F.count(F.lit(1)).cast("double"), *[F.sum(x) for x in v], *[F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))]]
    parts = rows.groupBy("group").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
    return materialize(parts.select("group", F.array(*[f"s{i}" for i in range(len(sums))]).alias("s")))


def _split(s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, sums and symmetric product sums of `size` variables; leading axes are kept."""
    upper = np.triu_indices(size)
    products = np.zeros((*s.shape[:-1], size, size))
    products[..., upper[0], upper[1]] = s[..., 1 + size:]
    products[..., upper[1], upper[0]] = s[..., 1 + size:]
    return s[..., 0], s[..., 1:1 + size], products


def errors(training: np.ndarray, held: np.ndarray, size: int, used: list[int], penalty: float) -> np.ndarray:
    """Mean squared error on the held-out sums of a ridge fit on the training sums, for each row of both."""
    n, total, products = _split(training, size)
    mean = total / n[:, None]
    centred = products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    deviation = np.sqrt(np.maximum(np.diagonal(centred, axis1=1, axis2=2) / n[:, None], 0))
    weights = np.zeros((len(n), size - 1))
    if used:
        sd = deviation[:, used]
        scale = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
        gram = centred[:, used][:, :, used] * scale[:, :, None] * scale[:, None, :]
        gram[:, range(len(used)), range(len(used))] += penalty + (scale == 0)
        right = centred[:, used, -1] * scale
        weights[:, used] = np.linalg.solve(gram, right[:, :, None])[:, :, 0] * scale
    intercept = mean[:, -1] - (weights * mean[:, :-1]).sum(axis=1)
    m, own, square = _split(held, size)
    line = np.concatenate([-weights, np.ones((len(n), 1))], axis=1)  # y - w x - b
    return (np.einsum("ni,nij,nj->n", line, square, line) - 2 * intercept * (line * own).sum(axis=1) + m * intercept ** 2) / m


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("s")
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(table.num_rows, -1)


def _prepared(df: DataFrame, group: str, target: str, candidates: Candidates) -> tuple[DataFrame, np.ndarray, list, int]:
    features = sorted({f for used, _ in candidates.values() for f in used})
    sums = group_sums(df, group, features, target)
    size = len(features) + 1
    whole = sums.agg(*[F.sum(F.get("s", i)) for i in range(1 + size + size * (size + 1) // 2)]).first()
    plan = [([features.index(f) for f in used], float(penalty)) for used, penalty in candidates.values()]
    return sums, np.array([x or 0.0 for x in whole], float), plan, size


def left_out_errors(df: DataFrame, group: str, target: str, candidates: Candidates) -> DataFrame:
    """group, name, rows, error: every candidate on every group, fitted on all others; one row for each."""
    return _left_out(*_prepared(df, group, target, candidates), candidates).withColumnRenamed("group", group)


def _left_out(sums: DataFrame, whole: np.ndarray, plan: list, size: int, candidates: Candidates) -> DataFrame:
    names = list(candidates)
    kind = sums.schema["group"].dataType
    schema = T.StructType([T.StructField("group", kind), T.StructField("name", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("error", T.DoubleType())])

    def run(batches):
        for batch in batches:
            held = _matrix(batch)
            some = whole[0] - held[:, 0] > 0.5  # there are rows to learn from
            for name, (used, penalty) in zip(names, plan):
                if some.any():
                    yield pa.RecordBatch.from_arrays([
                        batch.column("group").filter(pa.array(some)), pa.array([name] * int(some.sum())), pa.array(held[some, 0].astype(np.int64)),
                        pa.array(errors(whole - held[some], held[some], size, used, penalty))], names=["group", "name", "rows", "error"])

    return sums.mapInArrow(run, schema)


def _places(size: int, feature: int | None) -> list[int]:
    """Where the sums of y, y y and, for a feature x, of x, x x and x y stand among those of a group."""
    at = {pair: 1 + size + i for i, pair in enumerate(zip(*np.triu_indices(size)))}
    y = size - 1
    return [1 + y, at[y, y]] + ([] if feature is None else [1 + feature, at[feature, feature], at[feature, y]])


def _line_errors(left: np.ndarray, right: np.ndarray, whole: np.ndarray, size: int, used: list[int], penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """For each left and right group, fitted without both, with at most one feature: the error on the right one, on the left one."""
    at = _places(size, used[0] if used else None)
    n1, n2 = left[:, :1], right[:, 0]
    mine, others = [left[:, i, None] for i in at], [right[:, i] for i in at]
    n, y = whole[0] - n1 - n2, whole[at[0]] - mine[0] - others[0]
    if not used:
        b = y / n
        return tuple((own[1] - 2 * b * own[0]) / m + b * b for m, own in ((n2, others), (n1, mine)))
    x, xx, xy = (whole[at[i]] - mine[i] - others[i] for i in (2, 3, 4))
    spread = xx - x * x / n
    flat = ~(spread > 1e-24 * n)
    w = (xy - x * y / n) * n / (np.where(flat, 1.0, spread) * (n + penalty))
    w[flat] = 0.0
    b = (y - w * x) / n
    return tuple((own[1] - 2 * b * own[0] + w * (w * own[3] + 2 * (b * own[2] - own[4]))) / m + b * b for m, own in ((n2, others), (n1, mine)))


def _pair_errors(left: np.ndarray, right: np.ndarray, whole: np.ndarray, size: int, used: list[int], penalty: float,
                 itself: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """As `_line_errors`, for any number of features; what it gives for the pairs of a group with `itself` has no meaning."""
    if len(used) < 2:
        return _line_errors(left, right, whole, size, used, penalty)
    shape = len(left), len(right)
    mine, others = np.repeat(left, shape[1], axis=0), np.tile(right, (shape[0], 1))
    if itself:
        others[itself[0] * shape[1] + itself[1]] = 0
    training = whole - mine - others
    return tuple(errors(training, held, size, used, penalty).reshape(shape) for held in (others, mine))


def nested_choice(df: DataFrame, group: str, target: str, candidates: Candidates, block: int = BLOCK) -> DataFrame:
    """group, selected, inner_error, error: the candidate that is best on all other groups, and its error on this one.

    The inner error of a candidate is the mean, over all other groups, of its error there, fitted without both. Ties go to the
    candidate that is declared first.
    """
    sums, whole, plan, size = _prepared(df, group, target, candidates)
    count = sums.count()
    if count < 3:
        raise ValueError("Nested validation needs at least three distinct groups.")
    blocks = math.ceil(count / block)
    placed = sums.withColumn("own", F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int"))
    outer = placed.select("group", "s", F.col("own").alias("a"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("b"))
    inner = placed.select("group", "s", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("a"), F.col("own").alias("b"))
    # Few bytes, but long work: every pair of blocks is worth a place of its own.
    width = min(blocks * (blocks + 1) // 2, max(df.sparkSession.sparkContext.defaultParallelism * 8, PLACES))
    outer, inner = outer.repartition(width, "a", "b"), inner.repartition(width, "a", "b")
    kind = sums.schema["group"].dataType
    schema = T.StructType([T.StructField("group", kind), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, others = _matrix(left), _matrix(right)
        if not len(mine) or not len(others):
            return pa.table([left.column("group").slice(0, 0), pa.array([], pa.list_(pa.float64()))], names=["group", "total"])
        ids, other_ids = left.column("group").to_pylist(), right.column("group").to_pylist()
        place = {g: i for i, g in enumerate(other_ids)}
        same = ids[0] in place  # a block with itself
        totals, back = np.zeros((len(plan), len(mine))), np.zeros((len(plan), len(others)))
        step = max(1, TILE // len(others))
        for at in range(0, len(mine), step):
            some = mine[at:at + step]
            itself = (np.arange(len(some)), np.array([place[g] for g in ids[at:at + step]])) if same else None
            for k, (used, penalty) in enumerate(plan):
                with np.errstate(divide="ignore", invalid="ignore"):
                    right_error, left_error = _pair_errors(some, others, whole, size, used, penalty, itself)
                if same:
                    right_error[itself] = 0.0
                else:
                    back[k] += left_error.sum(axis=0)
                totals[k, at:at + step] = right_error.sum(axis=1)
        out = np.concatenate([totals.T, np.zeros((0, len(plan))) if same else back.T])
        return pa.table([pa.array(ids + ([] if same else other_ids), left.schema.field("group").type), pa.array(out.tolist(), pa.list_(pa.float64()))],
                        names=["group", "total"])

    met = outer.groupBy("a", "b").cogroup(inner.groupBy("a", "b")).applyInArrow(meet, schema)
    # The candidates' sums are added in the same order, so equal ones stay equal.
    scores = met.groupBy("group").agg(*[F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(len(plan))])
    ranked = F.array_min(F.array(*[F.struct((F.col(f"t{k}") / (count - 1)).alias("score"), F.lit(k).alias("place")) for k in range(len(plan))]))
    best = scores.select("group", ranked.alias("best"))
    names = F.array(*[F.lit(n) for n in candidates])
    chosen = best.select(F.col("group").alias(group), F.get(names, F.col("best.place")).alias("selected"), F.col("best.score").alias("inner_error"))
    held = _left_out(sums, whole, plan, size, candidates).select(F.col("group").alias(group), F.col("name").alias("selected"), "error")
    return chosen.join(held, [group, "selected"]).select(group, "selected", "inner_error", "error")
