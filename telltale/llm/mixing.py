"""Mixing sources to target weights with Efraimidis-Spirakis keys, in DataFrame operations only.

Every source has a word budget. Whole epochs of the source come first; the rest of the budget is
filled by a weighted sample without replacement: document i draws the exponential key
-ln(u_i) / weight_i, and the documents with the smallest keys whose sizes fit the rest are taken.

The prefix sum within a source is never one window over the source, which may hold a third of all
rows. Keys are put into bins in key order, `BINS` to each doubling of the key; bins are summed (with map-side combine), the
prefix over bins finds the one bin per source in which the budget ends, and only that bin's rows
are ordered. Of documents of one weight, whatever it is, a bin holds at most one in e * `BINS`: a weight only scales the keys.

Defined results: a null text has size 0; a null source is a source of its own, the last. A source
without words has target 0. Documents of size 0 take no words. Repeated rows count each for itself;
among rows with equal keys the order is by id, then size, and rows that agree in all of these are alike.
Equal input gives equal output: draws depend on the id and the seed alone. An empty table gives an
empty mix. Very long texts are counted whole. Input columns of any name pass through `epochs`, which carries the input row as one value,
and are not read by `mix`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.llm.common import unit_draw, word_count
from telltale.session import materialize

CYCLE = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BINS = 2048


def quality_weight(text: str = "text") -> Column:
    """A document's weight in (0, 1]: the share of its characters that are not symbols or digits, at least 0.05.

    A null or empty text has weight 1: it takes no words in any case.
    """
    whole = F.length(text)
    odd = whole - F.length(F.translate(text, "#*$%&|<>0123456789{}[]=_~^@\\", ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - odd / F.when(whole > 0, whole)), F.lit(1.0))


def targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Word budget of every source: shares of all words by weight, none above max_epochs times its words.

    What a capped source cannot take is shared by weight among the rest until none is above its cap.
    That is a water level: sorted by cap / weight, a source is capped as long as the level of what
    remains lies above it. Input: source, source_size, one row per source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]),
                                                 ((F.row_number().over(every) - 1) % len(cycle) + 1)))
    cap = F.col("source_size") * F.lit(max_epochs)
    level = Window.orderBy((cap / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.select(
        "*", F.sum("source_size").over(whole).alias("_all"), F.sum("_w").over(whole).alias("_weights"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("_capped"),
        F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_gone"), cap.cast("double").alias("_cap"),
        F.row_number().over(level).alias("_at"))
    # The level if this source and all after it are open; the first source below its cap fixes it for the rest.
    filled = filled.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_gone")))
    open_level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(
        "_at", F.col("_level").alias("level")))).over(whole)["level"]
    target = F.when(open_level.isNull(), F.col("_cap")).otherwise(F.least(open_level * F.col("_w"), F.col("_cap")))
    return filled.select("source", "source_size", target.alias("target"))


def _size_and_key(weight: Column | None, seed: int) -> tuple[Column, Column]:
    draw = unit_draw(F.lit(seed), F.col("doc_id"))
    return word_count("text"), -F.log(draw) / (quality_weight() if weight is None else weight)


def _bin(key: Column) -> Column:
    """Bins in key order, even in the logarithm; keys lie between 1e-15 and 1e4, so there are some 60 * `BINS`."""
    return F.floor(F.log2(key) * BINS).cast("int")


def plan(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, target, whole epochs, the rest, and the bin in which it ends with the words before it.

    Input: source, size, bin. A source whose rest is 0 ends before its first bin.
    """
    bins = materialize(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    budgets = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    full = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    budgets = budgets.select(F.col("source").alias("_source"), "source_size", "target", full.cast("int").alias("whole"),
                             (F.col("target") - full * F.col("source_size")).alias("rest"))
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(order), F.lit(0).cast("long"))).join(
        budgets, F.col("source").eqNullSafe(F.col("_source")))
    ends = (F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest"))
    facts = [F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")]
    past = F.max(F.when(F.col("rest") > 0, F.col("bin") + 1))  # the rest takes every bin, or, if it is 0, none
    return materialize(placed.groupBy("_source").agg(
        *facts, F.coalesce(F.max(F.when(ends, F.col("bin"))), past, F.min("bin")).alias("edge"),
        F.coalesce(F.max(F.when(ends, F.col("before"))), F.lit(0)).alias("before")))


def _on_the_edge(rows: DataFrame) -> DataFrame:
    """The rows of the bins in which a budget ends, with `inside`: more than half of the document fits."""
    within = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return rows.where(F.col("bin") == F.col("edge")).withColumn(
        "inside", (F.col("rest") > 0) & (upto + F.col("size") / 2 <= F.col("rest")))


def _placed(docs: DataFrame, weight: Column | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows with their source's plan, and the plan."""
    size, key = _size_and_key(weight, seed)
    rows = materialize(docs.select("doc_id", "source", size.alias("size"), key.alias("key")))
    rows = rows.withColumn("bin", _bin(F.col("key")))
    budgets = plan(rows)
    return rows.join(budgets, F.col("source").eqNullSafe(F.col("_source"))), budgets


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (copies in the mix), taken (words)."""
    placed, _ = _placed(docs, weight, seed)
    clear = placed.where(F.col("bin") != F.col("edge")).withColumn("inside", F.col("bin") < F.col("edge"))
    out = clear.unionByName(_on_the_edge(placed))
    copies = F.col("whole") + F.col("inside").cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("epochs"),
                      (copies * F.col("size")).cast("long").alias("taken"))


def epochs(docs: DataFrame, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns are those of the input.

    Most documents lie in a bin that is in or out as a whole, so their copies follow from the plan, one row per source,
    and no text is shuffled. Only those in the bins where a budget ends are joined with their own verdicts. Rows that agree in
    source, id, size and key share a verdict; where the budget ends among them, as many of them as the mix takes once more do so.
    """
    placed, budgets = _placed(docs, weight, seed)
    alike = ["source", "doc_id", "size", "key"]
    edge = materialize(_on_the_edge(placed).groupBy(*alike).agg(
        F.min("whole").alias("whole"), F.sum(F.col("inside").cast("long")).alias("more"), F.count(F.lit(1)).alias("n")))
    size, key = _size_and_key(weight, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", "doc_id", size.alias("size"), key.alias("key"))
    kept = budgets.select("_source", F.col("whole").alias("_whole"), F.col("edge").alias("_edge"))
    rows = rows.withColumn("bin", _bin(F.col("key"))).join(kept, F.col("source").eqNullSafe(F.col("_source")))
    clear = rows.where(F.col("bin") != F.col("_edge")).select("row", (F.col("_whole") + (F.col("bin") < F.col("_edge")).cast("int")).alias("copies"))
    named = edge.withColumnsRenamed({c: f"edge_{c}" for c in alike})
    same = [F.col(c).eqNullSafe(F.col(f"edge_{c}")) for c in alike]
    last = rows.where(F.col("bin") == F.col("_edge")).join(named, same[0] & same[1] & same[2] & same[3])
    split = (F.col("more") > 0) & (F.col("more") < F.col("n"))  # at most one set of equal rows in each source
    place = F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64("row")))
    ended = last.where(split).withColumn("place", place).select("row", (F.col("whole") + (F.col("place") <= F.col("more")).cast("int")).alias("copies"))
    even = last.where(~split).select("row", (F.col("whole") + (F.col("more") > 0).cast("int")).alias("copies"))
    both = clear.unionAll(even).unionAll(ended).where("copies > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
