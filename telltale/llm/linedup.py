"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines (cut at newlines) of at least `min_chars` characters that repeat across the corpus keep their
first place, by doc_id and line number. Lines of at least `near_chars` characters also go if an earlier
place has a line within `threshold` edits of theirs.

The join: a line of length l is cut into threshold + 1 segments of even length, the longer ones last. Of
two lines within the threshold, the longer holds some segment of the shorter unchanged, shifted by a bounded
number of places. So each line is indexed under (l, segment number, segment) and probes, for each
length l from its own down to that less the threshold, the substrings that the multi-match rule leaves (12 for the
threshold 2). Index and probes meet by the hash of that key, and carry the counts of eleven letters. An edit moves these by two in sum at most, so most strangers with a common segment part within the join. What is left is verified on the whole lines by a banded bit-parallel automaton: one
bit mask per error count over the 2 * threshold + 1 diagonals, moved on by one character a step.

Only distinct lines are indexed, so a line that is everywhere costs one entry. Lines are told apart by
128 bits of hash. Verified links alone are written; no pairs of copies are formed.

Defined results: a null text counts as empty and stays null; short lines are never removed. Ids order nulls last;
places that share id and line number (repeated rows, or null ids) are ties, and all of them stay if they are the
first. A document all of whose lines go is kept with an empty text. Empty tables give empty results.
Very long texts and lines are taken whole.
Input columns must not be named `_id`, `_h` or `_gone`; others pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telltale.session import materialize

THRESHOLD = 2
MIN_CHARS = 16
NEAR_CHARS = MIN_CHARS  # every line that an exact copy can remove takes part in the edit join
COUNTED = "eantiorsdhl"
BROADCAST_ROWS = 1_000_000  # 8-byte ids: a side counted below this is at most some 30 MB; a larger one is shuffled


def _place(doc_id: Column, line: Column) -> Column:
    """Id and line number as one number; a decimal stays in a hash aggregate, where a struct forces a sort."""
    return (F.coalesce(doc_id, F.lit(2 ** 63 - 1)).cast("decimal(20,0)") * F.lit(2 ** 32).cast("decimal(11,0)")
            + line.cast("decimal(10,0)")).cast("decimal(32,0)")


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, pos (from 0), line, size, h1, h2, place for every line that is long enough."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                       F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("size", F.char_length("line")).where(F.col("size") >= min_chars)
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"),
                       _place(F.col("doc_id"), F.col("pos")).alias("place"))


def segments(length: Column, threshold: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each segment of a line of that length."""
    parts = threshold + 1
    size, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    out = []
    for i in range(parts):
        more = F.greatest(i + longer - parts, F.lit(0))  # longer segments before this one
        out.append((size * i + more + 1, size + F.when(i + longer >= parts, 1).otherwise(0)))
    return out


def shifts(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every substring to probe; those of (0, i, 0) are the index keys."""
    return [(d, i, s) for d in range(threshold + 1) for i in range(threshold + 1)
            for s in range(max(-i, d - (threshold - i)), min(i, d + threshold - i) + 1)]


def _with_keys(rows: DataFrame, line: str, length: str, threshold: int) -> DataFrame:
    """The probe keys of a line, one column for each of `shifts`.

    Where segments start is a step of its own, so that it is computed once and the code of the keys stays small enough
    for the JVM to compile it.
    """
    starts = {f"_{d}_{i}": segments(F.col(length) - d, threshold)[i][0] for d in range(threshold + 1) for i in range(1, threshold + 1)}
    keys = {}
    for d, i, s in shifts(threshold):
        start = F.col(f"_{d}_{i}") if i else F.lit(1)
        end = F.col(f"_{d}_{i + 1}") if i < threshold else F.col(length) - d + 1
        keys[f"k{d}_{i}_{s}"] = F.xxhash64(F.lit(i), F.col(length) - d, F.substring(F.col(line), start + s, end - start))
    return rows.withColumns(starts).withColumns(keys).drop(*starts)


def _with_letters(rows: DataFrame, line: str) -> DataFrame:
    """`letters`: the counts of eleven letters, modulo 32, in one long; its top bits are 0.

    Each letter is taken out of what the ones before it left, and bytes tell how many went; a step of its own for each
    letter keeps what is left from being computed again.
    """
    left, counts = F.col(line), F.lit(0).cast("long")
    for j, ch in enumerate(COUNTED):
        rows = rows.withColumn("_left", left) if j == 0 else rows
        rows = rows.withColumns({"_less": F.replace("_left", F.lit(ch), F.lit(""))})
        gone = (F.octet_length("_left") - F.octet_length("_less")) % 32
        rows = rows.withColumns({"_left": F.col("_less"), "letters": (counts if j == 0 else F.col("letters")).bitwiseOR(F.shiftleft(gone.cast("long"), 5 * j))})
    return rows.drop("_left", "_less")


def _letters_near(a: str, b: str, threshold: int) -> Column:
    """An edit changes at most two counts, by one each."""
    total = F.lit(0).cast("long")
    for j in range(len(COUNTED)):
        gap = (F.shiftright(a, 5 * j).bitwiseAND(F.lit(31)) - F.shiftright(b, 5 * j).bitwiseAND(F.lit(31)) + 32) % 32
        total = total + F.least(gap, 32 - gap)
    return total <= 2 * threshold


def within_edits(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """True if at most `threshold` insertions, deletions and substitutions turn a into b.

    After i characters of b, bit k of mask e says that a's first i + k - threshold characters are reached with at most
    e errors. A step takes matches (same bit), substitutions (same bit, one error less), characters only b has (next
    bit) and characters only a has (previous bit of the new mask); all diagonals move at once.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1

    def equal(pattern: Column, ch: Column, i: Column) -> Column:
        bits = F.lit(0)
        for k in range(width):
            bits = bits + F.when(F.get(pattern, i + (k - threshold)) == ch, 1 << k).otherwise(0)
        return bits

    def step(state: Column, same: Column) -> Column:
        masks, previous = [], None
        for e in range(threshold + 1):
            own = state[f"m{e}"].bitwiseAND(same)
            if e:
                less = state[f"m{e - 1}"]
                own = own.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(previous, 1)).bitwiseAND(F.lit(full))
            masks.append(own.alias(f"m{e}"))
            previous = own
        return F.struct(*masks)

    start = F.struct(*[F.lit(sum(1 << (threshold + j) for j in range(e + 1))).alias(f"m{e}") for e in range(threshold + 1)])
    gap = F.char_length(a) - F.char_length(b)
    goal = F.get(F.array(*[F.lit(1 << k) for k in range(width)]), (gap + threshold).cast("int"))

    def run(pair: Column) -> Column:  # bound to a variable, so the lines are cut into characters once
        same = F.transform(pair["text"], lambda ch, i: equal(pair["pattern"], ch, i))
        return F.aggregate(same, start, step, lambda s: s[f"m{threshold}"])

    cut = F.struct(F.split(a, "").alias("pattern"), F.split(b, "").alias("text"))
    last = F.get(F.transform(F.array(cut), run), 0)
    return F.when(F.abs(gap) > threshold, False).when((F.length(a) == 0) | (F.length(b) == 0), True).otherwise(
        last.bitwiseAND(goal) != 0)


def facts(found: DataFrame, threshold: int = THRESHOLD, near_chars: int = NEAR_CHARS) -> DataFrame:
    """One row per distinct line: h1, h2, first place, how often, letter counts (null if the line is short) and probe keys."""
    keyed = _with_keys(_with_letters(found, "line"), "line", "size", threshold)
    keyed = keyed.withColumn("letters", F.when(F.col("size") >= near_chars, F.col("letters"))).drop(
        "doc_id", "text_hash", "pos", "line", "size")
    names = [c for c in keyed.columns if c not in ("h1", "h2", "place")]
    return keyed.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times"),
                                         *[F.min(c).alias(c) for c in names])


def candidates(known: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs of lines (by h1) that share a segment of the shorter line and could be within the threshold, each once.

    The planner does not see how many rows an array gives, and would broadcast the probes of a small table; the hint has both
    sides shuffled at every size.
    """
    names = {s: f"k{s[0]}_{s[1]}_{s[2]}" for s in shifts(threshold)}
    near = known.where(F.col("letters").isNotNull())
    index = near.select(F.explode(F.array(*[names[(0, i, 0)] for i in range(threshold + 1)])).alias("key"), F.col("h1").alias("a"), F.col("letters").alias("la")).hint("merge")
    # The top bits of a probe say whether it is for its own length: then one of the two directions is enough.
    own = F.lit(1 << 60).cast("long")
    probes = near.select(F.inline(F.array(*[
        F.struct(F.col(n).alias("key"), F.col("h1").alias("b"), (F.col("letters") + own if s[0] == 0 else F.col("letters")).alias("lb"))
        for s, n in names.items()])))
    once = F.when(F.col("lb") >= own, F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    pairs = index.join(probes, (index["key"] == probes["key"]) & once & _letters_near("la", "lb", threshold))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(found: DataFrame, known: DataFrame, threshold: int = THRESHOLD, near_chars: int = NEAR_CHARS) -> DataFrame:
    """Verified links both ways: h1, h2 of a line, and the first place of a different line within the threshold."""
    pairs = materialize(candidates(known, threshold))
    wanted = materialize(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct())
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    named = found.where(F.col("size") >= near_chars)
    whole = materialize(named.join(wanted, "h1", "left_semi").groupBy("h1", "h2", "line").agg(F.min("place").alias("first")))
    left = whole.select(F.col("h1").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("h1", "h2", "line", "first")])
    right = whole.select(F.col("h1").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("h1", "h2", "line", "first")])
    both = pairs.join(left, "a").join(right, "b").where(within_edits(F.col("a_line"), F.col("b_line"), threshold))
    good = materialize(both.select(*[f"{s}_{c}" for s in "ab" for c in ("h1", "h2", "first")]).distinct())
    return good.select(F.col("a_h1").alias("h1"), F.col("a_h2").alias("h2"), F.col("b_first").alias("other")).unionAll(
        good.select("b_h1", "b_h2", "a_first"))


def verdicts(found: DataFrame, threshold: int = THRESHOLD, near_chars: int = NEAR_CHARS) -> DataFrame:
    """One row per distinct line that repeats or has a link: h1, h2, first (place), other (first linked place), n_links."""
    known = materialize(facts(found, threshold, near_chars))
    linked = links(found, known, threshold, near_chars).groupBy("h1", "h2").agg(
        F.min("other").alias("other"), F.count(F.lit(1)).alias("n_links"))
    linked = materialize(linked).withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    joined = known.select("h1", "h2", "first", "times").join(
        linked, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return joined.where("times > 1 OR n_links IS NOT NULL").select(
        "h1", "h2", "first", "other", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def removals(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, text_hash, pos, n_links, exact, near of every line that repeats or has a link; it goes if exact or near."""
    found = lines(docs, min_chars)
    judged = materialize(verdicts(found, threshold, near_chars)).withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    placed = found.select("doc_id", "text_hash", "pos", "h1", "h2", "place").join(
        judged, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    return placed.select("doc_id", "text_hash", "pos", "n_links", (F.col("place") > F.col("first")).alias("exact"),
                         ((F.col("place") == F.col("first")) & F.coalesce(F.col("other") < F.col("first"), F.lit(False))).alias("near"))


def report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_exact and n_near (lines that go), n_links of its lines to different lines."""
    gone = removals(docs, threshold, min_chars, near_chars).distinct().groupBy("doc_id", "text_hash").agg(
        F.sum(F.col("exact").cast("long")).alias("n_exact"), F.sum(F.col("near").cast("long")).alias("n_near"),
        F.sum("n_links").alias("n_links"), F.count(F.lit(1)).alias("_n"))
    gone = gone.withColumnsRenamed({"doc_id": "_id", "text_hash": "_h"})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                      F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    zero = F.lit(0).cast("long")
    return own.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")), "left").select(
        "doc_id", "n_lines", *[F.coalesce(c, zero).alias(c) for c in ("n_exact", "n_near", "n_links")])


def dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """The documents without the lines that go; all other columns as they were."""
    gone = removals(docs, threshold, min_chars, near_chars).where("exact OR near").groupBy(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg(F.collect_set("pos").alias("_gone"))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
                       & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("text", text).select(*docs.columns)
