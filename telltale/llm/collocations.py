"""Phrase collocations from a weighted de Bruijn graph.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and those into words. Per language, a node is a phrase of
three words, an edge one of four: it leads from its first three words to its last three and weighs as often as it occurs.

1. Edges. At every word the longest gram that begins there is taken: four words, or what is left of the piece. Equal ones are summed
   (in each batch, in each map task, then over the corpus), so a hot phrase costs one row a task.
2. Flow. What leaves a node is the sum of its edges; a piece that ends in the node adds its end. So the count of a shorter phrase is
   the sum of the longer grams that begin with it plus that of the pieces' ends equal to it: three words from four, two from three,
   one from two, and all words of the language from one.
3. Paths. A node through which just one edge enters and one leaves, both with the node's whole count, is inside a path; edges are put
   together along such nodes by pointer doubling. A node inside a path is contained in an edge as frequent as itself.

A first pass counts neighbouring words in `PAIR_BITS` hashed places. A phrase that holds a pair whose place counts fewer than the
minimum cannot be frequent, so grams end before such pairs, as they end with a piece. Sums of colliding pairs only let more through:
no frequent phrase is lost, whatever the size. The filter is one bit a place (8 MB for the default), at every size of the corpus.

Scores are exact: counts are longs, products decimals of 38 digits.

Defined results: a null text counts as empty, a null language as `und`, null ids do not matter. Empty texts have no piece. Repeated rows
count each for itself. Very long texts are taken whole, in slices that end with a piece; a single piece is never cut. Ties of the
lowest cut go to the shorter first part, ties in the order to the phrase by UTF-8 bytes. Empty tables give empty results. Columns other than the
text and the language are not read, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from telltale.llm.common import bounded_batches
from telltale.session import materialize

LONGEST = 4
LEAST = 30          # a candidate occurs so often
COVERED = 80        # percent of a phrase's count at which a longer one makes it superfluous
TOP = 2000
PAIR_BITS = 26
SLICE = 2_000_000   # bytes of text taken at once, but for a longer piece
SALTS = 64

# Fixed values of the contract: separators of pieces, and the two characters between words; A-Z become a-z.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LETTERS = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" ")


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(data: bytes) -> Iterator[bytes]:
    """A text (already translated) in parts that end with a piece."""
    at = 0
    while len(data) - at > SLICE:
        end = data.find(b"\n", at + SLICE)
        if end < 0:
            break
        yield data[at:end]
        at = end + 1
    yield data[at:]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and texts, put together to about `SLICE` bytes; pieces end at line ends."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            for part in _slices((text or b"").translate(_LETTERS)):
                if size.get(lang, 0) + len(part) > SLICE and held.get(lang):
                    yield lang, b"\n".join(held.pop(lang))
                    size[lang] = 0
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
                if sum(size.values()) > 2 * SLICE:  # many languages at once
                    for other in list(held):
                        yield other, b"\n".join(held.pop(other))
                    size.clear()
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def _numbered(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and the number of each in order; -1 ends a piece, also at the very end."""
    ids = _Ids({b"\n": 0, b"": 1})
    tokens = data.replace(b"\n", b" \n ").split(b" ")
    code = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    code = np.append(code[code != 1], 0) - 2
    return list(ids)[2:], np.where(code < 0, -1, code)


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _pair_places(code: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a word has a neighbour in its piece, and the pair's place in the filter."""
    at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
    first, second = hashes[code[at]], hashes[code[at + 1]]
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + (first >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return at, (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _mapped(docs: DataFrame, fn, schema: str) -> DataFrame:
    """`fn` gives the output columns for a language and some of its texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    target = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _runs(batches):
            cols = fn(lang, data)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return _narrow(docs).mapInArrow(run, target)


def pair_filter(docs: DataFrame, least: int = LEAST, bits: int = PAIR_BITS) -> bytes:
    """One bit for every place: whether the pairs hashed to it occur `least` times or more together."""
    def run(lang: str, data: bytes) -> dict:
        words, code = _numbered(data)
        place, times = np.unique(_pair_places(code, _hashes(words, lang), bits)[1], return_counts=True)
        return {"place": place, "times": times}

    sums = _mapped(docs, run, "place long, times long").groupBy("place").agg(F.sum("times").alias("times"))
    often = sums.where(F.col("times") >= least).select((F.col("place") + 1).alias("place"))  # blocks count from 1
    blocks = often.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = bytearray(max(1, (1 << bits) // 8))
    for r in blocks.toLocalIterator():  # at most 2 ** bits / 32768 blocks of 4 KB
        part = bytes(r["bits"])[:len(out)]
        out[(r["block"] - 1) * 4096:(r["block"] - 1) * 4096 + len(part)] = part
    return bytes(out)


def _grams(code: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every distinct gram a place where it begins, its words and how often it begins.

    A gram goes on as long as words are `joined` to the next, up to `LONGEST` words.
    """
    at = np.flatnonzero(code >= 0)
    reach, step = np.ones(len(code), np.int64), np.ones(len(code), bool)
    ahead = np.append(joined, [False] * LONGEST)
    for k in range(LONGEST - 1):
        step &= ahead[k:k + len(code)]
        reach += step
    size = reach[at]
    pad = np.append(code, [-1] * LONGEST)
    high = np.unique(pad[at] << 32 | np.where(size > 1, pad[at + 1] + 1, 0), return_inverse=True)[1]
    low = np.unique(np.where(size > 2, pad[at + 2] + 1, 0) << 32 | np.where(size > 3, pad[at + 3] + 1, 0), return_inverse=True)[1]
    _, first, times = np.unique(high.astype(np.int64) << 32 | low, return_index=True, return_counts=True)
    return at[first], size[first], times


def edges(docs: DataFrame, kept: bytes, bits: int = PAIR_BITS) -> DataFrame:
    """lang, gram (words joined by spaces), words, times: the longest grams that begin at each word, counted batch by batch."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)  # 2 ** bits / 8 bytes

    def run(lang: str, data: bytes) -> dict:
        words, code = _numbered(data)
        at, place = _pair_places(code, _hashes(words, lang), bits)
        table = np.frombuffer(shared.value, np.uint8)
        joined = np.zeros(len(code), bool)
        joined[at] = (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        first, size, times = _grams(code, joined)
        names = [w.decode() for w in words]
        numbers = code.tolist()
        return {"lang": [lang] * len(first), "words": size.astype(np.int32), "times": times,
                "gram": [" ".join([names[n] for n in numbers[a:a + k]]) for a, k in zip(first.tolist(), size.tolist())]}

    return _mapped(docs, run, "lang string, gram string, words int, times long")


def flow(found: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, gram, words, times of every phrase of 1 to 4 words that occurs `least` times or more, and the words of each language
    as the empty phrase. A gram gives its count to the phrase without its last word."""
    rows = found
    for k in range(LONGEST, 0, -1):
        rows = rows.groupBy("lang", "gram", "words").agg(F.sum("times").alias("times"))
        whole = F.struct("gram", "words", "times")
        shorter = F.struct(_head(k - 1).alias("gram"), F.lit(k - 1).alias("words"), F.col("times"))
        rows = rows.select("lang", F.inline(F.when(F.col("words") != k, F.array(whole)).when(
            F.col("times") >= least, F.array(whole, shorter)).otherwise(F.array(shorter))))
    return rows.groupBy("lang", "gram", "words").agg(F.sum("times").alias("times"))


def _head(words: int | Column) -> Column:
    """The first words of a gram."""
    return F.call_function("substring_index", F.col("gram"), F.lit(" "), words if isinstance(words, Column) else F.lit(words))


def _tail(words: int | Column) -> Column:
    """The last words of a gram."""
    return _head(-words)


def steps(phrases: DataFrame) -> DataFrame:
    """lang, edge, after: edges that follow each other through a node inside a path."""
    nodes = phrases.where(F.col("words") == LONGEST - 1).select("lang", F.col("gram").alias("node"), "times")
    lanes = phrases.where(F.col("words") == LONGEST).select("lang", "gram", "times")
    into = lanes.select("lang", F.col("gram").alias("edge"), _tail(LONGEST - 1).alias("node"), "times")
    out = lanes.select("lang", F.col("gram").alias("after"), _head(LONGEST - 1).alias("node"), "times")
    # An edge that has its node's whole count is the only one there, and no piece begins or ends in the node.
    return nodes.join(into, ["lang", "node", "times"]).join(out, ["lang", "node", "times"]).select("lang", "node", "edge", "after")


def paths(phrases: DataFrame, between: DataFrame) -> DataFrame:
    """lang, gram, last, place for every edge: the last edge of its path, and how many edges follow up to it."""
    lanes = phrases.where(F.col("words") == LONGEST).select("lang", "gram")
    state = materialize(lanes.join(between.select("lang", F.col("edge").alias("gram"), "after"), ["lang", "gram"], "left").select(
        "lang", "gram", F.coalesce("after", "gram").alias("last"), F.col("after").isNotNull().cast("long").alias("place")))
    while True:  # the reach doubles each round; a piece has a first edge, so no path is a circle
        ahead = state.select("lang", F.col("gram").alias("last"), F.col("last").alias("to"), F.col("place").alias("more"))
        moved = materialize(state.join(ahead, ["lang", "last"]).select("lang", "gram", F.col("to").alias("last"), (F.col("place") + F.col("more")).alias("place"),
                                                             (F.col("more") > 0).alias("going")))
        state = moved.drop("going")
        if moved.where("going").isEmpty():
            return state


def passages(phrases: DataFrame, chains: DataFrame) -> DataFrame:
    """lang, passage, words, times: every compacted path as one phrase. A path lies within one piece, so it is no longer than that."""
    word = F.struct(-F.col("place").alias("at"), F.when(F.col("place") == 0, F.col("gram")).otherwise(_head(1)).alias("text"))
    times = phrases.where(F.col("words") == LONGEST).select("lang", F.col("gram").alias("last"), "times")
    whole = chains.groupBy("lang", "last").agg(F.sort_array(F.collect_list(word)).alias("parts"))
    return whole.join(times, ["lang", "last"]).select(
        "lang", F.array_join(F.col("parts.text"), " ").alias("passage"), (F.size("parts") + LONGEST - 1).cast("long").alias("words"), "times")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, gram, words, a, l, r, n, score of every phrase of 2 words or more, by its lowest-scoring cut."""
    counts = phrases.select("lang", F.col("gram").alias("part"), "times")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = phrases.where("words > 1").select("lang", "gram", "words", F.col("times").alias("a"), cut.alias("k"))
    cuts = cuts.withColumns({"left": _head(F.col("k")), "right": _tail(F.col("words") - F.col("k"))})
    cuts = cuts.join(counts.withColumnsRenamed({"part": "left", "times": "l"}), ["lang", "left"]).join(
        counts.withColumnsRenamed({"part": "right", "times": "r"}), ["lang", "right"])
    wide = F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)")
    score = F.call_function("div", wide, (F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")))
    best = cuts.select("lang", "gram", "words", "a", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut")).groupBy(
        "lang", "gram", "words", "a").agg(F.min("cut").alias("cut"))
    totals = phrases.where("words = 0").select("lang", F.col("times").alias("n"))
    return best.join(totals, "lang").select("lang", "gram", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def kept(found: DataFrame, between: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates that no longer phrase covers. A gram within a longer one is within one of just one word more, which is as
    frequent or more; nodes inside a path go first, as an edge has their whole count."""
    open_nodes = found.join(between.select("lang", F.col("node").alias("gram")), ["lang", "gram"], "left_anti")
    inner = found.where("words > 2").select("lang", F.explode(F.array(
        _head(F.col("words") - 1), _tail(F.col("words") - 1))).alias("gram"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    wide = [F.lit(x).cast("decimal(3,0)") * F.col(c).cast("decimal(19,0)") for x, c in ((100, "longer"), (covered, "a"))]
    return open_nodes.join(most, ["lang", "gram"], "left").where(F.col("longer").isNull() | (wide[0] < wide[1])).drop("longer")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language with their rank. Each of `SALTS` parts of a language is cut to `top` before they meet."""
    order = "ORDER BY score DESC, a DESC, gram"
    part = f"pmod(xxhash64(gram), {SALTS})"
    some = found.selectExpr("*", f"row_number() OVER (PARTITION BY lang, {part} {order}) AS _place").where(F.col("_place") <= top)
    return some.selectExpr("*", f"row_number() OVER (PARTITION BY lang {order}) AS rank").where(F.col("rank") <= top).drop("_place")


def graph(docs: DataFrame, least: int = LEAST, bits: int = PAIR_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases with counts, nodes inside paths with the edges they connect, and the edges' paths; written tables."""
    phrases = materialize(flow(edges(docs, pair_filter(docs, least, bits), bits), least))
    between = materialize(steps(phrases))
    return phrases, between, paths(phrases, between)


def mined(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, bits: int = PAIR_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; path_words is the length of the compacted path that a phrase of four words lies on."""
    phrases, between, chains = graph(docs, least, bits)
    size = chains.groupBy("lang", "last").agg((F.count(F.lit(1)) + LONGEST - 1).alias("path_words"))
    lengths = chains.join(size, ["lang", "last"]).select("lang", "gram", "path_words")
    best = ranked(kept(scored(phrases), between, covered), top)
    return best.join(lengths, ["lang", "gram"], "left").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", "n", "score",
        F.coalesce("path_words", F.col("words").cast("long")).alias("path_words"))
