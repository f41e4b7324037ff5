"""SentencePiece sampling: forward filtering, backward sampling over the piece lattice.

The lattice of a text has an edge for every piece of a public vocabulary (its path is a parameter) that matches there; where a
character has no piece of its own, its bytes are edges. A piece's weight is (rank + `OFFSET`) ** -`SLOPE`: the file's scores
are merge ranks, not probabilities, and frequency falls with rank. Forward filtering sums the weights of all ways to each
place; backward sampling draws the last piece in proportion, then the one before it, so a segmentation comes up with its
exact probability. The draws are counter-based hashes of the row's key, the place and a seed, so a row is cut alike on
any cluster, in any batch, at any retry.

No piece has a space after another character, so the lattice falls apart before each run of spaces: chunks are
independent. Texts are worked on in groups of about `GROUP_BYTES` bytes, longer ones in parts that end with a chunk: distinct chunks of
a group are filtered once, all together by place; all its chunks are sampled together, one piece each per step. So a worker
holds one group's lattice, whatever the batch or the text.

Spaces stand as the vocabulary's space mark; a mark in the text itself is written in bytes. No space is put in front.
So decoding, which joins the pieces' bytes, gives back every text byte by byte.

Defined results: a null text has null pieces and stays null; an empty one has none. Repeated rows (same key) are cut alike, and
copies that follow each other are encoded once. Very long texts are cut whole. An empty table gives an empty result. Input columns pass
through `encoded`, but `pieces` and `lossless`, which it writes anew.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from telltale.llm.common import bounded_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
OFFSET, SLOPE = 50.0, 1.5
MARK = "▁"
CHUNK = re.compile(rb" *[^ ]+| +")
CUT = re.compile(rb"(?<=[^ ]) ")  # a chunk begins here
GROUP_BYTES, BLOCK = 1_000_000, 20_000  # text sampled together, distinct chunks filtered together
ONE = 1 << 32


@dataclass
class Vocabulary:
    names: list[bytes]       # bytes of each id (control pieces: none)
    byte_ids: np.ndarray     # id of each byte's piece
    log_weight: np.ndarray
    longest: int
    moves: np.ndarray        # trie: node * 256 + byte, sorted
    to: np.ndarray           # node that each move leads to
    pairs: np.ndarray        # node after each two bytes, or -1
    piece: np.ndarray        # id of the piece that ends at each node, or -1


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Read once per worker."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, byte_ids = [], np.zeros(256, np.int32)
    first = None
    moves: dict[int, int] = {}
    ends: list[int] = [-1]
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            names.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i):
            names.append(b"")
        else:
            first = i if first is None else first
            names.append(piece.replace(MARK, " ").encode())
            node = 0
            for b in names[-1]:
                if (after := moves.get(node * 256 + b)) is None:
                    after = moves[node * 256 + b] = len(ends)
                    ends.append(-1)
                node = after
            ends[node] = i
    weight = -SLOPE * np.log(np.maximum(np.arange(len(names), dtype=float) - (first or 0), 0) + OFFSET)
    weight[byte_ids] = -SLOPE * np.log(len(names) + OFFSET)
    keys = np.array(sorted(moves), np.int64)
    pairs = np.full(1 << 16, -1)
    for b in range(256):
        if (node := moves.get(b)) is not None:
            for c in range(256):
                pairs[b * 256 + c] = moves.get(node * 256 + c, -1)
    return Vocabulary(names, byte_ids, weight, max(map(len, names)), keys, np.array([moves[k] for k in keys.tolist()], np.int64),
                      pairs, np.array(ends, np.int64))


@dataclass
class Lattice:
    """Edges into each (chunk, place), in CSR form, with cumulative probabilities of backward sampling."""
    base: np.ndarray   # state of place 0 of each chunk
    sizes: np.ndarray  # bytes of each chunk
    starts: np.ndarray  # first edge of each state
    piece: np.ndarray
    back: np.ndarray   # bytes of each edge
    upto: np.ndarray   # (state + cumulative probability within the state) * ONE


# Bytes of a character by its first byte; 0 for bytes within a character.
WIDTHS = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16)


def edges(text: np.ndarray, left: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and piece of every edge of chunks written one after the other.

    `left` is how many bytes of its own chunk follow from each byte on. All places walk down the vocabulary's trie together.
    """
    at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
    alone = np.zeros(len(text), bool)  # a piece for just the character that begins here
    widths = WIDTHS[text]
    out = []
    for size in range(1, v.longest + 1):
        inside = left[at] >= size
        at, node = at[inside], node[inside]
        if not len(at):
            break
        if size == 2:
            to = v.pairs[text[at].astype(np.int64) * 256 + text[at + 1]]
            known = to >= 0
            at, node = at[known], to[known]
        else:
            key = node * 256 + text[at + size - 1]
            move = np.minimum(np.searchsorted(v.moves, key), len(v.moves) - 1)
            known = v.moves[move] == key
            at, node = at[known], v.to[move[known]]
        piece = v.piece[node]
        ends = piece >= 0
        out.append((at[ends], np.full(int(ends.sum()), size), piece[ends]))
        alone[at[ends & (widths[at] == size)]] = True
    lone = np.flatnonzero((widths > 0) & ~alone)
    spelt = np.concatenate([lone[widths[lone] > k] + k for k in range(4)])
    spelt = spelt[spelt < len(text)]
    out.append((spelt, np.ones(len(spelt), np.int64), v.byte_ids[text[spelt]].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def lattice(chunks: list[bytes], v: Vocabulary, block: int = BLOCK) -> Lattice:
    """Forward filtering of all chunks, in blocks that bound the memory of the edges at work."""
    parts, states, count = [], 0, 0
    for at in range(0, len(chunks), block):
        part = _filtered(chunks[at:at + block], v)
        parts.append(Lattice(part.base + states, part.sizes, part.starts[:-1] + count, part.piece.astype(np.int32),
                             part.back.astype(np.int32), part.upto + states * ONE))
        states, count = states + len(part.starts) - 1, count + len(part.piece)
    return Lattice(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("base", "sizes", "starts", "piece", "back", "upto")))


def _filtered(chunks: list[bytes], v: Vocabulary) -> Lattice:
    """One place of every chunk after the other."""
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(chunks)), sizes)
    start, length, piece = edges(np.frombuffer(b"".join(chunks), np.uint8), ends[owner] - np.arange(len(owner)), v)
    state = start + owner[start] + length  # each chunk before has one state more than bytes
    place = state - base[:-1][owner[start]]
    order = np.argsort(state, kind="stable")
    state, length, piece, place = state[order], length[order], piece[order], place[order]
    counts = np.bincount(state, minlength=base[-1])
    starts = np.concatenate([[0], np.cumsum(counts)])
    weight = v.log_weight[piece]
    alpha = np.full(base[-1], -np.inf)
    alpha[base[:-1]] = 0.0
    joint = np.empty(len(state))
    by_place = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(1, (int(sizes.max()) if len(sizes) else 0) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:]):  # all edges that end at this place of their chunk
        e = by_place[lo:hi]
        if len(e):
            joint[e] = alpha[state[e] - length[e]] + weight[e]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(state[e]) > 0]))
            top = np.maximum.reduceat(joint[e], heads)
            span = np.diff(np.concatenate([heads, [len(e)]]))
            total = np.add.reduceat(np.exp(joint[e] - np.repeat(top, span)), heads)
            alpha[state[e][heads]] = top + np.log(total)
    # Whole numbers: a state's thresholds don't depend on what else is in the batch.
    share = (np.exp(joint - alpha[state]) * ONE).astype(np.int64)
    run = np.cumsum(share)
    before = np.concatenate([[0], run])[starts[state]]
    upto = state * ONE + np.minimum(run - before, ONE - 1)
    last = starts[1:][counts > 0] - 1
    upto[last] = (state[last] + 1) * ONE
    return Lattice(base[:-1], sizes, starts, piece, length, upto)


def draws(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform whole numbers below `ONE` from key and place: two rounds of a 64-bit mixing function."""
    x = key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(32)).astype(np.int64)


def sample(lat: Lattice, which: np.ndarray, key: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of chunk occurrences, in order, and how many each has.

    `which` is the distinct chunk of each occurrence, `key` its row's hash, `offset` its place in the row's text.
    """
    n = len(which)
    first = lat.base[which]
    at = first + lat.sizes[which]
    live = np.arange(n)
    taken_by, taken, ends = [], [], []
    while len(live):
        here = at[live]
        u = draws(key[live], offset[live] + (here - first[live]))
        edge = np.searchsorted(lat.upto, here * ONE + u, side="right")
        taken_by.append(live)
        taken.append(lat.piece[edge])
        ends.append(here - first[live])
        at[live] = here - lat.back[edge]
        live = live[at[live] > first[live]]
    if not taken:
        return np.empty(0, np.int32), np.zeros(n, np.int64)
    by, pieces, end = map(np.concatenate, (taken_by, taken, ends))
    order = np.lexsort((end, by))
    return pieces[order].astype(np.int32), np.bincount(by, minlength=n)


def _parts(rows: list[bytes], group: int) -> Iterator[tuple[int, int, bytes]]:
    """Row, place and bytes of every text, longer ones in parts of about `group` bytes that end with a chunk."""
    for row, text in enumerate(rows):
        at = 0
        while len(text) - at > group and (cut := CUT.search(text, at + group)):
            yield row, at, text[at:cut.start()]
            at = cut.start()
        yield row, at, text[at:]


def encode_batch(rows: list[bytes], keys: np.ndarray, v: Vocabulary, group: int = GROUP_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """All rows' pieces one after the other, and how many each row has; the text is worked on in groups of bounded size."""
    pieces, counts = [], np.zeros(len(rows), np.int64)
    held: list[tuple[int, int, bytes]] = []

    def sampled() -> None:
        number: dict[bytes, int] = {}
        which, owner, offset = [], [], []
        for row, at, text in held:
            parts = CHUNK.findall(text)
            which += [number.setdefault(p, len(number)) for p in parts]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            offset.append(at + np.cumsum(sizes) - sizes)
            owner.append(np.full(len(parts), row, np.int32))
        if which:
            row = np.concatenate(owner)
            got, n = sample(lattice(list(number), v), np.fromiter(which, np.int64, len(which)), keys[row], np.concatenate(offset))
            pieces.append(got)
            counts[:] += np.bincount(row, n, minlength=len(rows)).astype(np.int64)
        held.clear()

    size = 0
    for part in _parts(rows, group):
        if size + len(part[2]) > group and held:
            sampled()
            size = 0
        held.append(part)
        size += len(part[2])
    sampled()
    return (np.concatenate(pieces) if pieces else np.empty(0, np.int32)), counts


def decode(pieces: list[int], v: Vocabulary) -> bytes:
    names = v.names
    return b"".join([names[i] for i in pieces])


def encoded(docs: DataFrame, seed: int = 0, path: str = VOCABULARY, verify: bool = False) -> DataFrame:
    """The input with `pieces`, the sampled ids, and if asked with `lossless`, whether they decode to the text.

    The row's key is its doc_id. Each group of rows is one batch of the result.
    """
    spark = docs.sparkSession
    added = {"pieces", "lossless"} if verify else {"pieces"}
    fields = [f for f in docs.schema.fields if f.name not in added]
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    target = T.StructType([*fields, T.StructField("pieces", T.ArrayType(T.IntegerType())),
                           *([T.StructField("lossless", T.BooleanType())] if verify else [])])
    arrow = to_arrow_schema(target)
    bounded_batches(spark)

    def group(rows: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
        columns = dict(zip([f.name for f in fields], rows.columns[1:]))
        text = columns["text"]
        every = [t or b"" for t in text.cast(pa.binary()).to_pylist()]
        keys = np.array(rows.column(0)).astype(np.int64).view(np.uint64)
        new = np.array([i == 0 or keys[i] != keys[i - 1] or every[i] != every[i - 1] for i in range(len(every))])
        flat, sizes = encode_batch([t for t, first in zip(every, new) if first], keys[new], v)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        own = np.cumsum(new) - 1  # the encoded text of each row
        counts = sizes[own]
        if not new.all():
            flat = np.concatenate([flat[ends[i]:ends[i + 1]] for i in own])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        null = np.array(text.is_null())
        out = [pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate([null, [False]])), pa.array(flat, pa.int32()))]
        if verify:
            out.append(pa.array([decode(flat[a:b].tolist(), v) == t for a, b, t in zip(offsets[:-1], offsets[1:], every)]))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns.values(), *out], arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column(1 + [f.name for f in fields].index("text"))), 0))
            bin_of = (np.cumsum(sizes) - sizes) // GROUP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(bin_of)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield group(batch.slice(a, b - a), vocabulary(path))

    taken = {f.name.lower() for f in fields}
    free = next(name for i in count() if (name := f"key{i}") not in taken)
    return docs.select(key.alias(free), *[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, target)


def decoded(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The input with `decoded`, the text of its pieces."""
    target = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            lists = batch.column("pieces")
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            back = [decode(flat[a:b].tolist(), v).decode() if there else None
                    for a, b, there in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())]
            columns = [batch.column(f.name) for f in arrow if f.name != "decoded"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(back, pa.string())], schema=arrow)

    return df.mapInArrow(run, target)
