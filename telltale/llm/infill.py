"""Fill-in-middle: a text is cut into prefix, middle and suffix and written in an order that lets a model learn to fill gaps.

Units are a word with the white space before it, or white space at the end. One fullmatch of `(unit)*` by the regex library
keeps every repetition of its group, so `ends(1)` of that one match gives the number of units and both cuts; nothing is
matched again. The quantifiers are possessive: the match runs once through the text and keeps no way back.

Cuts and form come from the SHA-256 of seed and id, so a document is written alike on any cluster, at any retry. A text that
already contains one of the three marks stays plain, which makes every written form invertible (`restored`).

Defined results: a null text counts as empty; an empty text has no unit and stays plain. A null id counts as an empty number.
Repeated rows are written alike. Very long texts are cut whole; one text at a time is matched, with its units' offsets in memory.
An empty table gives an empty result. Columns other than doc_id and the text are not read, whatever their names.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from telltale.llm.common import in_batches

SEED = 42
PLAIN, SPM = 50, 80  # percent of texts that are cut; percent of those in the order suffix, prefix, middle
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
UNITS = regex.compile(f"({UNIT})*+")
P, S, M = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Written:
    n: int
    form: str
    prefix: int | None  # code points
    middle: int | None
    output: str


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))


def write(text: str, doc_id: int | None, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> Written:
    """One document in the form that its id draws."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    first, second, whether, order = draws(doc_id, seed)
    if not n or whether % 100 >= plain or P in text or S in text or M in text:
        return Written(n, "plain", None, None, text)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    if order % 100 < spm:
        return Written(n, "spm", a, b - a, f"{S}{text[b:]}{P}{text[:a]}{M}{text[a:b]}")
    return Written(n, "psm", a, b - a, f"{P}{text[:a]}{S}{text[b:]}{M}{text[a:b]}")


def restored(output: str, form: str) -> str:
    """The text from what `write` made of it. Its parts hold no mark, so the first of each kind is the separator."""
    if form == "plain":
        return output
    head, _, middle = output[len(P):].partition(M)
    one, _, two = head.partition(S if form == "psm" else P)
    return one + middle + two if form == "psm" else two + middle + one


def transformed(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output, the written text."""
    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_pylist()
        out = [write(t or "", i, seed, plain, spm) for t, i in zip(batch.column("text").to_pylist(), ids)]
        return {"doc_id": ids, "n": [w.n for w in out], "form": [w.form for w in out], "prefix_chars": [w.prefix for w in out],
                "middle_chars": [w.middle for w in out], "output": [w.output for w in out]}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                      "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def inverted(rows: DataFrame) -> DataFrame:
    """The rows of `transformed` with `restored`, the text rebuilt from output and form alone."""
    rest = [f for f in rows.schema.fields if f.name != "restored"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", restored string"

    def run(batch: pa.RecordBatch) -> dict:
        texts = [restored(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
        return {f.name: batch.column(f.name) for f in rest} | {"restored": texts}

    return in_batches(rows.select([f.name for f in rest]), run, schema)
