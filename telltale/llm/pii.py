"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what the patterns miss.

The patterns (`base_spans`) take e-mail and IP addresses, card and telephone numbers. They lose values that stand next
to each other ("+1 (569) 555-6633 4795326016703902" is one run of 27 digits) or lack a sign. The tagger is trained in
numpy from labelled spans: windows of a bounded sample of documents (`SAMPLE` documents, `WINDOWS` windows, the
documented limits), labelled by the patterns, and the same windows with their values put side by side and written in
other ways.

A span always has a digit or an at-sign, so windows cover every such character of every whole text, with `CONTEXT`
characters around, and overlap by half where a stretch is longer than one window. Each window is decoded by Viterbi; spans
that a window cuts are left to its neighbour. All spans of a document are then reconciled at once: the
non-overlapping set with the largest total score, pattern spans fixed. An added span must be valid of its kind (four
numbers up to 255; 16 to 19 digits that pass Luhn; 8 to 15 digits; an address) and stand free, with no letter or digit
directly before or after it, so parts of longer numbers and of hexadecimal words are left alone.

Defined results: null and empty texts have no spans. Repeated rows give the same spans. Offsets are code points, the end is
exclusive. Without any pattern span in the sample nothing is added. Columns other than the id and the text are not read.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from telltale.llm.common import in_batches
from telltale.llm.crf import Tagger, encode
from telltale.session import materialize

KINDS = ("email", "ip", "card", "phone")
WIDTH, CONTEXT = 80, 20
SAMPLE, WINDOWS = 40000, 3000
ROUNDS, BATCH = 220, 64
ANCHORS = re.compile("[0-9@]+")
# Fixed patterns of the contract, in a form without useless backtracking: a run of digits is never tried from its middle.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        twice = int(d) * (1 + i % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, text: str) -> bool:
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text))
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in parts)
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def stands_free(text: str, a: int, b: int) -> bool:
    return not (a > 0 and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; a match that fails its check is dropped, without another try."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, end := found.end()))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


def windows(text: str) -> list[tuple[int, int, int, int]]:
    """Start and end of windows around every anchor, and start and end of the stretch each belongs to."""
    stretches: list[list[int]] = []
    for m in ANCHORS.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    out = []
    for a, b in stretches:
        starts = [a] if b - a <= WIDTH else [*range(a, b - WIDTH, WIDTH // 2), b - WIDTH]
        out += [(s, min(b, s + WIDTH), a, b) for s in starts]
    return out


def _labels(size: int, spans: list[Span]) -> list[int]:
    out = [0] * size
    for kind, a, b in spans:
        if not any(out[a:b]):
            out[a:b] = [2 * kind + 1, *[2 * kind + 2] * (b - a - 1)]
    return out


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """An inner label only follows the first or an inner label of its kind."""
    n = 2 * len(KINDS) + 1
    allowed, first = np.ones((n, n), bool), np.ones(n, bool)
    for kind in range(len(KINDS)):
        inner = 2 * kind + 2
        allowed[:, inner], first[inner] = False, False
        allowed[[inner - 1, inner], inner] = True
    return allowed, first


def _variants(rows: list[tuple[str, list[Span]]], draw: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """Each window with its first value alone or among others side by side, some rewritten, all labelled."""
    pool = [(k, w[a:b]) for w, spans in rows for k, a, b in spans]
    out = []
    for w, spans in rows:
        if not spans:
            continue
        a, b = min(s[1] for s in spans), max(s[2] for s in spans)
        chosen = [pool[i] for i in draw.integers(len(pool), size=draw.integers(1, 4))]
        chosen.insert(int(draw.integers(len(chosen) + 1)), next((k, w[x:y]) for k, x, y in spans))
        head, tail = w[max(0, a - 18):a], w[b:b + 18]
        head, tail = (head, tail) if (edge := draw.random()) < 0.7 else ("", tail) if edge < 0.8 else (head, "")
        text, found = head, []
        for j, (kind, value) in enumerate(chosen[:int(draw.integers(1, 4))]):
            value = "".join(str(draw.integers(10)) if c.isdigit() and draw.random() < 0.6 else c for c in value)
            if kind == 3:
                if draw.random() < 0.2:
                    value = value.replace("(", "").replace(")", "")
                if draw.random() < 0.4:  # without its sign, half of them without the country's digits too
                    bare = re.sub(r"^\+[0-9]{1,3}[\x20.-]+", "", value)
                    value = bare if draw.random() < 0.5 and valid(3, bare) else value.removeprefix("+")
            if kind == 2 and draw.random() < 0.25:
                value = "-- "[int(draw.integers(3))].join(_digits(value)[i:i + 4] for i in range(0, len(_digits(value)), 4))
            text += (" " if j else "") + value
            found.append((kind, len(text) - len(value), len(text)))
        out.append(((text + tail)[:WIDTH], [s for s in found if s[2] <= WIDTH]))
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, bound: int = WINDOWS) -> Tagger | None:
    """A tagger from windows of about `sample` documents at most, `bound` of them with a value and `bound` without."""
    every = max(1, -(-docs.count() // sample))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.pmod(F.xxhash64(F.lit("windows"), "doc_id"), F.lit(every)) == 0)

    def run(batch: pa.RecordBatch) -> dict:
        out = {"window": [], "labels": [], "marked": []}
        for text in batch.column("text").to_pylist():
            if text and ANCHORS.search(text):
                spans = base_spans(text)
                for a, b, _, _ in windows(text):
                    inside = [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b]
                    if len(inside) == sum(x < b and y > a for _, x, y in spans):  # none is cut
                        out["window"].append(text[a:b])
                        out["labels"].append(_labels(b - a, inside))
                        out["marked"].append(bool(inside))
        return out

    found = materialize(in_batches(some, run, "window string, labels array<int>, marked boolean"))
    sizes = {bool(r[0]): int(r[1]) for r in found.groupBy("marked").count().collect()}
    if not sizes.get(True):
        return None
    thin = F.when(F.col("marked"), max(1, -(-sizes[True] // bound))).otherwise(max(1, -(-sizes.get(False, 1) // bound)))
    rows = found.where(F.pmod(F.xxhash64("window"), thin) == 0).distinct().orderBy("window", F.to_json("labels")).collect()
    plain = []
    for r in rows:
        spans, labels = [], r["labels"]
        for i, x in enumerate(labels):
            if x % 2 == 1:
                j = i + 1
                while j < len(labels) and labels[j] == x + 1:
                    j += 1
                spans.append((x // 2, i, j))
        plain.append((r["window"], spans))
    return train(plain)


def train(rows: list[tuple[str, list[Span]]], rounds: int = ROUNDS) -> Tagger:
    """Adam on batches of windows, half as found and half with values side by side."""
    draw = np.random.default_rng(11)
    tagger = Tagger(2 * len(KINDS) + 1, *_rules())
    marked = [r for r in rows if r[1]]
    blank = [r for r in rows if not r[1]] or marked
    for t in range(rounds):
        third = BATCH // 3
        batch = [marked[i] for i in draw.integers(len(marked), size=third)] + [blank[i] for i in draw.integers(len(blank), size=third)]
        batch += _variants([marked[i] for i in draw.integers(len(marked), size=third)], draw)
        codes, lengths = encode([w for w, _ in batch], WIDTH)
        labels = np.zeros(codes.shape, np.int64)
        for i, (w, spans) in enumerate(batch):
            labels[i, :len(w)] = _labels(len(w), spans)[:WIDTH]
        tagger.step(codes, lengths, labels, 0.02 if t < rounds * 2 // 3 else 0.005)
    return tagger


def reconcile(found: dict[Span, float], fixed: list[Span]) -> list[Span]:
    """The set of non-overlapping spans with the largest total score that touches no fixed span."""
    taken = sorted((a, b) for _, a, b in fixed)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []

    def free(a: int, b: int) -> bool:
        i = np.searchsorted(starts, b)  # fixed spans that begin before b
        return i == 0 or reach[i - 1] <= a

    spans = sorted((s for s in found if free(s[1], s[2])), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best, take = [0.0], []
    for i, s in enumerate(spans):
        before = int(np.searchsorted(ends[:i], s[1], side="right"))
        with_it = best[before] + found[s]
        take.append((with_it > best[i], before))
        best.append(max(best[i], with_it))
    out, i = [], len(spans)
    while i:
        yes, before = take[i - 1]
        if yes:
            out.append(spans[i - 1])
        i = before if yes else i - 1
    return out


def added_spans(batch: list[str], fixed: list[list[Span]], tagger: Tagger, chunk: int = 1024) -> list[list[Span]]:
    """For each text the tagger's valid spans that touch no fixed one; windows of all texts are decoded together."""
    jobs = [(i, *w) for i, text in enumerate(batch) for w in windows(text)]
    found: list[dict[Span, float]] = [{} for _ in batch]
    for at in range(0, len(jobs), chunk):
        part = jobs[at:at + chunk]
        codes, lengths = encode([batch[i][a:b] for i, a, b, _, _ in part], WIDTH)
        labels, margins = tagger.decode(codes, lengths)
        for (i, a, b, first, last), row, margin in zip(part, labels, margins):
            x = 0
            while x < b - a:
                label = int(row[x])
                y = x + 1
                if label % 2 == 1:
                    while y < b - a and row[y] == label + 1:
                        y += 1
                    cut = (x == 0 and a > first) or (y == b - a and b < last)
                    span = (label // 2, a + x, a + y)
                    if not cut and valid(span[0], batch[i][a + x:a + y]) and stands_free(batch[i], a + x, a + y):
                        found[i][span] = max(found[i].get(span, 0.0), 1.0 + float(np.clip(margin[x:y].sum(), 0, 1e6)))
                x = y
    return [reconcile(f, own) for f, own in zip(found, fixed)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans (all, as text), n_added."""
    names = [f"n_{k}" for k in KINDS]

    def run(batch: pa.RecordBatch) -> dict:
        rows = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) if ANCHORS.search(t) else [] for t in rows]
        more = added_spans(rows, base, tagger) if tagger else [[] for _ in rows]
        out = {n: [sum(s[0] == k for s in spans) for spans in base] for k, n in enumerate(names)}
        return out | {"doc_id": batch.column("doc_id"), "spans": [written(a + b) for a, b in zip(base, more)],
                      "base_sha256": [hashlib.sha256(written(s).encode()).hexdigest() for s in base],
                      "n_added": [len(m) for m in more]}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                      "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_added long")


def redact(text: str, spans: str) -> str:
    """The text with every span (as `detect` writes them) replaced by its kind."""
    out, at = [], 0
    for kind, a, b in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: int(s[1])):
        if int(a) >= at:
            out += [text[at:int(a)], f"[{kind}]"]
            at = int(b)
    return "".join([*out, text[at:]])
