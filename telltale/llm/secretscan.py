"""Secrets in texts: all rules in one deterministic automaton, one pass over the bytes.

The rules' expressions are mirrored and compiled together (`automaton`), so the pass runs from a text's last byte to its first and
its state says which rules match from each place. Where one does, the automaton of the rules read forwards gives the
longest match; matches of a rule are leftmost and do not overlap. A match that fails its rule's check (fewer characters
than it asks for) is dropped and not tried again.

Base rules are those of the contract; the others add tokens with a fixed mark of their issuer, signed web tokens and heads of private
keys. An added span that touches a base one or an earlier added one is left out, as its characters are marked already.

Rules are over ASCII, so a match never cuts a character; offsets are code points, the end is exclusive.

Defined results: null and empty texts have no spans. Repeated rows give the same spans. Very long texts are scanned whole, in linear time;
runs of places where a rule begins are kept as stretches. An empty table gives an empty result. Columns other than doc_id and
the text are not read, whatever their names.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from telltale.llm.automaton import Automaton, compile_rules, matches, mirrored, parse
from telltale.llm.common import in_batches, texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0   # characters of the group, or of the match
    group: int = 0
    base: bool = False


# The contract's three kinds, and public formats of issuers' tokens. A run of 16 or more is the same as a run that is
# dropped below 16, as a shorter one holds no other match; the automaton then has few places to look at.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, True),
    Rule("session", r"ASIA[A-Z0-9]+", 20),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
]
Span = tuple[int, int, int]  # start, rule, end


@dataclass(frozen=True)
class Scanner:
    rules: list[Rule]
    back: Automaton    # mirrored rules, from any place
    ahead: Automaton   # rules from one place


def scanner(rules: list[Rule] = RULES) -> Scanner:
    nodes = [parse(r.pattern) for r in rules]
    return Scanner(rules, compile_rules([mirrored(n) for n in nodes], True), compile_rules(nodes, False))


def passes(rule: Rule, text: str) -> bool:
    return len(re.fullmatch(rule.pattern, text)[rule.group] if rule.group else text) >= rule.least


def spans(data: bytes, scan: Scanner) -> tuple[list[Span], list[Span]]:
    """Base spans and added ones, each by start, then rule; code points."""
    base, more = [], []
    for number, found in enumerate(matches(scan.back, scan.ahead, data, len(scan.rules))):
        rule = scan.rules[number]
        (base if rule.base else more).extend((a, number, b) for a, b in found if passes(rule, data[a:b].decode()))
    base.sort()
    added = _apart(sorted(more), base)
    if base or added:
        base, added = _points(data, base), _points(data, added)
    return base, added


def _apart(more: list[Span], base: list[Span]) -> list[Span]:
    """Spans that touch neither a base span nor one before them."""
    blocks = sorted((a, b) for a, _, b in base)
    out, i, reach = [], 0, 0
    for a, rule, b in more:
        while i < len(blocks) and blocks[i][0] < b:
            reach = max(reach, blocks[i][1])
            i += 1
        if reach <= a:
            out.append((a, rule, b))
            reach = b
    return out


def _points(data: bytes, found: list[Span]) -> list[Span]:
    """Bytes to code points, counted once along the text."""
    if not found or data.isascii():
        return found
    point, at, chars = {}, 0, 0
    for place in sorted({p for a, _, b in found for p in (a, b)}):
        chars += len(data[at:place].decode())
        point[place], at = chars, place
    return [(point[a], rule, point[b]) for a, rule, b in found]


def written(found: list[Span], rules: list[Rule] = RULES) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(found))


def detect(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_ and the kind of each base rule, base_sha256, spans (all, as text), n_added."""
    scan = scanner(rules)
    base_rules = {k: f"n_{r.kind}" for k, r in enumerate(rules) if r.base}

    def run(batch: pa.RecordBatch) -> dict:
        rows = [spans(t, scan) for t in texts(batch)]
        out = {name: [sum(s[1] == k for s in base) for base, _ in rows] for k, name in base_rules.items()}
        return out | {"doc_id": batch.column("doc_id"), "spans": [written(a + b, rules) for a, b in rows],
                      "base_sha256": [hashlib.sha256(written(a, rules).encode()).hexdigest() for a, _ in rows],
                      "n_added": [len(b) for _, b in rows]}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                      "doc_id long, " + ", ".join(f"{n} long" for n in base_rules.values()) + ", base_sha256 string, spans string, n_added long")


def masked(text: str, found: str) -> str:
    """The text with every span (as `detect` writes them) replaced by its kind; of spans that overlap the first counts."""
    out, at = [], 0
    for kind, a, b in sorted((s.split(":") for s in found.split(",") if s), key=lambda s: int(s[1])):
        if int(a) >= at:
            out += [text[at:int(a)], f"[{kind}]"]
            at = int(b)
    return "".join([*out, text[at:]])
