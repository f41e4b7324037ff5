"""Rules compiled into one deterministic automaton: expressions over bytes, subset construction, minimisation, transition arrays.

An expression has literals, `\\xHH` and escaped characters, classes, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}`, `{m,n}` and
`(?i:...)`. Bytes that no rule tells apart share one column of the transition array.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

# An expression is ("set", bytes), ("cat", parts), ("or", parts) or ("many", part, least, most or None).
Node = tuple


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self, expected: str = "") -> str:
        ch = self.peek()
        if not ch or expected and ch != expected:
            raise ValueError(f"{self.text!r} at {self.at}: {expected or 'more'} wanted")
        self.at += 1
        return ch

    def choice(self, anycase: bool) -> Node:
        parts = [self.sequence(anycase)]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence(anycase))
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self, anycase: bool) -> Node:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom(anycase)))
        return ("cat", parts)

    def repeated(self, part: Node) -> Node:
        while self.peek() in ("?", "*", "+", "{") and self.peek():
            sign = self.take()
            if sign == "{":
                least, comma, most = self.text[self.at:self.text.index("}", self.at)].partition(",")
                self.at = self.text.index("}", self.at) + 1
                part = ("many", part, int(least), (int(most) if most else None) if comma else int(least))
            else:
                part = ("many", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def atom(self, anycase: bool) -> Node:
        ch = self.take()
        if ch == "(":
            if self.text.startswith("?i:", self.at):
                self.at, anycase = self.at + 3, True
            inner = self.choice(anycase)
            self.take(")")
            return inner
        if ch == "[":
            found = set()
            while self.peek() != "]":
                low = self.single()
                high = low
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    high = self.single()
                found.update(range(low, high + 1))
            self.take("]")
        else:
            self.at -= 1
            found = {self.single()}
        if anycase:
            found |= {ord(chr(b).swapcase()) for b in found if chr(b).isascii() and chr(b).isalpha()}
        return ("set", frozenset(found))

    def single(self) -> int:
        ch = self.take()
        if ch == "\\":
            ch = self.take()
            if ch == "x":
                self.at += 2
                return int(self.text[self.at - 2:self.at], 16)
        if not ch.isascii():
            raise ValueError(f"{self.text!r}: rules are over ASCII")
        return ord(ch)


def parse(pattern: str) -> Node:
    reader = _Reader(pattern)
    node = reader.choice(False)
    if reader.peek():
        raise ValueError(f"{pattern!r} at {reader.at}: unbalanced")
    return node


def mirrored(node: Node) -> Node:
    """The expression of the reversed strings."""
    if node[0] == "cat":
        return ("cat", [mirrored(p) for p in reversed(node[1])])
    if node[0] == "or":
        return ("or", [mirrored(p) for p in node[1]])
    return ("many", mirrored(node[1]), *node[2:]) if node[0] == "many" else node


class _Graph:
    """States with free moves and moves on byte sets."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, node: Node, start: int) -> int:
        """The end of a way from `start` that reads the expression."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start] = (node[1], end)
            out = self.state()
            self.free[end].append(out)
            return out
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            first = self.state()
            self.free[loop] += [first, end]
            self.free[self.add(part, first)].append(loop)
            return end
        for _ in range(most - least):
            first = self.state()
            self.free[start] += [first, end]
            start = self.add(part, first)
        self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self.moves[s] is not None or not self.free[s])


@dataclass
class Automaton:
    """State 0 is the start."""
    columns: bytes       # column of each byte
    width: int
    table: list[int]     # state * width + column -> state
    accept: list[int]    # bit mask of the rules that each state accepts
    live: list[int]      # bit mask of the rules that can still be accepted from there

    @cached_property
    def rows(self) -> list[list]:
        """Each state as the list of the states it moves to, then its accepted rules: a move is one look-up."""
        out: list[list] = [[] for _ in self.accept]
        for state, row in enumerate(out):
            row += [out[t] for t in self.table[state * self.width:(state + 1) * self.width]]
            row.append(self.accept[state])
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}


def compile_rules(nodes: list[Node], anywhere: bool) -> Automaton:
    """One automaton for all rules; `anywhere` lets a match begin at every byte, else it begins at the first."""
    graph = _Graph()
    start = graph.state()
    finals = {}
    for bit, node in enumerate(nodes):
        first = graph.state()
        graph.free[start].append(first)
        finals[graph.add(node, first)] = 1 << bit
    sets = {m[0] for m in graph.moves if m}
    signs: dict[tuple, int] = {}
    columns = bytes(signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256))
    width = len(signs)
    sample = [columns.index(c) for c in range(width)]  # one byte of each column
    begin = graph.closed([start])
    number, rows, todo = {begin: 0}, [], [begin]
    for state in todo:
        row = []
        for b in sample:
            after = {m[1] for s in state if (m := graph.moves[s]) and b in m[0]}
            closed = graph.closed(after) | (begin if anywhere else frozenset())
            if closed not in number:
                number[closed] = len(todo)
                todo.append(closed)
            row.append(number[closed])
        rows.append(row)
    table = np.array(rows)
    accept = np.array([sum({finals[s] for s in state if s in finals}) for state in todo])
    return _minimal(columns, table, accept)


def _minimal(columns: bytes, table: np.ndarray, accept: np.ndarray) -> Automaton:
    """States that accept the same and move alike become one: the partition by accepted rules is refined until it stands."""
    _, part = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    count = int(part.max()) + 1
    member = np.zeros(count, np.int64)
    member[part[::-1]] = np.arange(len(part))[::-1]  # the first state of each part
    moves, accepts = part[table[member]], accept[member]
    order = np.concatenate([[part[0]], np.delete(np.arange(count), part[0])])  # the start comes first
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    moves, accepts = place[moves[order]], accepts[order]
    live, before = accepts.copy(), None
    while before is None or (live != before).any():
        before = live
        live = live | np.bitwise_or.reduce(live[moves], axis=1)
    return Automaton(columns, moves.shape[1], moves.ravel().tolist(), accepts.tolist(), live.tolist())


def begins(auto: Automaton, data: bytes) -> list[tuple[int, int, int]]:
    """Stretches (first, last, rules) of places where matches begin, in order, by an automaton of mirrored rules.

    One pass over the bytes, from the last to the first: the state says which rules match from here on.
    """
    state, found, last = auto.rows[0], [], auto.width
    for at, column in enumerate(data.translate(auto.columns)[::-1]):
        state = state[column]
        if rules := state[last]:
            if found and found[-1][1] == at - 1 and found[-1][2] == rules:
                found[-1] = (found[-1][0], at, rules)
            else:
                found.append((at, at, rules))
    top = len(data) - 1
    return [(top - last, top - first, rules) for first, last, rules in reversed(found)]


def longest(auto: Automaton, data: bytes, start: int, bit: int) -> int:
    """End of the longest match of one rule that begins at `start`."""
    table, width, columns = auto.table, auto.width, auto.columns
    state, end = 0, start
    for at in range(start, len(data)):
        state = table[state * width + columns[data[at]]]
        if not auto.live[state] & bit:
            break
        if auto.accept[state] & bit:
            end = at + 1
    return end


def matches(back: Automaton, ahead: Automaton, data: bytes, n_rules: int) -> list[list[tuple[int, int]]]:
    """For each rule its leftmost, longest, non-overlapping matches in bytes."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n_rules)]
    for first, last, rules in begins(back, data):
        for rule in range(n_rules):
            if rules >> rule & 1:
                at = max(first, out[rule][-1][1] if out[rule] else 0)
                while at <= last:
                    end = longest(ahead, data, at, 1 << rule)
                    out[rule].append((at, end))
                    at = end
    return out
