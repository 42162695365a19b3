"""Regular expressions over bytes, compiled to minimal deterministic automata.

The accepted syntax: literals, escapes (\\n \\t \\r \\xHH and escaped punctuation), classes with
ranges and negation, groups, |, and the quantifiers * + ? {n} {n,} {n,m}. (?i) at the
start folds ASCII letters.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

Node = tuple  # ("set", frozenset) | ("cat", [..]) | ("alt", [..]) | ("rep", node, low, high or None)


class Parser:
    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.text, self.at = pattern[4 * self.fold :], 0

    def parse(self) -> Node:
        node = self._alt()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at}")
        return node

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError("pattern ends early")
        self.at += 1
        return self.text[self.at - 1]

    def _alt(self) -> Node:
        parts = [self._cat()]
        while self._peek() == "|":
            self._take()
            parts.append(self._cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _cat(self) -> Node:
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeat(self._atom()))
        return ("cat", parts)

    def _repeat(self, node: Node) -> Node:
        while (c := self._peek()) and c in "*+?{":
            self._take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def _atom(self) -> Node:
        c = self._take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self._alt()
            if self._take() != ")":
                raise ValueError("group not closed")
            return node
        if c == "[":
            return ("set", self._class())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self._folded({self._escape() if c == "\\" else ord(c)}))

    def _escape(self) -> int:
        c = self._take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def _class(self) -> frozenset[int]:
        negate = self._peek() == "^"
        self.at += negate
        found: set[int] = set()
        first = True
        while first or self._peek() != "]":
            first = False
            a = self._take()
            low = self._escape() if a == "\\" else ord(a)
            high = low
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self._take()
                b = self._take()
                high = self._escape() if b == "\\" else ord(b)
            found.update(range(low, high + 1))
        self._take()
        found = set(self._folded(found))
        return frozenset(set(range(256)) - found if negate else found)

    def _folded(self, codes: set[int]) -> frozenset[int]:
        if self.fold:
            codes = codes | {c ^ 32 for c in codes if 65 <= c & ~32 <= 90}
        return frozenset(codes)


def backwards(node: Node) -> Node:
    """A node for the reversed language."""
    if node[0] == "cat":
        return ("cat", [backwards(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [backwards(x) for x in node[1]])
    return ("rep", backwards(node[1]), *node[2:]) if node[0] == "rep" else node


class Nfa:
    """Thompson's construction; several rules may share one machine."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node: Node, a: int) -> int:
        """Build node from state a; returns its end state."""
        kind = node[0]
        if kind == "set":
            b = self.state()
            self.moves[a].append((node[1], b))
            return b
        if kind == "cat":
            for x in node[1]:
                a = self.add(x, a)
            return a
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                start = self.state()
                self.empty[a].append(start)
                self.empty[self.add(x, start)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            a = self.add(inner, a)
        if high is None:
            start, end = self.state(), self.state()
            self.empty[a] += [start, end]
            b = self.add(inner, start)
            self.empty[b] += [start, end]
            return end
        end = self.state()
        self.empty[a].append(end)
        for _ in range(high - low):
            a = self.add(inner, a)
            self.empty[a].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass
class Dfa:
    """Transition array: next state = table[state * 256 + byte]; states from `accepting` on accept."""

    table: list[int]
    accepts: list[int]  # bit r of accepts[state]: rule r ends here
    accepting: int
    start: int
    dead: int  # -1 if there is none


def compile_rules(nodes: list[Node], anchored: bool) -> Dfa:
    """Subset construction and minimisation of all rules at once. Not anchored: a match may begin at any byte."""
    nfa = Nfa()
    root = nfa.state()
    ends = {}
    for r, node in enumerate(nodes):
        start = nfa.state()
        nfa.empty[root].append(start)
        ends[nfa.add(node, start)] = r
    # bytes that no class tells apart share a column
    seen: dict[tuple, int] = {}
    classes = list(dict.fromkeys(s for ms in nfa.moves for s, _ in ms))
    column = [seen.setdefault(tuple(b in s for s in classes), len(seen)) for b in range(256)]
    sample = {c: b for b, c in enumerate(column)}
    # closure of what each state reaches by a byte of each class
    moves = [[nfa.closure([t for chars, t in ms if sample[c] in chars]) for c in range(len(seen))] for ms in nfa.moves]
    begin = nfa.closure([root])
    number, rows, todo = {begin: 0}, [], deque([begin])
    while todo:
        states = todo.popleft()
        row = []
        for c in range(len(seen)):
            to = frozenset().union(*[moves[s][c] for s in states], frozenset() if anchored else begin)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    marks = [sum(1 << r for e, r in ends.items() if e in states) for states in number]
    block = _minimise(rows, marks)
    # accepting blocks last, so that one comparison finds them
    firsts = {b: i for i, b in reversed(list(enumerate(block)))}
    order = sorted(firsts, key=lambda b: (marks[firsts[b]] != 0, firsts[b]))
    place = {b: k for k, b in enumerate(order)}
    table, accepts = [], []
    for b in order:
        row = [place[block[t]] for t in rows[firsts[b]]]
        table += [row[c] for c in column]
        accepts.append(marks[firsts[b]])
    dead = next((k for k in range(len(order)) if not accepts[k] and all(t == k for t in table[k * 256 : k * 256 + 256])), -1)
    return Dfa(table, accepts, next((k for k, m in enumerate(accepts) if m), len(accepts)), place[block[0]], dead)


def _minimise(rows: list[list[int]], marks: list[int]) -> list[int]:
    """Partition refinement; returns each state's block."""
    names: dict = {}
    block = [names.setdefault(m, len(names)) for m in marks]
    while True:
        names = {}
        finer = [names.setdefault((block[s], *[block[t] for t in row]), len(names)) for s, row in enumerate(rows)]
        if len(names) == len(set(block)):
            return block
        block = finer
