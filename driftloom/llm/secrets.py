"""Secret scan: every rule in one deterministic automaton, one pass over the bytes."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Dfa, Parser, backwards, compile_rules
from .common import arrow_map


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least lengths of the match and of the assigned value; failing matches still use up their bytes.
    least: int = 0
    least_value: int = 0


#: Fixed values of the contract, in its order. Lengths are checked after the match: counters of several
#: rules would multiply the automaton's states. Runs of hex digits are counted up to 8 there, so that
#: the letters a to f in prose don't count as matches.
BASE_RULES = (
    Rule("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{8,}", 16),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("gittoken", r"gh[opsu]_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
_VALUE = re.compile(rb"""[^:=]*[:=]\x20*["']?(.*)""", re.S)


class SecretScanner:
    """All rules' spans in a byte string, per rule leftmost, longest and non-overlapping.

    One unanchored automaton for all rules reads each byte once, without going back, and
    tells where some rule's match ends. There, the rule's reversed automaton finds the leftmost start
    and its forward automaton the longest end, over the bytes of that match alone. For this the earliest end must belong to
    the leftmost match, which holds if no match of a rule can begin inside a longer one
    and end before that could have ended; tests hold the rules against `re`.
    """

    def __init__(self, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES):
        self.rules = rules
        nodes = [Parser(r.pattern).parse() for r in rules]
        self.all = compile_rules(nodes, anchored=False)
        self.forward = [compile_rules([n], anchored=True) for n in nodes]
        self.reverse = [compile_rules([backwards(n)], anchored=True) for n in nodes]
        self._steps()

    def _steps(self) -> None:
        """Transition arrays: entry b of a state's row is the next state's row, entry 256 tells which rules end there."""
        table, marks = self.all.table, self.all.accepts
        self.rows = [[None] * 257 for _ in marks]
        for k, row in enumerate(self.rows):
            row[:256] = [self.rows[s] for s in table[256 * k : 256 * k + 256]]
            row[256] = marks[k]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._steps()

    def _leftmost(self, r: int, data: bytes, end: int, floor: int) -> int | None:
        d, best = self.reverse[r], None
        s = d.start
        for i in range(end - 1, floor - 1, -1):
            s = d.table[s * 256 + data[i]]
            if s == d.dead:
                break
            if d.accepts[s]:
                best = i
        return best

    def _longest(self, r: int, data: bytes, start: int) -> int:
        d, best = self.forward[r], start
        s = d.start
        for i in range(start, len(data)):
            s = d.table[s * 256 + data[i]]
            if s == d.dead:
                break
            if d.accepts[s]:
                best = i + 1
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule number, start, end) in bytes: one pass over data; around the end of a match its own bytes are looked at again."""
        row, done, out = self.rows[self.all.start], [0] * len(self.rules), []
        left = iter(data)
        for b in left:
            row = row[b]
            if row[256]:
                mark, end = row[256], len(data) - left.__length_hint__()
                for r, rule in enumerate(self.rules):
                    if mark >> r & 1 and end > done[r]:
                        start = self._leftmost(r, data, end, done[r])
                        if start is None:
                            continue
                        done[r] = stop = self._longest(r, data, start)
                        if stop - start < rule.least:
                            continue
                        if not rule.least_value or len(_VALUE.match(data[start:stop])[1]) >= rule.least_value:
                            out.append((r, start, stop))
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, base: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_<kind> of the first `base` rules, base_sha256, spans (kind:start:end in code points, end exclusive).

    Null and empty texts have no spans; a null text counts as empty. Spans of one kind don't overlap, spans of
    different kinds may. Order: start, then the order of the rules. Rows stay as many as
    they were, repeated ones too; columns other than id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(SecretScanner(rules))  # size: that of the rules alone
    kinds = [r.kind for r in rules]
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = lean.schema[0].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in kinds[:base]) + ", base_sha256 string, spans string"

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = shared.value
        counts, digest, spans = [[] for _ in range(base)], [], []
        for text in batch.column(1).to_pylist():
            found = sorted(scanner.scan(text), key=lambda x: (x[1], x[0])) if text else []
            if found and not text.isascii():
                found = [(r, a := len(text[:s].decode()), a + len(text[s:e].decode())) for r, s, e in found]
            named = [(r, f"{kinds[r]}:{s}:{e}") for r, s, e in found]
            digest.append(hashlib.sha256(",".join(x for r, x in named if r < base).encode()).hexdigest())
            spans.append(",".join(x for _, x in named))
            for r in range(base):
                counts[r].append(sum(x[0] == r for x in named))
        arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"n_{k}" for k in kinds[:base]], "base_sha256", "spans"])

    return arrow_map(lean, apply, schema)


__all__ = ["BASE_RULES", "MORE_RULES", "Dfa", "Rule", "SecretScanner", "find_secrets"]
