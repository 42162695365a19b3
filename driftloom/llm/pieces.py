"""SentencePiece encoding and decoding by a weighted finite-state transducer."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, give_back

#: The piece model of the environment; a parameter of every function here.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Composed units and pair weights a worker may remember.
UNITS, PAIRS = 150_000, 300_000
INF = float("inf")
_APART = 1 << 22  # more than twice any code point or id
_UNIGRAM, _BPE = 1, 2  # model types of the file format
_NORMAL, _UNKNOWN, _BYTE, _USER = 1, 2, 6, 4  # piece types of the file format
#: What the file format's unigram models add to the weight of a character in no piece, over that of the dearest piece.
UNKNOWN_GAP = 10.0


class Rewriter:
    """The model's character rules as a transducer: at each place the longest rule is read and what it writes is written."""

    def __init__(self, charsmap: bytes):
        """charsmap: the file format's double array of rules, and what they write, ended by zeros."""
        self.arcs: list[dict[str, int]] = [{}]
        self.writes: list[str | None] = [None]
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            units, outputs = np.frombuffer(charsmap, "<u4", size // 4, 4), charsmap[4 + size :]
            for read, at in self._rules(units):
                end = outputs.index(b"\0", at)
                self._add(read.decode(), outputs[at:end].decode())
        self.starts = re.compile("[" + "".join(map(re.escape, self.arcs[0])) + "]") if self.arcs[0] else None

    @staticmethod
    def _rules(units: np.ndarray) -> list[tuple[bytes, int]]:
        """(what is read, offset of what is written) of every rule of a double array."""
        labels, values = units & np.uint32(1 << 31 | 0xFF), units.tolist()
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        found, todo, every = [], [(offset(values[0]), b"")], np.arange(1, 256)
        while todo:
            base, read = todo.pop()
            places = np.minimum(base ^ every, len(units) - 1)
            for byte in (np.flatnonzero(labels[places] == every) + 1).tolist():
                to = base ^ byte
                if to < len(units):
                    more, nxt = read + bytes([byte]), to ^ offset(values[to])
                    if values[to] >> 8 & 1:
                        found.append((more, values[nxt] & 0x7FFFFFFF))
                    todo.append((nxt, more))
        return found

    def _add(self, read: str, write: str) -> None:
        state = 0
        for ch in read:
            if ch not in self.arcs[state]:
                self.arcs.append({})
                self.writes.append(None)
                self.arcs[state][ch] = len(self.arcs) - 1
            state = self.arcs[state][ch]
        self.writes[state] = write

    def __call__(self, text: str) -> str:
        if self.starts is None:
            return text
        out, at, n = [], 0, len(text)
        while m := self.starts.search(text, at):
            out.append(text[at : m.start()])
            state, k, end, write = 0, m.start(), m.start() + 1, m[0]
            while k < n and (state := self.arcs[state].get(text[k])) is not None:
                k += 1
                if self.writes[state] is not None:
                    end, write = k, self.writes[state]
            out.append(write)
            at = end
        out.append(text[at:])
        return "".join(out)


class Blanks:
    """Blanks as a transducer of three states: before the text, in a word, behind blanks that are not written yet.

    Each state's arcs: what a blank writes and where it leads, what goes before any other
    character, which is written as it is and leads into a word. Where blanks may not be
    left out, the state in a word is all there is and its arcs come back to it: then
    composition is a map of characters.
    """

    BEFORE, WORD, BEHIND = range(3)

    def __init__(self, prefix: bool, squeeze: bool, escape: bool):
        self.mark = SPACE if escape else " "
        self.prefix, self.squeeze = self.mark if prefix else "", squeeze
        if squeeze:
            self.arcs = {self.BEFORE: ("", self.BEFORE, self.prefix), self.WORD: ("", self.BEHIND, ""), self.BEHIND: ("", self.BEHIND, self.mark)}
        else:
            self.arcs = {self.WORD: (self.mark, self.WORD, "")}

    def in_word(self, text: str) -> str:
        """What the state in a word makes of text where its arcs come back to it."""
        return text.replace(" ", self.mark)

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if not self.squeeze:
            return self.prefix + self.in_word(text)
        state, out = self.BEFORE, []
        for part in re.findall(" *[^ ]+| +", text):
            rest = part.lstrip(" ")
            for _ in range(len(part) - len(rest)):
                write, state, _ = self.arcs[state]
                out.append(write)
            if rest:
                out += [self.arcs[state][2], rest]
                state = self.WORD
        return "".join(out).rstrip(self.mark)


def unit_pattern(names: Iterable[str], fallback: bool) -> re.Pattern:
    """What may be composed alone: a word with the blanks before it, a mark after a letter, a line feed.

    Only where no piece (names) reaches across: blanks must stand in front in every piece,
    and no piece may hold a letter followed by one of the marks. Without byte fallback,
    unknown characters in a row have one id, so texts stay whole.
    """
    long = [p for p in names if len(p) > 1]
    if any(SPACE in p.lstrip(SPACE) for p in long) or not fallback:
        return re.compile(".+", re.S)
    line = "" if any("\n" in p for p in long) else "\n"
    across = {b for p in long for a, b in zip(p, p[1:], strict=False) if a.isascii() and a.isalpha()}
    marks = "".join(re.escape(c) for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~" if c not in across)
    blank = f" {SPACE}"
    rest = f"[^{blank}{line}{marks}]*"
    more = f"(?:(?<![A-Za-z])[{marks}]{rest})*" if marks else ""
    return re.compile(f"[{blank}]*[^{blank}{line}]{rest}{more}|[{blank}]+" + (f"|{line}" if line else ""))


class PieceMachine:
    """Normaliser, pieces and byte fallback as one weighted transducer; encoding is the shortest path of its composition with a text.

    The normaliser is two transducers, the model's character rules and its treatment of
    blanks. The pieces share a prefix tree: from its root, where a piece has just ended,
    arcs read the characters of a piece; the arc that ends it writes its id, adds its
    weight and leads to the root again. A character in no piece is read by an arc that
    writes the ids of its UTF-8 bytes, or the unknown id.

    In unigram models a piece weighs its negated score. In merge (BPE) models the root is
    split: there is one for each last piece, and a piece weighs 0 after a piece where
    merging both pieces' characters gives these two pieces again, and is infinitely heavy
    elsewhere. A sequence all of whose pairs weigh 0 is what the merges make of the text,
    so every prefix has exactly one path of finite weight. These arcs are made when a
    path first asks for them.

    The composition's states are places of the text, with the last piece. Its shortest
    path in the tropical semiring is found best first, of equal weights the farthest
    place first. Paths cannot cross between characters that stand side by side in no
    piece; so the text is composed unit by unit, and units that come again are remembered.
    """

    def __init__(self, model: str | bytes = MODEL_FILE):
        """model: a model file, or its content. Models with symbols of the user, or blanks behind words, are refused."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE) or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == _USER for p in proto.pieces):
            raise ValueError("not a unigram or merge model without symbols of the user")
        self.merges = proto.trainer_spec.model_type == _BPE
        norm = proto.normalizer_spec
        self.rewrite = Rewriter(norm.precompiled_charsmap)
        self.blanks = Blanks(norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.out: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            data = b""
            if p.type == _NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                data = p.piece.replace(SPACE, " ").encode()
            elif p.type == _BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                data = bytes([int(p.piece[3:5], 16)])
            elif p.type == _UNKNOWN:
                data = proto.trainer_spec.unk_surface.encode()
            self.out.append(data)
        self.fallback = proto.trainer_spec.byte_fallback
        self.wide = len(proto.pieces) > 65535
        # how each piece that merging reaches comes about
        self.traces = {p: t for p in self.ids if (t := self._trace(p))} if self.merges else {}
        self._compile()
        self.unit = unit_pattern(self.ids, self.fallback)
        self._reset()

    def _compile(self) -> None:
        """The prefix tree: a state is its arcs by character and the id of the piece that ends there, or None; weights by id."""
        if not self.merges and max(self.scores.values(), default=0.0) > 0:
            raise ValueError("a piece may not weigh less than nothing")
        self.lone = 0.0 if self.merges else UNKNOWN_GAP - min(self.scores.values(), default=0.0)  # weight of a character in no piece
        self.names = {i: p for p, i in self.ids.items()}
        self.weights = [0.0] * len(self.out)
        ends = dict(self.ids.items() if not self.merges else ((p, self.ids[p]) for p in self.traces))
        if not self.merges:
            for p, i in ends.items():
                self.weights[i] = -self.scores[p]
        begins = {p[:k] for p in ends for k in range(len(p))}
        none: dict = {}
        states: dict[str, tuple[dict, int | None]] = {"": ({}, None)}
        for read in sorted(begins | ends.keys(), key=len):
            if read:
                states[read] = ({} if read in begins else none, ends.get(read))
                states[read[:-1]][0][read[-1]] = states[read]
        self.root = states[""][0]

    def _reset(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "older", "pairs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _trace(self, text: str) -> tuple[list[float], list[str], list[str]] | None:
        """How merging makes text one piece: scores of the merges in order, the first and the last part before each and at the end.

        The best-scored pair of neighbours merges first, the leftmost of equals. None if more than one part is left.
        """
        parts = list(text)
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = -INF, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (s > best or at < 0):
                    best, at = s, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return scores, firsts, lasts

    def pair_weight(self, left: str, right: str) -> float:
        """Weight of the arc that reads right after left, in a merge model: 0 if no merge ever crosses between them side by side.

        Until one crosses, each side merges as it does alone; so both traces are walked
        together, the better next merge first, and what stands at the border is looked up.
        """
        ls, _, ends = self.traces.get(left) or ((), (), (left,))
        rs, begins, _ = self.traces.get(right) or ((), (right,), ())
        i = j = 0
        while True:
            a = ls[i] if i < len(ls) else -INF
            b = rs[j] if j < len(rs) else -INF
            cross = self.scores.get(ends[i] + begins[j])
            if cross is not None and (cross > a or i == len(ls)) and (cross >= b or j == len(rs)):
                return INF
            if i < len(ls) and (a >= b or j == len(rs)):
                i += 1
            elif j < len(rs):
                j += 1
            else:
                return 0.0

    def name(self, piece: int) -> str:
        return self.names[piece] if piece >= 0 else chr(~piece)

    def arcs_from(self, unit: str, place: int) -> list[tuple[float, int, int]]:
        """(least weight, - place where it ends, piece) of every arc that reads from place on, the one to try first last.

        piece is an id, or the inverted code point of a character that is no piece.
        """
        arcs, out, weights = self.root, [], self.weights
        for k in range(place, len(unit)):
            state = arcs.get(unit[k])
            if state is None:
                break
            arcs, piece = state
            if piece is not None:
                out.append((weights[piece], ~k, piece))
        if not out or out[0][1] != ~place:
            out.insert(0, (self.lone, ~place, ~ord(unit[place])))
        if not self.merges:
            out.sort(reverse=True)
        return out

    def best_path(self, unit: str) -> list[int]:
        """Pieces on the shortest path through the composition of unit and machine, best first.

        A place that was reached has its least weight, as no arc weighs less than nothing;
        of a place's arcs one is in the queue at a time, and the pair weights of merges are
        looked up when their arc's turn comes.
        """
        n, pairs, back = len(unit), self.pairs if self.merges else None, {0: (0, 0)}
        todo: list[tuple] = []
        place, weight, arcs_from = 0, 0.0, self.arcs_from
        while place < n:
            arcs = arcs_from(unit, place)
            more, end, piece = arcs.pop()
            heappush(todo, (weight + more, end, place, piece, weight, arcs))
            while True:
                weight, end, begin, piece, before, arcs = heappop(todo)
                if arcs:
                    more, to, other = arcs.pop()
                    heappush(todo, (before + more, to, begin, other, before, arcs))
                if -end in back:
                    continue
                if pairs is not None and begin:
                    left = back[begin][1]
                    more = pairs.get(left * _APART + piece)
                    if more is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        more = pairs[left * _APART + piece] = self.pair_weight(self.name(left), self.name(piece))
                    if more:
                        continue
                break
            place = -end
            back[place] = begin, piece
        path = []
        while n:
            n, piece = back[n]
            path.append(piece)
        return path[::-1]

    def _compose(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self._ids_of(unit)
        if len(unit) <= 64:
            if len(self.known) >= UNITS:  # what is not asked for again goes with the older half
                self.older, self.known = self.known, {}
            self.known[unit] = found
        return found

    def _ids_of(self, unit: str) -> bytes:
        line = unit if self.blanks.squeeze else self.blanks.in_word(unit)
        ids: list[int] = []
        for piece in [self.ids[line]] if line in self.traces else self.best_path(line):
            if piece >= 0:
                ids.append(piece)
            elif self.fallback:
                ids += [self.bytes[b] for b in chr(~piece).encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return array("I" if self.wide else "H", ids).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; none for null and empty texts."""
        if not text:
            return np.zeros(0, np.int32)
        line = self.rewrite(text)
        line = self.blanks(line) if self.blanks.squeeze else self.blanks.prefix + line  # else unit by unit
        known, compose = self.known.get, self._compose
        data = b"".join([known(u) or compose(u) for u in self.unit.findall(line)])
        return np.frombuffer(data, np.uint32 if self.wide else np.uint16).astype(np.int32)

    def decode(self, ids) -> str:
        """The text of the ids, by the machine with reading and writing exchanged.

        Blanks again for U+2581, without the one put in front; broken UTF-8 becomes U+FFFD.
        """
        parts = list(map(self.out.__getitem__, ids))
        for k, i in enumerate(ids if self.blanks.prefix or self.blanks.squeeze else ()):  # the blank in front
            if i == self.unknown or not parts[k].startswith(b" "):
                break
            parts[k] = parts[k][1:]
            if parts[k] or not self.blanks.squeeze:
                break
        return b"".join(parts).decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, model_file: str = MODEL_FILE, text_col: str = "text", ids_col: str = "piece_ids", check_col: str = "round_trip", machine: PieceMachine | None = None) -> DataFrame:
    """docs with ids_col (array<int>), n_pieces and check_col: whether decoding gives the text back.

    Null texts have null ids, no pieces and a null check; empty texts an empty array. A
    text that holds U+2581 itself comes back with blanks there, and its check is false. All
    rows and columns stay; columns of the three new names are replaced.
    """
    base = docs.drop(ids_col, "n_pieces", check_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine or PieceMachine(model_file))  # size: that of the model
    give_back()
    schema = T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField(check_col, T.BooleanType())])
    at, names = base.columns.index(text_col), schema.names

    def apply(batch: pa.RecordBatch):
        m = shared.value
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            ids, sizes, fine = [], [], []
            for t in part.column(at).to_pylist():
                if t is None:
                    sizes.append(None)
                    fine.append(None)
                    continue
                found = m.encode(t)
                ids.append(found)
                sizes.append(len(found))
                fine.append(m.decode(found.tolist()) == t)
            ends = np.cumsum([0] + [s or 0 for s in sizes]).astype(np.int32)
            offsets = pa.array([None if k < len(sizes) and sizes[k] is None else int(e) for k, e in enumerate(ends)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([s or 0 for s in sizes], pa.int64()), pa.array(fine, pa.bool_())], names=names)

    return arrow_map(base, apply, schema)


def decode_pieces(rows: DataFrame, model_file: str = MODEL_FILE, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """rows with text_col, the text of ids_col; null ids give null. A column named text_col is replaced."""
    base = rows.drop(text_col)
    shared = rows.sparkSession.sparkContext.broadcast(PieceMachine(model_file))
    at, names = base.columns.index(ids_col), base.columns

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if x is None else shared.value.decode(x) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    return arrow_map(base, apply, base.withColumn(text_col, F.lit(None).cast("string")).schema)
