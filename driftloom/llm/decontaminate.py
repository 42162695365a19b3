"""Benchmark decontamination with a generalised suffix automaton over item words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, free_name, materialise

#: Item words that one automaton may hold; more items are scanned block after block.
BLOCK_WORDS = 2_000_000

#: Fixed by the contract: ASCII letters, digits and everything above ASCII make words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of all items' word sequences, with the windows that end in each state.

    A state stands for the word sequences that occur in the items at the same end places.
    `step` keeps the longest suffix of the words read so far that occurs in some item.
    `windows(state, length)` gives (window length, items) for the windows that end here.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.items = [x for x, _ in items]
        self.vocab: dict[bytes, int] = {}
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.depth = [-1], [0]
        for ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        # shortest window that any item has, for the bulk test below
        self.least = min([min(window, len(ws)) for ws in coded if ws], default=0)
        self._mark(coded)
        n = len(self.vocab) + 1
        self.mask = (1 << max(16, (8 * sum(map(len, coded))).bit_length())) - 1
        self.pairs = np.zeros(self.mask + 1, dtype=bool)
        for ws in coded:
            if len(ws) > 1:
                a = np.array(ws, dtype=np.int64)
                self.pairs[self._pair(a[:-1], a[1:])] = True
        self.unknown = n - 1

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77 + (a >> 7)) & self.mask

    def _new(self, depth: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.depth.append(depth)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """State for the sequences of q that are no longer than depth[p] + 1."""
        c = self._new(self.depth[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another item has this prefix
            return q if self.depth[q] == self.depth[last] + 1 else self._split(last, w, q)
        cur, p = self._new(self.depth[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.depth[q] == self.depth[p] + 1 else self._split(p, w, q)
        return cur

    def _mark(self, coded: list[list[int]]) -> None:
        window, has = self.window, [set() for _ in self.next]
        whole: dict[int, list[int]] = {}
        for k, ws in enumerate(coded):
            s = 0
            for w in ws:
                s = u = self.next[s][w]
                while u > 0 and k not in has[u] and self.depth[u] >= window:
                    has[u].add(k)
                    u = self.link[u]
            if 0 < len(ws) < window:
                whole.setdefault(s, []).append(k)
        # for each state: the ancestor that holds its suffix of `window` words, and the short items among its suffixes
        self.long: list[tuple[int, ...]] = [()] * len(self.next)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.depth.__getitem__):
            up = self.link[v]
            if self.depth[v] >= window:
                self.long[v] = self.long[up] if self.depth[up] >= window else tuple(has[v])
            self.short[v] = self.short[up] + tuple((self.depth[v], k) for k in whole.get(v, ()))

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that may hold a window: from the root, all else keeps the automaton's match under `least` words."""
        if self.least == 0 or len(ids) < self.least:
            return []
        near = ids >= 0 if self.least == 1 else self.pairs[self._pair(ids[:-1], ids[1:])] & (ids[:-1] >= 0) & (ids[1:] >= 0)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).view(np.int8)))
        first, end = edge[::2], edge[1::2]
        keep = end - first >= max(1, self.least - 1)
        extra = 0 if self.least == 1 else 1
        return list(zip(first[keep].tolist(), (end[keep] + extra).tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals covered by windows (end exclusive, merged) and the numbers of the items they come from."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, depth, window = self.next, self.link, self.depth, self.window
        for begin, end in self.runs(ids):
            state = length = 0
            for j, w in enumerate(ids[begin:end].tolist(), begin):
                while state and w not in nxt[state]:
                    state = link[state]
                    length = depth[state]
                to = nxt[state].get(w)
                if to is None:
                    continue
                state, length = to, length + 1
                size = 0
                if length >= window:
                    size = window
                    found.update(self.long[state])
                for m, k in self.short[state]:
                    if m <= length:
                        size = max(size, m)
                        found.add(k)
                if size:
                    start = j + 1 - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, j + 1))
        return spans, found


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, in blocks of BLOCK_WORDS words at most (or of one longer item)."""
    block, size = [], 0
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("i is not null and t is not null")
    for r in rows.distinct().toLocalIterator():
        ws = words_of(bytes(r.t))
        if block and size + len(ws) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.i, ws))
        size += len(ws)
    yield block


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between words of one span; a line break marks each cut."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]].rstrip())
        at = places[b - 1][1]
    out.append(text[at:].lstrip())
    return "\n".join(x for x in out if x)


#: Columns that find_windows() appends.
FOUND = ("_n_words", "_n_hit", "_spans", "_items")


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: bool = False, names: tuple[str, ...] = FOUND) -> DataFrame:
    """Per document: n_words, n_hit, spans (word intervals hit by item windows), item_ids. keep: all columns of docs stay.

    A window is `window` consecutive words of an item, or all of a shorter item. Null
    texts and texts without words have no words and no hits; items without words have no
    windows; an empty item table hits nothing. Repeated items count once per item_id.
    Other columns are ignored, or kept as they are; names (of the four new columns) must then not be theirs.
    Items of more than BLOCK_WORDS words are scanned block after block, each over a written copy of the rows.
    """
    spark = docs.sparkSession
    add = T.StructType([T.StructField(c, t) for c, t in zip(names, (T.LongType(), T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())), strict=True)])
    frame = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base, text_at = frame.columns, frame.columns.index(text_col if keep else "text")
    schema = T.StructType([*frame.schema.fields, *add.fields])
    first = True
    for block in _blocks(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(ItemAutomaton(block, window))

        def scan(batch: pa.RecordBatch, shared=shared, first=first) -> pa.RecordBatch:
            auto, n_words, spans, found = shared.value, [], [], []
            old = None if first else [c.to_pylist() for c in batch.columns[-2:]]
            for k, text in enumerate(batch.column(text_at).cast(pa.binary()).to_pylist()):
                ws = words_of(text) if text else []
                hit, which = auto.scan(ws)
                called = {auto.items[i] for i in which}
                if old is not None and old[0][k]:
                    hit = merge_spans(hit + list(zip(old[0][k][::2], old[0][k][1::2], strict=True)))
                    called |= set(old[1][k])
                n_words.append(len(ws))
                spans.append([x for s in hit for x in s])
                found.append(sorted(called))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(base)], pa.array(n_words, pa.int64()), pa.array([sum(x[1::2]) - sum(x[::2]) for x in spans], pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=schema.names)

        frame = arrow_map(frame if first else materialise(frame, "windows"), scan, schema)
        first = False
    return frame


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", chars_col: str | None = None) -> DataFrame:
    """docs without item windows: hit spans are cut out; documents covered beyond max_coverage go.

    Columns, and rows without hits, stay as they are. Where the cut brings words together
    that make a window again, the text is scanned and cut anew until it has none.
    chars_col, if given, gets the new length in code points where a text was cut.
    """
    blocks = _blocks(items, item_col, item_text)
    first, more = next(blocks), next(blocks, None) is not None
    if more:
        return _decontaminate_blocks(docs, items, window, max_coverage, text_col, item_col, item_text, chars_col)
    shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(first, window))
    text_at, chars_at = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col else None

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto, changed, kept = shared.value, {}, np.ones(len(batch), bool)
        for k, text in enumerate(batch.column(text_at).cast(pa.binary()).to_pylist()):
            words = words_of(text) if text else []
            spans = auto.scan(words)[0]
            if spans and sum(b - a for a, b in spans) > max_coverage * len(words):
                kept[k] = False
            elif spans:
                text = text.decode()
                while spans:
                    text = cut_words(text, spans)
                    spans = auto.scan(words_of(text.encode()))[0]
                changed[k] = text
        return _with_texts(batch, changed, text_at, chars_at).filter(pa.array(kept))

    return arrow_map(docs, cut, docs.schema)


def _with_texts(batch: pa.RecordBatch, changed: dict[int, str], text_at: int, chars_at: int | None) -> pa.RecordBatch:
    if not changed:
        return batch
    cols = list(batch.columns)
    for at, new in ((text_at, changed), *([(chars_at, {k: len(t) for k, t in changed.items()})] if chars_at is not None else [])):
        values = cols[at].to_pylist()
        for k, x in new.items():
            values[k] = x
        cols[at] = pa.array(values, cols[at].type)
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def _decontaminate_blocks(docs: DataFrame, items: DataFrame, window: int, max_coverage: float, text_col: str, item_col: str, item_text: str, chars_col: str | None) -> DataFrame:
    """As decontaminate(), for items of several blocks: one block's automaton doesn't see windows of another that a cut brings about, so rows are looked at again."""
    names = tuple(free_name(docs, c) for c in FOUND)
    found = find_windows(docs, items, window, text_col=text_col, item_col=item_col, item_text=item_text, keep=True, names=names)
    words, hit = map(F.col, names[:2])
    found = found.where((words == 0) | (hit <= F.lit(max_coverage) * words))
    columns, text_at, chars_at = docs.columns, docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col else None

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, texts = batch.column(names[2]).to_pylist(), batch.column(text_at).to_pylist()
        changed = {k: cut_words(texts[k], list(zip(x[::2], x[1::2], strict=True))) for k, x in enumerate(flat) if x}
        return _with_texts(batch.select(list(range(len(columns)))), changed, text_at, chars_at)

    out = materialise(arrow_map(found, cut, docs.schema), "cut")
    again = find_windows(out, items, window, text_col=text_col, item_col=item_col, item_text=item_text)
    if not again.where("_n_hit > 0").isEmpty():
        return _decontaminate_blocks(out, items, window, 1.0, text_col, item_col, item_text, chars_col)
    return out


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from find_windows()."""
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))

