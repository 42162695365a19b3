"""Near-duplicate groups by a Jaccard join on word shingles: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from driftloom.scratch import passing

from .common import WordHashes, broadcast_if_small, map_batches, materialise, mix64
from .components import components

#: log2 of the counters of the frequency sketch: 4 MB, whatever the corpus.
SKETCH_BITS = 20
SKETCH_BLOCK = 4096
#: Representatives that a broadcast may hold when texts are fetched; beyond, a shuffled join.
BROADCAST_IDS = 500_000
#: log2 of the cells of the signature behind the suffix filter.
CELL_BITS = 6
#: A prefix shingle that occurs about so often, beyond what its sketch counter holds anyway, is split.
SPLIT = 1024
#: Pairs for each open entry at which members of different components are paired; beyond, another pivot goes first.
PAIRS_A_ROW = 8
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class Rule:
    """Documents link when den * |A & B| >= num * |A | B| over their sets of `words`-word shingles."""

    words: int = 4
    num: int = 85
    den: int = 100

    def prefix(self, n: np.ndarray | int):
        """Length of the prefix that two linked sets must share a shingle of."""
        return n - -(-self.num * n // self.den) + 1


class Shingler:
    """Distinct shingle hashes of a text, sorted."""

    def __init__(self, words: int):
        self.words, self.cache = words, WordHashes()
        mult = [pow(int(_MULT[k % 4]), 2 * (k // 4) + 1, 1 << 64) for k in range(words)]
        self.mult = [np.uint64(x) for x in mult]

    def __call__(self, text: bytes | None) -> np.ndarray:
        ws = text.lower().split() if text else []
        if not ws:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.cache.__getitem__, ws), np.uint64, len(ws))
        if len(h) < self.words:  # the whole sequence is one shingle, told from longer ones by its length
            return mix64((h * np.array(self.mult[: len(h)])).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
        n = len(h) - self.words + 1
        s = np.zeros(n, np.uint64)
        for k, m in enumerate(self.mult):
            s += h[k : k + n] * m
        return np.unique(mix64(s))


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set; equal sets are one class."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _profile(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per row (doc_id, hi, lo, n, cells); and per task the blocks of its frequency sketch (block, counts)."""
    id_arrow = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, size = Shingler(rule.words), 1 << SKETCH_BITS
        sketch, pending, waiting = np.zeros(size, np.uint32), [], 0
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            hi, lo, n, cells = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle(t)
                a, b = class_key(s)
                hi.append(a)
                lo.append(b)
                n.append(len(s))
                cells.append(signature(s))
                pending.append(s >> shift)
                waiting += len(s)
                if waiting > 1 << 20:
                    sketch += np.bincount(np.concatenate(pending).astype(np.int64), minlength=size).astype(np.uint32)
                    pending, waiting = [], 0
            m = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(cells, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if pending:
            sketch += np.bincount(np.concatenate(pending).astype(np.int64), minlength=size).astype(np.uint32)
        blocks = [b for b in range(size // SKETCH_BLOCK) if sketch[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK].any()]
        m = len(blocks)
        data = [sketch[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK].astype(np.uint64).tobytes() for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.nulls(m, id_arrow), *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())], pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=names)

    names = ["doc_id", "hi", "lo", "n", "cells", "block", "counts"]
    return map_batches(docs, run, f"doc_id {_id_type(docs)}, hi long, lo long, n int, cells binary, block int, counts binary")


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def signature(shingles: np.ndarray) -> bytes:
    """How many shingles lie in each cell of the hash range, 255 at most."""
    return np.minimum(np.bincount((shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS), 255).astype(np.uint8).tobytes()


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(c, np.uint64)
            total[b] = total[b] + x if b in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def _frequencies(profile: DataFrame) -> np.ndarray:
    """How often the shingles of each sketch counter occur, over all documents: 8 MB, whatever the corpus."""
    part = profile.where("block is not null").select("block", "counts")
    salted = map_batches(part.repartition("block", F.pmod(F.spark_partition_id(), F.lit(8))), _sum_blocks, part.schema)
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in map_batches(salted.repartition("block"), _sum_blocks, part.schema).collect():
        out[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] += np.frombuffer(r.counts, np.uint64)
    return out


def _prefixes(docs: DataFrame, frequencies: np.ndarray, rule: Rule) -> DataFrame:
    """(h, salt, splits, hi, lo, n, pos): the prefix of each class's shingles, rarest first; a task sends a class once.

    Entries of a shingle that occurs very often are split by their class: salt is 0 .. splits - 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)
    usual = 2 * float(frequencies.mean())
    part = max(SPLIT, usual)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, freq, sent = Shingler(rule.words), shared.value, set()
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            parts, splits, his, los, ns, ps = [], [], [], [], [], []
            for t in batch.column(0).to_pylist():
                s = shingle(t)
                if not len(s) or (key := class_key(s)) in sent:
                    continue
                if len(sent) > 100_000:
                    sent.clear()
                sent.add(key)
                total = len(s)
                p = rule.prefix(total)
                f = freq[(s >> shift).astype(np.int64)]
                if p < total:
                    near = f <= np.partition(f, p - 1)[p - 1]
                    s, f = s[near], f[near]
                order = np.lexsort((s, f))[:p]
                s = s[order]
                parts.append(s.view(np.int64))
                splits.append(np.maximum(f[order] - usual, 0) // part + 1)
                his.append(key[0])
                los.append(key[1])
                ns.append(total)
                ps.append(len(s))
            size = np.array(ps, np.int64)
            ways = np.concatenate(splits).astype(np.int64) if splits else np.zeros(0, np.int64)
            high = np.repeat(np.array(his, np.int64), size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)),
                    pa.array(high % np.maximum(ways, 1)),
                    pa.array(ways),
                    pa.array(high),
                    pa.array(np.repeat(np.array(los, np.int64), size)),
                    pa.array(np.repeat(np.array(ns, np.int32), size)),
                    pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in ps]) if ps else np.zeros(0, np.int32)),
                ],
                names=["h", "salt", "splits", "hi", "lo", "n", "pos"],
            )

    return map_batches(docs.select("text"), run, "h long, salt long, splits long, hi long, lo long, n int, pos int")


def _within(rule: Rule, an: Column, apos: Column, bn: Column, bpos: Column) -> Column:
    """Length and positional filter of two sets whose first common shingle has these places in their orders."""
    length = F.least(an, bn) * rule.den >= F.greatest(an, bn) * rule.num
    most = 1 + F.least(an - apos, bn - bpos) - 1
    return length & (most * (rule.num + rule.den) >= (an + bn) * rule.num)


def far_apart(a: np.ndarray, b: np.ndarray, an: np.ndarray, bn: np.ndarray, rule: Rule) -> np.ndarray:
    """Suffix filter: for rows of signatures whether the sets must differ in more shingles than linked ones may.

    Both sets are cut at the same hashes; in each cell they differ in as many shingles at least as their numbers there do.
    """
    need = -(-rule.num * (an + bn) // (rule.num + rule.den))
    return np.abs(a.astype(np.int64) - b.astype(np.int64)).sum(axis=1) > an + bn - 2 * need


def linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    need = -(-rule.num * (len(a) + len(b)) // (rule.num + rule.den))
    return min(len(a), len(b)) >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need


def _near(pairs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b) of documents those that the suffix filter leaves, by the signatures alone."""
    side = lambda x: rows.where("n > 0").select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            ca, cb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 1 << CELL_BITS) for k in (4, 5))
            yield batch.select([0, 1]).filter(pa.array(~far_apart(ca, cb, na, nb, rule)))

    near = map_batches(both, run, pairs.select("a", "b").schema)
    return materialise(near.distinct(), "jaccard-near")  # rows of one id give a pair more than once


def _verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b) of documents those that link; each pair's sets are compared once."""
    pairs = _near(pairs, rows, rule)
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.join(broadcast_if_small(ids, BROADCAST_IDS), "doc_id")
    texts = materialise(texts, "jaccard-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(rule.words), {}
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (a, len(ta)) not in known:
                    if len(known) > 64:
                        known.clear()
                    known[a, len(ta)] = ta, shingle(ta)
                if known[a, len(ta)][0] != ta:
                    known[a, len(ta)] = ta, shingle(ta)
                keep.append(linked(known[a, len(ta)][1], shingle(tb), rule))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return materialise(map_batches(both.select("a", "b", "ta", "tb"), run, pairs.schema).distinct(), "jaccard-links")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id that links reach.

    Words are runs of other than ASCII white space, A-Z folded. A text of fewer words
    than a shingle is one shingle; texts that are null or have no words have none, link
    with nothing and are their own component. Equal sets are one class throughout, so
    copies cost nothing. Rows that share an id count as one document, which links if any
    of its texts does. Ids may have any type that sorts; rows without one have no component.
    Columns other than id and text are ignored. Empty table: no rows.

    Every linked pair shares a shingle of both prefixes (rarest first by a sketch of all
    shingle counts; the order only steers cost). First each prefix shingle's members are
    compared with the one in which it stands first; those of a very common shingle are
    split, and the firsts of the splits compared with one another's first. Then, of
    members that this left in different components, all pairs that pass the filters; if
    these would be many, more members are compared with all first, as long as that links
    some. So a large group of near copies costs a comparison a member, and no link is
    missed. Signatures prune pairs before any text is fetched. Hashes have 64 bits, class
    keys 128.
    """
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    with passing(docs.sparkSession) as keep:
        profile = materialise(_profile(lean, rule), "jaccard-profile")
        rows = profile.where("block is null").select("doc_id", "hi", "lo", "n", "cells")
        classes = rows.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
        classes = materialise(classes, "jaccard-classes")
        groups = _groups(lean, classes, _frequencies(profile), rule)

        done = _stars(groups, rule)
        links = _verify(done, lean, rows, rule).unionByName(_of_one_id(rows, classes))
        found = materialise(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "jaccard-components")
        while True:
            open_, entries, pairs = _open(groups, found)
            if pairs <= PAIRS_A_ROW * entries:
                break
            more = _further(open_, done, rule)
            links = _verify(more, lean, rows, rule)
            done = done.unionByName(more)
            if links.isEmpty():
                break
            found = _joined(found, links)
        if entries:
            links = _verify(_across(open_, done, rule), lean, rows, rule)
            if not links.isEmpty():
                found = _joined(found, links)

        named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
        out = rows.join(materialise(named, "jaccard-named"), ["hi", "lo"], "left")
        return keep(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "jaccard")


def _groups(docs: DataFrame, classes: DataFrame, frequencies: np.ndarray, rule: Rule) -> DataFrame:
    """(h, salt, splits, rep, n, pos) of the prefix shingles that several classes have; a shingle that is split stays anyway."""
    entries = _prefixes(docs, frequencies, rule).repartition("h", "salt").dropDuplicates(["h", "salt", "hi", "lo"])
    shared = entries.withColumn("members", F.count("*").over(Window.partitionBy("h", "salt"))).where("members > 1 or splits > 1")
    return materialise(shared.join(classes, ["hi", "lo"]).select("h", "salt", "splits", "rep", "n", "pos"), "jaccard-groups")


def _stars(groups: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of each member with the one in which the shingle stands first, in its split; and of these with the first of all."""

    def star(rows: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
        first = F.first(F.struct("rep", "n", "pos")).over(Window.partitionBy(*by).orderBy("pos", "n", "rep"))
        rows = rows.withColumn("p", first)
        return rows.where("p.rep <> rep").where(_within(rule, F.col("p.n"), F.col("p.pos"), F.col("n"), F.col("pos"))).select(F.col("p.rep").alias("a"), F.col("rep").alias("b")), rows

    members, rows = star(groups, "h", "salt")
    firsts, _ = star(rows.where("splits > 1 and p.rep = rep").drop("p"), "h")
    return materialise(members.unionByName(firsts).distinct(), "jaccard-pairs")


def _of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the classes that rows of one id belong to."""
    reps = rows.join(classes, ["hi", "lo"]).select("doc_id", "rep")
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    return reps.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def _open(groups: DataFrame, found: DataFrame) -> tuple[DataFrame, int, int]:
    """Entries of shingles whose members lie in several components, how many, and how many pairs across components they make."""
    named = groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = named.groupBy("h", "component").agg(F.count("*").cast("double").alias("m"))
    mixed = sizes.groupBy("h").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count("*").alias("k")).where("k > 1")
    mixed = materialise(mixed, "jaccard-mixed")
    load = mixed.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()
    return materialise(named.join(mixed.select("h"), "h"), "jaccard-open"), int(load[0] or 0), int(load[1] or 0)


def _not_yet(pairs: DataFrame, done: DataFrame) -> DataFrame:
    both = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.distinct().join(both, ["a", "b"], "left_anti")


def _further(open_: DataFrame, done: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of each member with one member of its shingle that has not been a pivot, of another component."""
    used = done.select(F.col("a").alias("rep")).distinct()
    pivots = open_.join(used, "rep", "left_anti").groupBy("h").agg(F.min(F.struct("pos", "n", "rep", "component")).alias("p"))
    pivots = materialise(pivots, "jaccard-pivots")  # so that a skewed side of the join below can be split
    pairs = open_.join(pivots, "h").where("p.component <> component").where(_within(rule, F.col("p.n"), F.col("p.pos"), F.col("n"), F.col("pos")))
    return materialise(_not_yet(pairs.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")), done), "jaccard-further")


def _across(open_: DataFrame, done: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) not yet compared that share a prefix shingle, pass the filters and lie in different components."""
    left, right = open_.alias("l"), open_.alias("r")
    ok = (F.col("l.component") < F.col("r.component")) & _within(rule, F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos"))
    pairs = left.join(right, (F.col("l.h") == F.col("r.h")) & ok).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
    return materialise(_not_yet(pairs, done), "jaccard-rest")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found with the components that links (a, b) join renamed, and the links' own nodes."""
    named = links
    for side in ("a", "b"):
        named = named.join(found.select(F.col("node").alias(side), F.col("component").alias(f"{side}c")), side, "left")
    over = materialise(components(named.select(F.coalesce("ac", "a").alias("u"), F.coalesce("bc", "b").alias("v"))), "jaccard-over")
    renamed = found.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    renamed = renamed.select("node", F.coalesce("to", "component").alias("component"))
    return materialise(renamed.unionByName(over.join(found, "node", "left_anti")), "jaccard-merged")
