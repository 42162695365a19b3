"""Bigram models over blocks of texts: words and pairs are counted at homes and their counts sent back.

A block holds about BLOCK_TOKENS tokens of whole documents. It asks once for each of its
distinct words and pairs, so frequent ones cost a key a block, not a row a token, and no
row of a token is shuffled. A home counts the keys of one range of hashes; there are as
many homes as keys need, so memory does not grow with the input. Keys have 128 bits:
blake2b of a word, and a mix of both words' for a pair.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from driftloom.scratch import materialise

#: Tokens of a block, keys that a home counts at once, bytes of an Arrow batch (a longer row is its own batch).
BLOCK_TOKENS, HOME_KEYS, BATCH_BYTES = 1 << 17, 1 << 21, 2 << 20
_SMALLEST = (np.uint8, np.uint16, np.uint32, np.int64)
#: A block's row is large, so row groups are measured after few rows; blobs have no dictionary.
_WRITER = {"parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "2", "parquet.enable.dictionary": "false"}
_LOOKUP = ("words", "first", "after")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); wraps modulo 2**64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(words: Sequence[str]) -> bytes:
    return b"".join([blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words])


def joined_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of what stands for (a, b), in this order."""
    salt = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    return mix64(mix64(a ^ salt) + b)


def pack(x: np.ndarray) -> bytes:
    """Counts in the smallest type that holds them, which the first byte names."""
    k = next(k for k, t in enumerate(_SMALLEST) if x.max(initial=0) <= np.iinfo(t).max)
    return bytes([k]) + x.astype(_SMALLEST[k]).tobytes()


def unpack(x: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(x, _SMALLEST[x[0]], offset=1).reshape(rows, -1).astype(np.int64)


def homes_of(keys: np.ndarray, homes: int) -> np.ndarray:
    return (((keys[:, 0] >> np.uint64(32)) * np.uint64(homes)) >> np.uint64(32)).astype(np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows with equal keys side by side, and where each key begins."""
    order = np.argsort(keys[:, 0])
    a, b = keys[order, 0], keys[order, 1]
    differ = b[1:] != b[:-1]
    if (differ & (a[1:] == a[:-1])).any():
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        a, b = keys[order, 0], keys[order, 1]
        differ = b[1:] != b[:-1]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), differ | (a[1:] != a[:-1])]))


def map_small_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of BATCH_BYTES at most; a smaller bound of the session stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def token_blocks(batches: Iterator[pa.RecordBatch], limit: int, size_of) -> Iterator[tuple[list[pa.RecordBatch], list[list[str]]]]:
    """(rows, their tokens) of about `limit` tokens; rows without tokens go. size_of(_fit) is how many tokens count, None for all."""
    rows, words, n = [], [], 0
    for batch in batches:
        picked = []
        for i, (text, flag) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_fit").to_pylist(), strict=True)):
            cap = size_of(flag)
            t = (text or "").split() if cap is None else (text or "").split(None, cap)[:cap]
            if not t:
                continue
            picked.append(i)
            words.append(t)
            n += len(t)
            if n >= limit:
                yield [*rows, batch.take(pa.array(picked))], words
                rows, words, picked, n = [], [], [], 0
        if picked:
            rows.append(batch.take(pa.array(picked)))
    if rows:
        yield rows, words


def numbered(words: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each token, the words, tokens of each text)."""
    ids = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in words], np.int64)
    w = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    return w, list(ids), sizes


def _block(rows: list[pa.RecordBatch], words: list[list[str]], names: list[str], models: int, max_length: int | None) -> list:
    """The columns of a block: its scored documents and tokens, its words and pairs, and their counts in each cohort."""
    w, vocabulary, sizes = numbered(words)
    v, starts = len(vocabulary), np.cumsum(sizes) - sizes
    prev = np.concatenate([[-1], w[:-1]])
    prev[starts] = -1
    pairs, place = np.unique((prev + 1) * v + w, return_inverse=True)
    table = pa.Table.from_batches(rows)
    flags = table.column("_fit").to_numpy()
    scored = flags & 1 == 1
    pos = np.arange(len(w)) - np.repeat(starts, sizes)
    used = np.repeat(scored, sizes)
    if max_length is not None:
        used &= pos < max_length
    of_words, of_pairs = [], []
    for k in range(models):
        fit = np.repeat(flags >> (k + 1) & 1 == 1, sizes)
        of_words += [np.bincount(w[fit], minlength=v), np.bincount(prev[fit & (prev >= 0)], minlength=v)]
        of_pairs.append(np.bincount(place[fit], minlength=len(pairs)))
    kept = table.select(names).filter(pa.array(scored)).combine_chunks()
    docs = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns], names=names)
    docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
    blob = lambda x: x.astype(np.int32).tobytes()
    length = sizes if max_length is None else np.minimum(sizes, max_length)
    first = int(np.searchsorted(pairs, v))  # pairs before it are first tokens
    return [docs, blob(length[scored]), blob(place[used]), word_keys(vocabulary), blob(pairs // v - 1), blob(pairs % v), pack(np.stack(of_words)), pack(np.stack(of_pairs)[:, first:]), v + len(pairs), [int(x.sum()) for x in of_words[::2]]]


def _keys(words: bytes, first: bytes, after: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the words, keys of the pairs that have a first word, first, after)."""
    w = np.frombuffer(words, np.uint64).reshape(-1, 2)
    a, b = np.frombuffer(first, np.int32).astype(np.int64), np.frombuffer(after, np.int32).astype(np.int64)
    at = int((a < 0).sum())
    return w, joined_keys(w[a[at:]], w[b[at:]]), a, b


def _blocks(frame: DataFrame, keep: Sequence[str], models: int, max_length: int | None) -> DataFrame:
    names = ["doc_id", *keep]
    binary = ["sizes", "tokens", "words", "first", "after", "word_counts", "pair_counts"]
    doc = StructType([StructField(n, frame.schema[n].dataType) for n in names])
    schema = StructType([StructField("block", LongType()), StructField("docs", ArrayType(doc)), *[StructField(c, BinaryType()) for c in binary], StructField("keys", LongType()), StructField("totals", ArrayType(LongType()))])

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        cap = lambda flag: max_length if flag == 1 else None  # noqa: E731  a cohort's documents count whole
        for k, (rows, words) in enumerate(token_blocks(batches, BLOCK_TOKENS, cap)):
            docs, *blobs, keys, totals = _block(rows, words, names, models, max_length)
            cells = [pa.array([at + k], pa.int64()), docs, *[pa.array([b], pa.binary()) for b in blobs], pa.array([keys], pa.int64()), pa.array([totals], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return materialise(map_small_batches(frame, run, schema), "blocks", **_WRITER)


def _counts(blocks: DataFrame, homes: int, models: int) -> DataFrame:
    """(block, home, counts) of what each block asked each home, in the block's order; block -1 has the numbers of words in each cohort."""

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words, pairs, _, _ = _keys(*[r[c] for c in _LOOKUP])
                cells = []
                for at, keys, counts in ((0, words, unpack(r["word_counts"], 2 * models)), (homes, pairs, unpack(r["pair_counts"], models))):
                    home = homes_of(keys, homes)
                    order = np.argsort(home, kind="stable")
                    keys, counts, ends = keys[order], counts[:, order], np.searchsorted(home[order], np.arange(homes + 1))
                    cells += [(at + h, keys[a:b].tobytes(), pack(counts[:, a:b])) for h, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
                home, keys, counts = zip(*cells, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(home), pa.int64()), pa.array(home, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["block", "home", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        home = table.column("home")[0].as_py()
        rows = 2 * models if home < homes else models
        keys = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in table.column("keys").to_pylist()]
        own = np.concatenate([unpack(c, rows) for c in table.column("counts").to_pylist()], axis=1)
        ends = np.cumsum([len(k) for k in keys])
        order, starts = grouped(np.concatenate(keys))
        total = np.add.reduceat(own[:, order], starts, axis=1)
        own[:, order] = np.repeat(total, np.diff(starts, append=len(order)), axis=1)
        back = [pack(x) for x in np.split(own, ends[:-1], axis=1)]
        blocks = table.column("block").to_pylist()
        if home < homes:
            blocks, back = [*blocks, -1], [*back, pack((total[::2] > 0).sum(axis=1))]
        return pa.table({"block": pa.array(blocks, pa.int64()), "home": pa.array([home] * len(back), pa.int32()), "counts": pa.array(back, pa.binary())})

    asked = map_small_batches(blocks.select("block", *_LOOKUP, "word_counts", "pair_counts"), ask, "block long, home int, keys binary, counts binary")
    return materialise(asked.groupBy("home").applyInArrow(answer, "block long, home int, counts binary"), "counts", **_WRITER)


def _back(answers: list[bytes], rows: int, keys: np.ndarray, homes: int) -> np.ndarray:
    """The homes' answers, in the order of homes, put in the order of the keys."""
    out = np.zeros((rows, len(keys)), np.int64)
    if answers:
        out[:, np.argsort(homes_of(keys, homes), kind="stable")] = np.concatenate([unpack(x, rows) for x in answers], axis=1)
    return out


def probabilities(frame: DataFrame, keep: Sequence[str], models: Sequence[tuple[float, float]], max_length: int | None = None) -> DataFrame:
    """(doc_id, keep.., pos, n_tokens, p_0, ..): each scored token's probability under each model (lam, alpha).

    frame: doc_id, keep.., text and _fit, whose bit 0 marks a scored document and bit k + 1 one of cohort k.
    max_length: only so many tokens of a document are scored (n_tokens, too, counts those).
    """
    spark, m = frame.sparkSession, len(models)
    blocks = _blocks(frame.select("doc_id", *keep, "text", F.col("_fit").cast("int").alias("_fit")), keep, m, max_length)
    known = blocks.agg(F.coalesce(F.sum("keys"), F.lit(0)), *[F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)) for k in range(m)]).first()
    homes = max(spark.sparkContext.defaultParallelism, -(-known[0] // HOME_KEYS))
    counts = _counts(blocks, homes, m)
    types = sum((unpack(r["counts"], 1)[0] for r in counts.where("block = -1").collect()), np.zeros(m, np.int64))  # a row a home
    constants = [(float(known[k + 1]), float(types[k]), *models[k]) for k in range(m)]
    names = ["doc_id", *keep]
    schema = StructType([*[StructField(n, frame.schema[n].dataType) for n in names], StructField("pos", IntegerType()), StructField("n_tokens", IntegerType())])
    for k in range(m):
        schema = schema.add(f"p_{k}", "double")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                words, pairs, first, after = _keys(*[get(c) for c in _LOOKUP])
                answers = sorted((x["home"], x["counts"]) for x in get("answers"))
                of_words = _back([c for h, c in answers if h < homes], 2 * m, words, homes)
                of_pairs = _back([c for h, c in answers if h >= homes], m, pairs, homes)
                at, tokens, sizes = len(first) - len(pairs), np.frombuffer(get("tokens"), np.int32), np.frombuffer(get("sizes"), np.int32)
                p = []
                for k, (n, v, lam, alpha) in enumerate(constants):
                    x = ((of_words[2 * k] + alpha) / (n + alpha * (v + 1)))[after]
                    before = of_words[2 * k + 1][first[at:]]
                    seen = before > 0
                    x[at:][seen] = lam * of_pairs[k][seen] / before[seen] + (1 - lam) * x[at:][seen]
                    p.append(x[tokens])
                docs, row = batch.column("docs")[i].values, pa.array(np.repeat(np.arange(len(sizes)), sizes))
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                cells = [docs.field(n).take(row) for n in names] + [pa.array(pos.astype(np.int32)), pa.array(np.repeat(sizes, sizes)), *map(pa.array, p)]
                for a in range(0, len(pos), 1 << 15):
                    yield pa.RecordBatch.from_arrays([c[a : a + (1 << 15)] for c in cells], names=schema.names)

    answers = counts.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("home", "counts")).alias("answers"))
    scored = blocks.select("block", "docs", "sizes", "tokens", *_LOOKUP).where(F.size("docs") > 0).join(answers, "block")
    return map_small_batches(scored, run, schema)


def marked(docs: DataFrame, fits: Sequence[Column | str]) -> DataFrame:
    """docs, all to be scored, with _fit for cohorts that are conditions on docs."""
    flag = F.lit(1)
    for k, c in enumerate(fits):
        flag = flag + F.when(F.expr(c) if isinstance(c, str) else c, 2 << k).otherwise(0)
    return docs.withColumn("_fit", flag)
