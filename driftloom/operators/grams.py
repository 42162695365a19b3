"""Counts of words and n-grams by cohort, combined in blocks of documents before anything is shuffled."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from driftloom.operators.bigrams import BLOCK_TOKENS, HOME_KEYS, grouped, homes_of, joined_keys, map_small_batches, numbered, pack, token_blocks, unpack, word_keys

#: What a home sums up for each cohort; n-grams up to RARE occurrences are rare.
SUMS, RARE = ("total", "types", "weighted", "hapax", "rare"), 5


def _cohorts(rows: list[pa.RecordBatch], by: Sequence[str]) -> tuple[np.ndarray, pa.Table, list[tuple]]:
    """(each row's cohort, a row a cohort, their values)."""
    table = pa.Table.from_batches(rows).select(list(by))
    values = list(zip(*[c.to_pylist() for c in table.columns], strict=True)) if by else [()] * sum(r.num_rows for r in rows)
    number, first = {}, []
    of = np.empty(len(values), np.int64)
    for i, v in enumerate(values):
        if v not in number:
            number[v] = len(first)
            first.append(i)
        of[i] = number[v]
    return of, table.take(pa.array(first)), list(number)


def word_counts(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., ngram, cnt) of words: each block of documents gives a row for each of its distinct words and cohorts."""
    schema = StructType([*[docs.schema[c] for c in by], StructField("ngram", StringType()), StructField("cnt", LongType())])

    def run(batches):
        for rows, words in token_blocks(batches, BLOCK_TOKENS, lambda flag: None):
            w, vocabulary, sizes = numbered(words)
            of, table, _ = _cohorts(rows, by)
            codes, cnt = np.unique(np.repeat(of, sizes) * len(vocabulary) + w, return_counts=True)
            cohort, word = pa.array(codes // len(vocabulary)), pa.array(codes % len(vocabulary))
            cells = [c.combine_chunks().take(cohort) for c in table.columns] + [pa.array(vocabulary, pa.string()).take(word), pa.array(cnt, pa.int64())]
            for a in range(0, len(codes), 1 << 15):
                yield pa.RecordBatch.from_arrays([c[a : a + (1 << 15)] for c in cells], names=schema.names)

    counts = map_small_batches(docs.select(*by, "text", F.lit(0).alias("_fit")), run, schema)
    return counts.groupBy(*by, "ngram").agg(F.sum("cnt").alias("cnt"))


def _distinct(w: np.ndarray, size: int, n: int, keys: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cohorts, keys, counts) of a block's distinct n-grams by cohort; w numbers its words, keys has theirs."""
    words, left = keys, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(w))  # tokens from here to the document's end
    place = w
    for k in range(1, n):
        at = np.flatnonzero(left > k)
        codes, inverse = np.unique(place[at] * size + w[at + k], return_inverse=True)
        keys = joined_keys(keys[codes // size], words[codes % size])
        place = np.full(len(w), -1, np.int64)
        place[at] = inverse
    real = place >= 0
    codes, counts = np.unique(np.repeat(of, sizes)[real] * max(1, len(keys)) + place[real], return_counts=True)
    return codes // max(1, len(keys)), keys[codes % max(1, len(keys))], counts


def shape_sums(docs: DataFrame, by: Sequence[str], n: int, expected: int) -> DataFrame:
    """(by.., total, types, weighted, hapax, rare) of the n-grams of each cohort, weighted being the sum of cnt log2 cnt.

    expected: about how many n-grams there are; it sets the number of homes, each of which counts its keys in memory.
    """
    homes = max(docs.sparkSession.sparkContext.defaultParallelism, -(-expected // HOME_KEYS))
    cohort = StructType([StructField("_none", IntegerType()), *[docs.schema[c] for c in by]])
    names = [f.name for f in cohort]
    sent = StructType([StructField("home", IntegerType()), StructField("cohorts", ArrayType(cohort)), StructField("of", BinaryType()), StructField("keys", BinaryType()), StructField("counts", BinaryType())])

    def ask(batches):
        for rows, words in token_blocks(batches, BLOCK_TOKENS, lambda flag: None):
            w, vocabulary, sizes = numbered(words)
            of, table, values = _cohorts(rows, by)
            own = np.frombuffer(b"".join(blake2b(repr(v).encode("utf-8", "surrogatepass"), digest_size=16).digest() for v in values), np.uint64).reshape(-1, 2)
            k, keys, counts = _distinct(w, len(vocabulary), n, np.frombuffer(word_keys(vocabulary), np.uint64).reshape(-1, 2), sizes, of)
            keys = joined_keys(keys, own[k])
            home = homes_of(keys, homes)
            order = np.argsort(home, kind="stable")
            k, keys, counts, ends = k[order], keys[order], counts[order], np.searchsorted(home[order], np.arange(homes + 1))
            spans = [(h, a, b) for h, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            every = pa.StructArray.from_arrays([pa.nulls(len(values), pa.int32()), *[c.combine_chunks() for c in table.columns]], names=names)
            for a in range(0, len(spans), 64):
                few, picked, cohorts = spans[a : a + 64], [], [0]
                cells = []
                for h, i, j in few:
                    used, local = np.unique(k[i:j], return_inverse=True)
                    picked.append(used)
                    cohorts.append(cohorts[-1] + len(used))
                    cells.append((h, pack(local), keys[i:j].tobytes(), pack(counts[i:j])))
                h, local, key, cnt = zip(*cells, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(cohorts, pa.int32()), every.take(pa.array(np.concatenate(picked))))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), lists, pa.array(local, pa.binary()), pa.array(key, pa.binary()), pa.array(cnt, pa.binary())], names=sent.names)

    out = StructType([*[docs.schema[c] for c in by], *[StructField(c, DoubleType() if c == "weighted" else LongType()) for c in SUMS]])

    def answer(table: pa.Table) -> pa.Table:
        lists = table.column("cohorts").combine_chunks()
        values = lists.flatten()
        number, first, of = {}, [], np.empty(len(values), np.int64)
        for i, v in enumerate(zip(*[values.field(c).to_pylist() for c in names], strict=True)):
            if v not in number:
                number[v] = len(first)
                first.append(i)
            of[i] = number[v]
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        cohort = np.concatenate([of[s + unpack(x, 1)[0]] for s, x in zip(starts, table.column("of").to_pylist(), strict=False)])
        keys = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([unpack(x, 1)[0] for x in table.column("counts").to_pylist()])
        order, begin = grouped(keys)
        cnt, c = np.add.reduceat(counts[order], begin), cohort[order[begin]]
        sums = [np.bincount(c, x, minlength=len(first)) for x in (cnt, np.ones(len(cnt)), cnt * np.log2(cnt), cnt == 1, cnt <= RARE)]
        cells = [values.field(name).take(pa.array(first)) for name in names[1:]]
        return pa.table([*cells, *[pa.array(x if s == "weighted" else x.astype(np.int64)) for s, x in zip(SUMS, sums, strict=True)]], names=out.names)

    parts = map_small_batches(docs.select(*by, "text", F.lit(0).alias("_fit")), ask, sent).groupBy("home").applyInArrow(answer, out)
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])
