"""Shared pieces: tables, the scratch folder, word hashing, Arrow mapping."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.numbering import number_rows
from driftloom.scratch import broadcast_if_small, materialise, scratch_path
from driftloom.sources.readers import table

__all__ = ["WordHashes", "arrow_map", "broadcast_if_small", "crc_mod", "free_name", "give_back", "hash64", "map_batches", "materialise", "mix64", "number_rows", "scratch_path", "table"]

#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
#: Entries a worker's word cache may hold before it is emptied.
CACHE_ENTRIES = 150_000


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of BATCH_BYTES at most.

    Executors and workers hold a batch at a time, in Arrow's own memory outside the heap;
    with Spark's default that can be all of a partition. The bound is a setting of the
    session; a smaller one stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(trimmed, schema)


def give_back() -> None:
    """Return freed memory to the system: workers and the driver live on, and Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches):
        for b in batches:
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return map_batches(df, run, schema)


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = hash64(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); wraps modulo 2**64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
