"""Sharding by a keyed Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, number_rows


class Feistel:
    """A keyed permutation of 0..n-1.

    A balanced Feistel network permutes the smallest square power of two that holds n;
    values that fall outside are walked along their cycle until they are inside. The
    domain is below 4n, so a walk takes fewer than four steps on average.
    """

    def __init__(self, n: int, key: int = 0, rounds: int = 6):
        self.n, self.key, self.rounds = n, key, rounds
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(k) for k in mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (1 << 64) - 1))]

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        mask, half = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        return (right << half) | left  # halves swap after the last round, so reversed keys invert it

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), keys)
        outside = np.flatnonzero(out >= np.uint64(self.n))
        while outside.size:
            moved = self._once(out[outside], keys)
            out[outside] = moved
            outside = outside[moved >= np.uint64(self.n)]
        return out.astype(np.int64)

    def permute(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def invert(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, self.keys[::-1])


def permute_column(df: DataFrame, n: int, key: int, source: str = "row_no", target: str = "global_slot") -> DataFrame:
    """Append target = Feistel(n, key) of the long column source."""
    schema = df.withColumn(target, F.lit(0).cast("long")).schema
    names = df.columns

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(names.index(source)).to_numpy(zero_copy_only=False)
        slots = Feistel(n, key).permute(rows) if len(rows) else rows.astype(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots, pa.int64())], names=[*names, target])

    return arrow_map(df, apply, schema)


def shard_rows(docs: DataFrame, shards: int = 8, key: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row to a shard and a slot there, under the law `rows`.

    Rows are numbered in the order of (id, crc32 of the text, size); the permuted number p
    gives shard = p mod shards and slot = p div shards, so shard sizes differ by one at
    most, slots are gapless from 0 and both can be computed, or inverted, without the data.
    The result depends on the rows alone, not on files or partitions.

    Null text: size 1 and the crc32 of nothing, 0. Empty text: the same. Null ids come first. Rows
    equal in id and text may swap slots. An empty table gives no rows. Only the id and
    text columns are read.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    lean = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    numbered, n = number_rows(lean, ["doc_id", "text_crc32", "size"], "shard-rows")
    placed = permute_column(numbered, n, key)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("global_slot") % shards).cast("int").alias("shard"),
        F.floor(F.col("global_slot") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "global_slot", "row_no",
    )
