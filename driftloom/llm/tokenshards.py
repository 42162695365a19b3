"""Token shards in training order: a keyed Feistel permutation gives every sequence its slot, ranges of slots are files of fixed stride."""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.scratch import discard, own_shuffles

from .common import arrow_map, map_batches, materialise, scratch_path
from .pieces import MODEL_FILE, SPACE
from .sharding import Feistel

#: Fills the end of a document's last sequence; no token has this id.
PAD = 65535
#: Words that a worker may remember, and as many older ones.
CACHE = 100_000
#: Passes over the stored tokens that write the shards: the shuffle on disk is that fraction of them.
GROUPS = 2
#: File beside the shards that tells of what they were made.
FINGERPRINT = "_made_of"


@dataclass(frozen=True)
class Layout:
    """Where things stand: a record is `length` little-endian uint16 ids and one line feed; `per_shard` records are a file."""

    length: int = 128
    per_shard: int = 65_536
    key: int = 29

    @property
    def stride(self) -> int:
        return 2 * self.length + 1


class PieceTokens:
    """Ids of whole texts by a SentencePiece model, then the end-of-text id.

    No piece of such a model has a blank after another character, so single blanks part
    the text into words that are encoded alone and remembered; texts with runs of blanks,
    or blanks at an end, go to the library whole.
    """

    def __init__(self, model_file: str = MODEL_FILE):
        with open(model_file, "rb") as f:
            self.model = f.read()
        self._load()
        if self.library.get_piece_size() >= PAD:
            raise ValueError("ids must fit in 16 bits")

    def _load(self) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.end = self.library.eos_id()
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in map(self.library.id_to_piece, range(self.library.get_piece_size())))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {"model": self.model}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._load()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """uint16 ids of each text, the end-of-text id last. Words not known yet are encoded together."""
        split = [t.split(" ") if t and self.apart and "  " not in t and t[0] != " " and t[-1] != " " and SPACE not in t else None for t in texts]
        known, older, end = self.known, self.older, array("H", [self.end]).tobytes()
        fresh = {w for ws in filter(None, split) for w in ws if w not in known}
        known.update((w, older[w]) for w in fresh if w in older)
        words = [w for w in fresh if w not in known]
        known.update(zip(words, map(_packed, self.library.encode(words, num_threads=1)), strict=True))
        odd = iter(self.library.encode([t for t, ws in zip(texts, split, strict=True) if ws is None], num_threads=1))
        out = [(_packed(next(odd)) if ws is None else b"".join(map(known.__getitem__, ws))) + end for ws in split]
        for w in (w for w in words if len(w) > 64):
            del known[w]
        if len(known) > CACHE:  # what is not asked for again goes with the older half
            self.older, self.known = known, {}
        return out


def _packed(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


def tokenise(docs: DataFrame, tokens: PieceTokens, layout: Layout, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, crc, n_tokens, crcs, ids) of every row with a text; ids are compressed uint16s, end-of-text last; crcs are those of its records."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    step = 2 * layout.length

    def apply(batch: pa.RecordBatch):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for i in range(0, len(batch), 512):
            part = batch.slice(i, 512)
            data = shared.value(part.column(1).to_pylist())
            crcs = [array("I", [zlib.crc32(r) for r in records(d, step)]).tobytes() for d in data]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array([len(d) // 2 for d in data], pa.int64()), pa.array(crcs, pa.binary()), pa.array([pack(d) for d in data], pa.binary())],
                names=["doc_id", "crc", "n_tokens", "crcs", "ids"],
            )

    return arrow_map(lean, apply, f"doc_id {lean.schema[0].dataType.simpleString()}, crc long, n_tokens long, crcs binary, ids binary")


def records(data: bytes, step: int) -> list[bytes]:
    """The ids in pieces of `step` bytes, the last one filled with PAD."""
    data += b"\xff" * (-len(data) % step)
    return [data[a : a + step] for a in range(0, len(data), step)]


#: The order of documents: ids may be null; texts of one id are told apart by their ids' digests.
ORDER = ["doc_id", "crc", "n_tokens", "digest"]


def _placed(stored: DataFrame, layout: Layout) -> tuple[DataFrame, dict[int, int], int]:
    """stored in ORDER, with `part` and `first`; first + starts[part] is the number of a document's first sequence. And the total.

    Range partitions are written once, each with its own running numbers; one number per
    partition comes to the driver. Rows equal in ORDER may swap numbers: they are equal.
    """
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096))  # deals out repeated rows
    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    ranged = stored.withColumn("digest", F.xxhash64("ids")).withColumn("_spread", spread).repartitionByRange(*keys, "_spread")
    sorted_ = ranged.drop("_spread").sortWithinPartitions(*keys)
    names, at = [*sorted_.columns, "part", "first"], sorted_.columns.index("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            width = -(-batch.column(at).to_numpy() // layout.length)
            end = start + np.cumsum(width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(end - width)], names=names)
            start = int(end[-1]) if len(end) else start

    placed = materialise(map_batches(sorted_, run, T.StructType([*sorted_.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType())])), "token-docs")
    ends = placed.groupBy("part").agg(F.max(F.col("first") + F.ceil(F.col("n_tokens") / layout.length)).alias("n")).collect()
    starts, total = {}, 0
    for part, n in sorted(map(tuple, ends)):
        starts[part] = total
        total += n
    return placed, starts, total


def _slots(batch: pa.RecordBatch, starts: dict[int, int], order: Feistel, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the documents' sequences, one after another: the row of the batch, the place in its document, the global slot."""
    n, part, first = (batch.column(c).to_numpy() for c in ("n_tokens", "part", "first"))
    begin = first + np.array([starts[p] for p in part.tolist()], np.int64)
    width = -(-n // layout.length)
    row = np.repeat(np.arange(len(n)), width)
    seq = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    return row, seq, order.permute(begin[row] + seq) if len(row) else np.zeros(0, np.int64)


def _records(placed: DataFrame, starts: dict[int, int], layout: Layout, total: int, low: int, high: int) -> DataFrame:
    """(shard, slot, record) of the sequences of shards low .. high - 1."""

    def apply(batch: pa.RecordBatch):
        import zstandard

        unpack, order, stride = zstandard.ZstdDecompressor().decompress, Feistel(total, layout.key), 2 * layout.length
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            _, _, where = _slots(part, starts, order, layout)
            n = part.column("n_tokens").to_numpy()
            width = -(-n // layout.length)
            body = np.full(len(where) * layout.length, PAD, "<u2")
            # ids stand one after another; each document's go to where its first sequence begins
            shift = (np.cumsum(width) - width) * layout.length - (np.cumsum(n) - n)
            ids = np.frombuffer(b"".join(map(unpack, part.column("ids").to_pylist())), "<u2")
            body[np.arange(len(ids)) + np.repeat(shift, n)] = ids
            mine = np.flatnonzero((where >= low * layout.per_shard) & (where < high * layout.per_shard))
            where, body = where[mine], body.reshape(-1, layout.length)[mine]
            ends = pa.py_buffer(np.arange(len(mine) + 1, dtype=np.int32) * stride)
            yield pa.RecordBatch.from_arrays([pa.array(where // layout.per_shard, pa.int32()), pa.array(where % layout.per_shard), pa.Array.from_buffers(pa.binary(), len(mine), [None, ends, pa.py_buffer(body)])], names=["shard", "slot", "record"])

    return arrow_map(placed.select("n_tokens", "part", "first", "ids"), apply, "shard int, slot long, record binary")


def _index(placed: DataFrame, starts: dict[int, int], layout: Layout, total: int) -> DataFrame:
    def apply(batch: pa.RecordBatch):
        order = Feistel(total, layout.key)
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            row, seq, where = _slots(part, starts, order, layout)
            left = part.column("n_tokens").to_numpy()[row] - seq * layout.length
            crcs = np.frombuffer(b"".join(part.column("crcs").to_pylist()), "<u4")
            slot = where % layout.per_shard
            yield pa.RecordBatch.from_arrays(
                [pa.array(where // layout.per_shard, pa.int32()), pa.array(slot), pa.array(where), pa.array(slot * layout.stride), part.column("doc_id").take(pa.array(row)), pa.array(seq), pa.array(np.minimum(left, layout.length), pa.int32()), pa.array(crcs, pa.int64())],
                names=["shard", "slot", "global_slot", "byte_offset", "doc_id", "seq_no", "n_tokens", "record_crc32"],
            )

    id_type = placed.schema["doc_id"].dataType.simpleString()
    return arrow_map(placed.select("doc_id", "n_tokens", "part", "first", "crcs"), apply, f"shard int, slot long, global_slot long, byte_offset long, doc_id {id_type}, seq_no long, n_tokens int, record_crc32 long")


def write_token_shards(docs: DataFrame, path: str | None = None, tokens: PieceTokens | None = None, layout: Layout = Layout(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Write all documents' tokens as shards of fixed stride in training order; returns (index, path).

    Every text, with the end-of-text id after it, is cut into sequences of layout.length
    ids, the last one filled with PAD. Sequences are numbered by (doc_id, crc32 of the
    ids, number of ids, digest of the ids, place), null ids first; a Feistel permutation keyed by layout.key gives each its global slot, so
    slot s is record s mod per_shard of shard s div per_shard, at a computable byte: a
    reader may stop and go on anywhere. The order depends on the rows and the key alone.
    Spark's committer writes each shard as one file, so lost tasks are redone whole; a run
    that is given the path of one that broke off writes only the groups that lack. The path
    keeps a fingerprint of rows, layout and model; shards of others there are an error.

    Null texts have no sequences; an empty text has one, with the end-of-text id. Texts
    with a null id are written like others; ids may have any type that sorts. Equal rows have sequences each. An empty table writes an empty folder. Other columns are
    ignored. The index has a row per sequence: shard, slot, global_slot, byte_offset,
    doc_id, seq_no, n_tokens, record_crc32.
    """
    spark = docs.sparkSession
    path, tokens = path or scratch_path(spark, "token-shards"), tokens or PieceTokens()
    stored = materialise(tokenise(docs, tokens, layout, id_col, text_col), "tokens")
    placed, starts, total = _placed(stored, layout)
    discard(stored)
    facts = placed.agg(F.sum(F.xxhash64(*ORDER).cast("decimal(38,0)"))).first()[0]
    _claim(spark, path, f"{hashlib.sha256(tokens.model).hexdigest()} {layout} {total} {facts}")
    shards = max(1, -(-total // layout.per_shard))
    # in groups of shards, so that the shuffle files of one group exist at a time; a group that is there is not written again
    size = -(-shards // GROUPS)
    for low in range(0, shards, size):
        high = min(low + size, shards)
        if not _exists(spark, f"{path}/from-{low:08d}/_SUCCESS"):
            dealt = _records(placed, starts, layout, total, low, high).repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("slot")
            with own_shuffles(spark):
                dealt.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").text(f"{path}/from-{low:08d}")
    lean = materialise(placed.drop("ids"), "token-index")
    discard(placed)
    return _index(lean, starts, layout, total), path


def _claim(spark: SparkSession, path: str, facts: str) -> None:
    """Leave the fingerprint in path, or raise where shards with another one are."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{FINGERPRINT}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        stream = fs.open(at)
        old = bytes(stream.readAllBytes()).decode()
        stream.close()
        if old != facts:
            raise ValueError(f"{path} has shards of other rows, another layout or another model")
    else:
        stream = fs.create(at)
        stream.write(facts.encode())
        stream.close()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_slots(spark: SparkSession, path: str, layout: Layout, first: int, count: int) -> list[np.ndarray]:
    """The ids (without PAD) of slots first .. first + count - 1, read by seeking. Files: from-<first shard>/part-<shard - first>."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    groups = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("from-")]
    names = {int(g.getName()[5:]) + int(s.getPath().getName()[5:10]): s.getPath() for g in groups for s in fs.listStatus(g) if s.getPath().getName().startswith("part-")}
    out = []
    for shard in range(first // layout.per_shard, (first + count - 1) // layout.per_shard + 1):
        if shard not in names:
            continue
        low = max(first, shard * layout.per_shard) - shard * layout.per_shard
        high = min(first + count, (shard + 1) * layout.per_shard) - shard * layout.per_shard
        size = fs.getFileStatus(names[shard]).getLen() // layout.stride
        high = min(high, size)
        stream = fs.open(names[shard])
        stream.seek(low * layout.stride)
        data = bytes(stream.readNBytes((high - low) * layout.stride)) if high > low else b""
        stream.close()
        for a in range(0, len(data), layout.stride):
            ids = np.frombuffer(data[a : a + layout.stride - 1], "<u2")
            out.append(ids[ids != PAD])
    return out
