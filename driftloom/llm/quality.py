"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import eq, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.scratch import discard

from .common import arrow_map, give_back, materialise
from .grams import BITS, code_points, letter_codes, shape_codes, trigrams

#: Labelled rows that the model may use: the bound of what is broadcast (TRAIN_ROWS x RANK floats).
TRAIN_ROWS = 4000
#: Buckets of the hashed terms; steps of a repetition term; rank of the latent space; neighbours that vote.
HASHED, STEPS, RANK, NEIGHBOURS = 4096, 16, 48, 25
BUCKETS = HASHED + 2 * STEPS
#: Power of the cosine that weighs a vote.
POWER = 8
#: What a reached step counts: about as much as a term of a long text.
STEP_COUNT = 400
BLOCK = 128
_CODES: dict[str, np.ndarray] = {}


def term_counts(text: str) -> np.ndarray:
    """Counts of the terms of the whole text: hashed shape trigrams, hashed letter trigrams, and repetition.

    Repetition terms are steps: the k-th is there if over k / (STEPS + 1) of the words
    equal the word before them, or of the lines stood before. Trigrams alone cannot tell
    a word that is said twenty times from a text about it.
    """
    if not _CODES:
        _CODES.update(letters=letter_codes(), shapes=shape_codes())
    half = HASHED // 2
    out = np.zeros(BUCKETS)
    for at in range(0, len(text), 1 << 20):
        cps = code_points(text[max(0, at - 2) : at + (1 << 20)])
        skip = 2 if at else 0
        for k, name in enumerate(("shapes", "letters")):
            g = trigrams(_CODES[name][cps])[skip:]
            out[k * half : (k + 1) * half] += np.bincount((g * np.uint32(2654435761) >> np.uint32(32 - 11)).astype(np.int64) % half, minlength=half)
    words = text.split()
    lines = [x for x in text.split("\n") if len(x) > 3]
    shares = sum(map(eq, words, words[1:])) / max(len(words) - 1, 1), 1 - len(set(lines)) / max(len(lines), 1)
    for k, share in enumerate(shares):
        out[HASHED + k * STEPS : HASHED + k * STEPS + int(share * (STEPS + 1))] = STEP_COUNT
    return out


def _direction(weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vector of a row of term weights in the latent space, or zeros; summed term by term."""
    terms = np.flatnonzero(weights)
    x = weights[terms].astype(np.float64)
    size = np.sqrt((x * x).sum())
    v = ((x / size)[:, None] * axes[terms]).sum(axis=0) if size > 0 else np.zeros(axes.shape[1])
    size = np.sqrt((v * v).sum())
    return v / size if size > 1e-9 else np.zeros(axes.shape[1])


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray  # terms x RANK
    vectors: np.ndarray  # labelled rows x RANK, unit length
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of term counts, or zeros. Each row is summed by itself in a fixed order: what it is batched with changes nothing."""
        return np.array([_direction(np.log1p(c.astype(np.float64)) * self.idf, self.axes) for c in counts]).reshape(len(counts), -1)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Share of label 1 among the NEIGHBOURS nearest labelled vectors, each weighted by the eighth power of its cosine.

        Ties go to the labelled row that comes first. The blocked product tells who may be
        among the nearest; their cosines are then summed in a fixed order.
        """
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        k, out = min(NEIGHBOURS, len(self.labels)), np.zeros(len(vectors))
        product = vectors @ self.vectors.T
        least = np.partition(product, -k, axis=1)[:, -k] - 1e-9
        for i, (v, row) in enumerate(zip(vectors, product, strict=True)):
            may = np.flatnonzero(row >= least[i])
            cos = (self.vectors[may] * v).sum(axis=1)
            near = np.lexsort((may, -cos))[:k]
            weight = np.maximum(cos[near], 0) ** POWER
            # one neighbour's worth of the prior keeps votes of nothing near defined
            out[i] = ((weight * self.labels[may[near]]).sum() + 0.05 * self.prior) / (weight.sum() + 0.05)
        return out


def fit(rows: list[tuple[str, int]], rank: int = RANK) -> QualityModel:
    """Latent-semantic axes (truncated SVD of TF-IDF rows) and the labelled vectors in them."""
    labels = np.array([y for _, y in rows], dtype=np.float64)
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(rows):
        return QualityModel(np.ones(BUCKETS), np.zeros((BUCKETS, 1)), np.zeros((0, 1)), labels, prior)
    x = np.empty((len(rows), BUCKETS), np.float32)  # 66 MB at most
    for row, (text, _) in zip(x, rows, strict=True):
        row[:] = term_counts(text)
    idf = np.log((1 + len(rows)) / (1 + np.count_nonzero(x, axis=0))) + 1
    np.log1p(x, out=x)
    x *= idf.astype(np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    # randomised range finder with two power steps, then an SVD of the small matrix
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(3).standard_normal((len(x), min(rank + 16, len(x)))).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt[:rank].T).astype(np.float64)
    vectors = np.array([_direction(row, axes) for row in x])
    del x
    give_back()
    return QualityModel(idf, axes, vectors, labels, prior)


def training_rows(docs: DataFrame, labels: DataFrame, usable=None, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[str, int]]:
    """At most `rows` labelled texts, half of them of each label at most: those that come first by a hash of the id, then by id and text.

    usable: a condition on `doc_id` of rows that may be learned from. Null labels, labels
    other than 0 and 1 and null texts teach nothing; ids that are labelled twice count
    with their smallest label; rows equal in id and text count once.
    """
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    ids = ids if usable is None else ids.where(usable)
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 30)))
    ids = materialise(ids, "labelled")
    counts = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t is not null")
    first, want = Window.partitionBy("y").orderBy("h", "doc_id", "t"), rows // 2
    shares, chosen = {y: (want * 1.3 + 100) / n for y, n in counts.items()}, {}
    while shares:  # ids below a bound, so that about the wanted number is joined; more where too few of them have texts
        below = reduce(or_, [(F.col("y") == y) & (F.col("h") < min(1.0, x) * (1 << 30)) for y, x in shares.items()])
        few = ids.where(below)
        small = sum(x * counts[y] for y, x in shares.items()) < 16 * rows
        found = lean.join(F.broadcast(few) if small else few, "doc_id").dropDuplicates(["doc_id", "t"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= want)
        got: dict[int, list] = {y: [] for y in shares}
        for r in found.select("doc_id", "t", "y").collect():
            got[r.y].append(tuple(r))
        chosen |= {y: x for y, x in got.items() if len(x) == want or shares[y] >= 1}
        shares = {y: 4 * x for y, x in shares.items() if y not in chosen}
    discard(ids)
    return [(t, y) for _, t, y in sorted(x for xs in chosen.values() for x in xs)]


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col: the weighted vote of the labelled neighbours of the whole text, 0 to 1.

    Null and empty texts have no direction in the latent space and get the training
    rows' share of label 1. Every row stays, with all its columns; a column named
    score_col is replaced.
    """
    base = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = base.columns.index(text_col), base.columns

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = []
        for i in range(0, len(batch), BLOCK):
            counts = np.array([term_counts(t.as_py() or "") for t in batch.column(at)[i : i + BLOCK]])
            scores.append(shared.value.vote(shared.value.embed(counts)))
        found = np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, score_col])

    return arrow_map(base, apply, base.withColumn(score_col, F.lit(0.0)).schema)
