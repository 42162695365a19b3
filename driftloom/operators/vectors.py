"""Embedding geometry."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.numbering import number_rows
from driftloom.scratch import materialise

#: Bytes of baseline vectors that a broadcast may hold; larger baselines are taken in blocks, one after another.
BASE_BYTES = 64 << 20
#: Numbers that an array of differences or distances may hold in a worker.
CELLS = 1 << 23


class Embedder(Protocol):
    """Turns (doc_id, text) rows into (id, vec) rows; its parameters must not change between cohorts."""

    def embed(self, docs: DataFrame) -> DataFrame: ...


class HashedEmbedder:
    """Stand-in for a sentence encoder: hashed term frequencies. Labelled as such wherever results are shown."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, docs: DataFrame) -> DataFrame:
        from driftloom.functions.text import tokens

        slot = F.pmod(F.xxhash64(F.lower("w")), F.lit(self.dims))
        terms = docs.select(F.col("doc_id").alias("id"), F.explode(tokens(F.col("text"))).alias("w")).groupBy("id", slot.alias("d")).count()
        m = terms.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", F.col("count").cast("double")))).alias("m"))  # at most dims entries
        vec = F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)))
        return m.select("id", vec.alias("vec"))


def as_double(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, F.col(vec).cast("array<double>"))


def cosine_diversity(df: DataFrame, by: Sequence[str] = (), vec: str = "vec") -> DataFrame:
    """(by, n, avg_cos_dist): mean cosine distance over all pairs, in one pass.

    The sum over pairs of unit vectors is (|sum u|^2 - sum |u|^2) / 2, so sums per dimension
    are enough; a zero vector stays zero. Null below two vectors.
    """
    v = as_double(df.select(*by, F.col(vec).alias("v")), "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = v.select(*by, F.transform("v", lambda x: x / F.when(norm > 0, norm).otherwise(1.0)).alias("u"))
    dims = unit.select(*by, F.posexplode("u").alias("d", "x")).groupBy(*by, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    n = F.max("n")
    cos = (F.sum(F.col("s") ** 2) - F.sum("q")) / F.when(n > 1, n * (n - 1))
    return dims.groupBy(*by).agg(n.alias("n"), (1 - cos).alias("avg_cos_dist"))


def fit_pca(df: DataFrame, k: int, vec: str = "vec") -> dict:
    """mean, components (k x d) and explained ratios. Signs: the largest entry of a component, and the first entry of the first one, is positive."""
    rows = as_double(df.select(F.col(vec).alias("v")), "v").select(array_to_vector("v").alias("v"))
    mean = rows.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    comps = model.pc.toArray().T.copy()
    for i, c in enumerate(comps):
        if c[np.argmax(np.abs(c))] < 0:
            comps[i] = -c
    if comps[0][0] < 0:
        comps[0] = -comps[0]
    return {"mean": mean, "components": comps, "ratios": model.explainedVariance.toArray()}


def project(df: DataFrame, pca: dict, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Centred projection: column expressions over literals of the model."""
    w = F.lit([[float(x) for x in c] for c in pca["components"]])
    mean = F.lit([float(x) for x in pca["mean"]])
    centred = F.zip_with(F.col(vec).cast("array<double>"), mean, lambda a, b: a - b)
    return df.withColumn(out, F.transform(w, lambda c: F.aggregate(F.zip_with(c, centred, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def variance_dim(df: DataFrame, dims: int, share: float = 0.95, vec: str = "vec") -> int:
    """Components needed for the share of variance."""
    return int(np.searchsorted(np.cumsum(fit_pca(df, dims, vec)["ratios"]), share) + 1)


class Base:
    """A baseline of any size: frame (id, keep.., vec), n rows of dims numbers; iterating gives blocks (ids, vectors, *keep) that may be broadcast."""

    def __init__(self, df: DataFrame, vec: str = "vec", keep: Sequence[str] = (), order: Sequence[str] = ("id",)):
        self.frame, self.keep, self.order = as_double(df.select("id", *keep, F.col(vec).alias("vec"))), keep, order
        first = self.frame.select(F.size("vec").alias("n")).first()
        self.n, self.dims = self.frame.count(), first["n"] if first else 0
        self.blocks = max(1, -(-self.n * (self.dims * 8 + 8) // BASE_BYTES))
        if self.blocks > 1:
            self.frame = materialise(self.frame.withColumn("_place", F.monotonically_increasing_id()), "base")

    def __iter__(self) -> Iterator[tuple[np.ndarray, ...]]:
        for k in range(self.blocks):
            part = self.frame if self.blocks == 1 else self.frame.where(F.pmod(F.xxhash64("_place"), F.lit(self.blocks)) == k)
            rows = part.orderBy(*self.order).toPandas()
            points = np.array(rows["vec"].tolist(), dtype=np.float64).reshape(len(rows), self.dims)
            yield rows["id"].to_numpy(), points, *[rows[c].to_numpy() for c in self.keep]


def parts(block: tuple[np.ndarray, ...], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The block in slices of so many rows."""
    for a in range(0, len(block[0]), max(1, width)):
        yield tuple(c[a : a + max(1, width)] for c in block)


def map_against(df: DataFrame, base: Base, fn: Callable[[dict[str, np.ndarray], np.ndarray, tuple[np.ndarray, ...], dict[str, np.ndarray] | None], dict], schema: str, vec: str = "vec", keep: Sequence[str] = (), keep_schema: str = "") -> DataFrame:
    """(id, keep.., schema): rows, 512 at a time, against the broadcast blocks of the baseline, one after another.

    fn(columns, vectors, block, old) gives the schema's columns; old has what the blocks before gave, None at first.
    """
    cols, found = ["id", *keep], [c.split()[0] for c in schema.split(", ")]
    frame = as_double(df.select(*cols, F.col(vec).alias("vec")))
    for k, block in enumerate(base):
        shared, last = df.sparkSession.sparkContext.broadcast(block), k == base.blocks - 1

        def run(frames: Iterator[pd.DataFrame], shared=shared, first=k == 0, last=last) -> Iterator[pd.DataFrame]:
            for f in frames:
                for i in range(0, len(f), 512):
                    part = f.iloc[i : i + 512]
                    own = {c: part[c].to_numpy() for c in cols}
                    x = np.array(part["vec"].tolist(), dtype=np.float64)
                    out = fn(own, x, shared.value, None if first else {c: part[c].to_numpy() for c in found})
                    yield pd.DataFrame(own | ({} if last else {"vec": part["vec"].to_numpy()}) | out)

        frame = frame.mapInPandas(run, f"id long, {keep_schema}{'' if last else 'vec array<double>, '}{schema}")
        if not last:
            frame = materialise(frame, "against")
            shared.unpersist()
    return frame


def _two_least(old: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.sort(np.partition(np.concatenate([old, d], axis=1), 1, axis=1)[:, :2], axis=1)


def _old_pair(n: int, old: dict[str, np.ndarray] | None, a: str, b: str) -> np.ndarray:
    return np.full((n, 2), np.inf) if old is None else np.stack([old[a], old[b]], axis=1).astype(np.float64)


def _two_nearest(x: np.ndarray, b: np.ndarray, same: np.ndarray | None = None) -> np.ndarray:
    """Distances of each row of x to its two nearest rows of b; inf where there are fewer, and for pairs in `same`.

    The expanded square, one product, tells which pairs may be the nearest; their
    differences are then squared and added, so equal vectors are 0 apart at every size.
    """
    x2, b2 = (x**2).sum(1), (b**2).sum(1)
    d2 = x2[:, None] + b2[None, :] - 2 * x @ b.T
    if same is not None:
        d2[same] = np.inf
    out = np.full((len(x), 2), np.inf)
    if not b.size:
        return out
    limit = np.partition(d2, min(1, len(b) - 1), axis=1)[:, min(1, len(b) - 1)] + 1e-9 * (x2 + b2.max())
    rows, cols = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
    exact = np.empty(len(rows))
    width = max(1, CELLS // x.shape[1])
    for i in range(0, len(rows), width):
        exact[i : i + width] = np.sqrt(((x[rows[i : i + width]] - b[cols[i : i + width]]) ** 2).sum(axis=1))
    order = np.lexsort((exact, rows))
    rows, exact = rows[order], exact[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = place < 2
    out[rows[first], place[first]] = exact[first]
    return out


def nearest_two(df: DataFrame, base: Base, vec: str = "vec", keep: Sequence[str] = (), keep_schema: str = "") -> DataFrame:
    """(id, keep.., d1, d2): distances to the two nearest baseline rows."""
    last = min(1, base.n - 1)

    def fn(own, x, block, old):
        near = _old_pair(len(x), old, "d1", "d2")
        for _, b in parts(block[:2], CELLS // len(x)):
            near = _two_least(near, _two_nearest(x, b))
        return {"d1": near[:, 0], "d2": near[:, last]}

    return map_against(df, base, fn, "d1 double, d2 double", vec, keep, keep_schema)


def nn_coverage(gen: DataFrame, base: DataFrame, percentile: float = 0.9, vec: str = "vec") -> DataFrame:
    """One row: threshold (percentile of the baseline's distances to its second-nearest row, itself being the nearest), coverage.

    Coverage is the share of gen whose nearest baseline row is within the threshold; 0 for
    fewer than 10 baseline or 2 generated rows.
    """
    spark = gen.sparkSession
    b = Base(base, vec)
    n = gen.count()
    if b.n < 10 or n < 2:
        return spark.createDataFrame([(0.0, 0.0, n)], "threshold double, coverage double, n long")
    limit = nearest_two(base, b, vec).agg(F.percentile("d2", F.lit(percentile)).alias("threshold"))
    found = nearest_two(gen, b, vec).crossJoin(F.broadcast(limit))  # limit is one row
    return found.groupBy("threshold").agg(F.avg((F.col("d1") <= F.col("threshold")).cast("double")).alias("coverage"), F.count("*").alias("n"))


def two_nn_dim(df: DataFrame, vec: str = "vec", discard: float = 0.1) -> DataFrame:
    """Two-nearest-neighbour dimension: fit of -ln(1 - F) on ln(r2 / r1) through the origin, without the top share."""
    def fn(own, x, block, old):
        near = _old_pair(len(x), old, "r1", "r2")
        for bi, b in parts(block[:2], CELLS // len(x)):
            near = _two_least(near, _two_nearest(x, b, own["id"][:, None] == bi[None, :]))
        return {"r1": near[:, 0], "r2": near[:, 1]}

    mu = map_against(df, Base(df, vec), fn, "r1 double, r2 double", vec).where("r1 > 0").select(F.log(F.col("r2") / F.col("r1")).alias("lm"))
    ranked, n = number_rows(materialise(mu, "mu"), ["lm"], "mu-ranks")  # written once: finding the ranges reads it, too
    kept = ranked.withColumn("i", F.col("row_no") + 1).where(F.col("i") <= math.floor(n * (1 - discard))).withColumn("y", -F.log(1 - F.col("i") / F.lit(max(n, 1))))
    return kept.agg((F.sum(F.col("lm") * F.col("y")) / F.sum(F.col("lm") ** 2)).alias("dim"), F.count("*").alias("n"))


def gmm_coverage(gen: DataFrame, base: DataFrame, components: int = 10, reach: float = 1.5, vec: str = "vec", seed: int = 42) -> float:
    """Share of mixture components of the baseline with a generated row within reach * sqrt(mean variance) of their mean. Superseded by nn_coverage."""
    from pyspark.ml.clustering import GaussianMixture

    model = GaussianMixture(k=components, featuresCol="v", seed=seed).fit(as_double(base, vec).select(array_to_vector(vec).alias("v")))
    covered = 0
    for g in model.gaussiansDF.collect():
        mean, limit = F.lit([float(x) for x in g["mean"]]), reach * float(np.sqrt(np.mean(np.diag(g["cov"].toArray()))))
        d2 = F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), mean, lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, x: s + x)
        covered += not gen.where(F.sqrt(d2) <= limit).isEmpty()
    return covered / components
