"""Gaussian kernel density and tail mass over projected vectors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.numeric import relative_change
from driftloom.operators.vectors import Base, map_against, parts
from driftloom.scratch import materialise

#: The bandwidth grids, the percentile of the tail.
GRID = tuple(float(x) for x in np.logspace(-2, math.log10(2), 15))
WEB_GRID = tuple(float(x) for x in np.logspace(-1.5, 0.5, 10))
TAIL = 0.05
#: Distances that are computed at once, and the exponent from which terms are left out.
TILE, FAR = 1 << 16, 60.0


@dataclass
class Kde:
    base: Base
    bandwidth: float

    @classmethod
    def fit(cls, train: DataFrame, bandwidth: float | str = "scott", vec: str = "vec") -> Kde:
        """'scott' is n ** (-1 / (d + 4))."""
        base = Base(train, vec)
        if bandwidth == "scott":
            bandwidth = base.n ** (-1 / (base.dims + 4))
        return cls(base, float(bandwidth))

    def log_norm(self, h: float) -> float:
        return _log_norm(self.base.n, self.base.dims, h)


def _log_norm(n: int, d: int, h: float) -> float:
    return -math.log(n) - d * math.log(h) - d / 2 * math.log(2 * math.pi)


def log_likelihood(df: DataFrame, kde: Kde, vec: str = "vec", keep: tuple[str, ...] = (), keep_schema: str = "") -> DataFrame:
    """(id, keep.., ll): rows against the training points, block by block; logarithms of sums are merged."""
    h, norm = kde.bandwidth, kde.log_norm(kde.bandwidth)

    def fn(own, x, block, old):
        return {"ll": _merged(old and old["ll"], _log_sums(x, (h,), ((slice(None), b) for _, b in parts(block[:2], TILE // len(x))))[0])}

    return map_against(df, kde.base, fn, "ll double", vec, keep, keep_schema).withColumn("ll", F.col("ll") + F.lit(norm))


def _merged(old: np.ndarray | None, new: np.ndarray) -> np.ndarray:
    return new if old is None else np.logaddexp(old.astype(np.float64), new)


def _log_sums(x: np.ndarray, bandwidths: Sequence[float], tiles: Iterable[tuple[np.ndarray | slice, np.ndarray]]) -> np.ndarray:
    """ln of the sum of exp(-d2 / (2 h h)) of each bandwidth (row) and row of x (column); -inf for rows without points.

    tiles gives (rows of x, points), small enough for a core's cache; sums are kept relative to the nearest point so
    far. Terms below exp(-FAR) of the largest are left out: all of them together are below the sum's last bit.
    """
    nearest, sums, x2 = np.full(len(x), np.inf), np.zeros((len(bandwidths), len(x))), (x**2).sum(1)
    scales = sorted(((1 / (2 * h * h), k) for k, h in enumerate(bandwidths)))
    for rows, b in tiles:
        own = x[rows]
        if not b.size or not own.size:
            continue
        t = own @ b.T
        t *= -2
        t += x2[rows][:, None]
        t += (b**2).sum(1)
        np.maximum(t, 0, out=t)
        low = np.minimum(nearest[rows], t.min(axis=1))
        moved, nearest[rows] = nearest[rows] - low, low
        t -= low[:, None]
        top, at, e = t.max(), None, np.empty_like(t)
        for c, k in scales:  # wide ones first: what is too far for one is so for all that follow
            s = sums[k, rows] * np.exp(-moved * c)
            if at is None and top > FAR / c:
                near = t < FAR / c
                if np.count_nonzero(near) < t.size // 5:
                    at, few = np.nonzero(near)[0], t[near]
            elif at is not None:
                near = few < FAR / c
                at, few = at[near], few[near]
            if at is None:
                np.exp(np.multiply(t, -c, out=e), out=e)
                s += e.sum(axis=1)
            else:
                s += np.bincount(at, np.exp(few * -c), minlength=len(own))
            sums[k, rows] = s
    out = np.full(sums.shape, -np.inf)
    some = np.isfinite(nearest)
    for c, k in scales:
        out[k, some] = np.log(sums[k, some]) - nearest[some] * c
    return out


def bandwidth_scores(df: DataFrame, folds: int = 5, grid: tuple[float, ...] = GRID, vec: str = "vec", seed: int = 42) -> DataFrame:
    """(bandwidth, score): mean over folds of the summed held-out log-likelihood. One distance matrix serves the whole grid.

    df needs a column fold (0 .. folds - 1). A fold without training points has no score.
    """
    base = Base(df, vec, ("fold",), order=("fold", "id"))
    held = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}  # a row a fold
    names = [f"h{g}" for g in range(len(grid))]

    def fn(own, x, block, old):
        def tiles():  # the points lie by fold, so most tiles have one
            for _, b, of in parts(block, TILE // len(x)):
                for f in np.unique(of):
                    yield np.flatnonzero(own["fold"] != f), b[of == f]

        return {c: _merged(old and old[c], ll) for c, ll in zip(names, _log_sums(x, grid, tiles()), strict=True)}

    wide = map_against(df, base, fn, ", ".join(f"{c} double" for c in names), vec, ("fold",), "fold int, ")
    norms = F.create_map(*[F.lit(x) for f, m in held.items() if m < base.n for x in (f, [_log_norm(base.n - m, base.dims, h) for h in grid])])
    sums = wide.withColumn("_norm", norms[F.col("fold")]).groupBy("fold").agg(*[F.sum(F.col(c) + F.col("_norm")[g]).alias(c) for g, c in enumerate(names)])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(h).alias("bandwidth"), F.col(f"h{g}").alias("s")) for g, h in enumerate(grid)])).alias("x")).select("x.*")
    return long.groupBy("bandwidth").agg(F.avg("s").alias("score"))


def held_out_scores(df: DataFrame, grid: tuple[float, ...] = WEB_GRID, vec: str = "vec") -> DataFrame:
    """(bandwidth, score): summed log-likelihood of the rows that do not train, under those that do; df needs a boolean column is_train."""
    base = Base(df.where("is_train"), vec)
    names = [f"h{g}" for g in range(len(grid))]

    def fn(own, x, block, old):
        found = _log_sums(x, grid, ((slice(None), b) for _, b in parts(block[:2], TILE // len(x))))
        return {c: _merged(old and old[c], ll) for c, ll in zip(names, found, strict=True)}

    wide = map_against(df.where("not is_train"), base, fn, ", ".join(f"{c} double" for c in names), vec)
    norms = [_log_norm(base.n, base.dims, h) if base.n else 0.0 for h in grid]
    sums = wide.agg(*[F.sum(F.col(c) + F.lit(x)).alias(c) for c, x in zip(names, norms, strict=True)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(h).alias("bandwidth"), F.col(c).alias("score")) for c, h in zip(names, grid, strict=True)])).alias("x")).select("x.*")


def best_bandwidth(scores: DataFrame) -> float:
    return scores.orderBy(F.col("score").desc(), "bandwidth").first()["bandwidth"]


def tail_threshold(ll: DataFrame, percentile: float = TAIL) -> DataFrame:
    return ll.agg(F.percentile("ll", F.lit(percentile)).alias("threshold"))


def tail_mass(gen_ll: DataFrame, base_ll: DataFrame, threshold: float) -> DataFrame:
    """One row: mean and population deviation of ll, shares below the threshold in both cohorts, relative change."""
    t = F.lit(float(threshold))
    below = F.avg((F.col("ll") < t).cast("double"))
    g = gen_ll.agg(F.avg("ll").alias("mean_ll"), F.stddev_pop("ll").alias("std_ll"), below.alias("tail_mass_fraction"))
    b = base_ll.agg(below.alias("baseline_tail_fraction"))
    return g.crossJoin(F.broadcast(b)).withColumn("tail_fraction_rel_change", relative_change(F.col("tail_mass_fraction"), F.col("baseline_tail_fraction")))


def tail_by_cohort(ll: DataFrame, by: str, baseline: int = 0, percentile: float = TAIL) -> DataFrame:
    """(by, n, mean_ll, tail_mass_fraction, rel_change): shares below the percentile of the baseline cohort, whose density ll should be."""
    ll = materialise(ll, "ll")  # three readers
    limit = tail_threshold(ll.where(F.col(by) == baseline), percentile)
    below = F.avg((F.col("ll") < F.col("threshold")).cast("double"))
    out = ll.crossJoin(F.broadcast(limit)).groupBy(by).agg(F.count("*").alias("n"), F.avg("ll").alias("mean_ll"), below.alias("tail_mass_fraction"))  # limit is one row
    own = out.where(F.col(by) == baseline).select(F.col("tail_mass_fraction").alias("_own"))
    return out.crossJoin(F.broadcast(own)).withColumn("rel_change", relative_change(F.col("tail_mass_fraction"), F.col("_own"))).drop("_own")
