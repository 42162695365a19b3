"""MinHash near-duplicate removal with the greedy keep-first rule, without comparing all pairs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.scratch import materialise

#: Fixed values of the reference semantics.
PERMUTATIONS, THRESHOLD, SHINGLE, PRIME, SEED = 128, 0.85, 5, (1 << 31) - 1, 42


def shingle_hash(shingle: Column) -> Column:
    """SHA-256 modulo 2**31."""
    return F.conv(F.right(F.sha2(shingle.cast("binary"), 256), F.lit(8)), 16, 10).cast("bigint").bitwiseAND(F.lit((1 << 31) - 1))


def coefficients(permutations: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """(a, b) of each permutation h -> (a h + b) mod (2**31 - 1), drawn pair by pair."""
    rng = np.random.default_rng(seed)
    return np.array([rng.integers(1, 1 << 31, size=2) for _ in range(permutations)], dtype=np.int64)


def signature_udf(permutations: int = PERMUTATIONS, seed: int = SEED, shingle: int = SHINGLE):
    ab = coefficients(permutations, seed)

    @F.pandas_udf("array<bigint>")
    def signature(text: pd.Series) -> pd.Series:
        def one(t: str | None):
            low = (t or "").lower()
            grams = {low[i : i + shingle] for i in range(len(low) - shingle + 1)}
            if not grams:
                return np.full(permutations, np.iinfo(np.int64).max)
            h = np.array([int.from_bytes(hashlib.sha256(g.encode()).digest()[-4:], "big") & 0x7FFFFFFF for g in grams], dtype=np.int64)
            best = np.full(permutations, np.iinfo(np.int64).max)
            for i in range(0, len(h), 4096):  # long texts: bounded memory
                best = np.minimum(best, ((ab[:, :1] * h[i : i + 4096] + ab[:, 1:]) % PRIME).min(axis=1))
            return best

        return text.map(one)

    return signature


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """(doc_id, sig) from the text as it stands; cap it first. Texts below five characters share one signature."""
    return docs.select("doc_id", signature_udf(permutations, seed)("text").alias("sig"))


def estimate(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def bands(permutations: int = PERMUTATIONS, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(first, length) of the bands: one more than positions that a match may differ in, so a match agrees in a whole band."""
    need = next(k for k in range(permutations + 1) if k / permutations >= threshold)
    k = permutations - need + 1
    cuts = [i * permutations // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _cells(sigs: DataFrame, threshold: float, permutations: int) -> DataFrame:
    """(doc_id, band, key): the bands of each signature."""
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("sig", first + 1, n)).alias("key")) for i, (first, n) in enumerate(bands(permutations, threshold))])
    return sigs.select("doc_id", F.explode(keys).alias("cell")).select("doc_id", "cell.band", "cell.key")


def _verified(cand: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    both = cand.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("est")).where(F.col("est") >= threshold)


def _pairs(cells: DataFrame) -> DataFrame:
    left, right = cells.alias("l"), cells.alias("r")
    on = (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.doc_id") < F.col("r.doc_id"))
    return left.join(right, on).select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()


def near_pairs(sigs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS) -> DataFrame:
    """(a, b, est) for all a < b whose estimate reaches the threshold; exact, by an equi-join on bands.

    Only the first document of each signature is joined; its pairs then hold for all that
    share the signature. The result itself is all pairs of a group; representative_pairs
    has what it says without them.
    """
    firsts, members = representatives(sigs)
    pairs = representative_pairs(firsts, threshold, permutations)
    equal = members.groupBy("first").agg(F.count("*").alias("c")).where("c > 1").select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("est"))
    side = lambda x, y: members.select(F.col("first").alias(x), F.col("doc_id").alias(y))
    both = pairs.unionByName(equal).join(side("a", "x"), "a").join(side("b", "y"), "b")
    ordered = both.where((F.col("a") < F.col("b")) | (F.col("x") < F.col("y")))
    return ordered.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "est")


def representatives(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig) of the first document of each signature, and (first, doc_id) of all."""
    sigs = materialise(sigs, "sigs")
    firsts = materialise(sigs.groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "firsts")
    members = materialise(sigs.join(firsts.withColumnRenamed("doc_id", "first"), "sig").select("first", "doc_id"), "members")
    return firsts, members


def representative_pairs(firsts: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS) -> DataFrame:
    """(a, b, est) between documents of different signatures."""
    return _verified(_pairs(materialise(_cells(firsts, threshold, permutations), "cells")), firsts, threshold)


#: Band pairs per band entry up to which all pairs are joined; above, leaders thin the bands out first.
PAIRS_PER_CELL = 20


def greedy_dedup(docs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, seed: int = SEED, pairs_per_cell: float = PAIRS_PER_CELL) -> DataFrame:
    """(doc_id, kept) as a pass in the order of doc_id gives it: dropped if near any document kept before.

    Documents of one signature: all but the first are dropped whatever happens to it, for
    what drops it drops them too; so only firsts are joined. While bands are crowded,
    leaders go first: a document that is the smallest open one in all its bands has no
    open smaller neighbour, so it is kept, and drops its matches in these bands. This
    takes a comparison per band entry, so a large group of near copies is not paired up.
    Then, over all pairs of what is left, until nothing is open: a document with a kept
    smaller neighbour is dropped, one without an open or kept smaller neighbour is kept.
    """
    sigs = materialise(signatures(docs, permutations, seed), "sigs")
    firsts = materialise(sigs.groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "firsts")
    cells = materialise(_cells(firsts, threshold, permutations), "cells")
    decided = None
    while True:
        sizes = cells.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("doc_id").alias("lead"))
        pairs, entries = sizes.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.sum("c")).first()
        if (pairs or 0) <= pairs_per_cell * (entries or 0):
            break
        led = materialise(cells.join(sizes, ["band", "key"]).select("doc_id", "band", "key", "lead"), "led")
        free = led.groupBy("doc_id").agg(F.bool_and(F.col("lead") == F.col("doc_id")).alias("free")).where("free").select(F.col("doc_id").alias("lead"))
        cand = led.where("lead <> doc_id").join(free, "lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
        gone = _verified(cand, firsts, threshold).select(F.col("b").alias("doc_id")).distinct()
        new = materialise(free.select(F.col("lead").alias("doc_id"), F.lit(1).alias("state")).unionByName(gone.withColumn("state", F.lit(-1))), "decided")
        decided = new if decided is None else decided.unionByName(new)
        cells = materialise(cells.join(new.select("doc_id"), "doc_id", "left_anti"), "cells")
    edges = materialise(_verified(_pairs(cells), firsts, threshold).select("a", "b"), "edges")
    state = materialise(edges.select(F.col("a").alias("doc_id")).unionByName(edges.select(F.col("b").alias("doc_id"))).distinct().withColumn("state", F.lit(0)), "state")
    while not state.where("state = 0").isEmpty():
        worst = edges.join(state.select(F.col("doc_id").alias("a"), F.col("state").alias("sa")), "a").where("sa >= 0").groupBy("b").agg(F.max("sa").alias("top"))
        moved = state.join(worst.withColumnRenamed("b", "doc_id"), "doc_id", "left")
        new = F.when(F.col("state") != 0, F.col("state")).when(F.col("top") == 1, -1).when(F.col("top").isNull(), 1).otherwise(0)
        state = materialise(moved.select("doc_id", new.alias("state")), "state")
    known = state if decided is None else state.unionByName(decided)
    out = firsts.select("doc_id").join(known, "doc_id", "left").select("doc_id", (F.coalesce("state", F.lit(1)) == 1).alias("kept"))
    return sigs.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"))
