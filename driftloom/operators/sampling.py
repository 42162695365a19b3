"""Sampling, splits and mixtures: by hashes of seed and id, so that every run and layout draws the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.numeric import seeded, seeded_number
from driftloom.numbering import number_rows


def hash_order(df: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    return df.orderBy(seeded(seed, id_col), F.col(id_col))


def sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """n rows in hash order; each task sorts only its n first."""
    return hash_order(df, seed, id_col).limit(n)


def sample_exact(df: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """The draw of numpy's generator over rows sorted by id as text. Draws on the driver: for n that fits there."""
    total = df.count()
    if total <= n:
        return df
    picked = np.sort(np.random.default_rng(seed).choice(total, size=n, replace=False))
    few = df.sparkSession.createDataFrame([(int(i),) for i in picked], "row_no long")
    ranked, _ = number_rows(df.withColumn("_id", F.col(id_col).cast("string")), ["_id"])
    return ranked.join(F.broadcast(few), "row_no").drop("row_no", "_id")


def buckets(df: DataFrame, k: int, seed: int = 42, id_col: str = "doc_id", name: str = "bucket") -> DataFrame:
    return df.withColumn(name, (seeded_number(seed, id_col) % k).cast("int"))


def holdout(df: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Rows with is_holdout: one in five, by a seed of its own."""
    return buckets(df, 5, seed + 999, id_col, "_b").withColumn("is_holdout", F.col("_b") == 0).drop("_b")


def split(df: DataFrame, train: float = 0.6, seed: int = 42, id_col: str = "doc_id", name: str = "is_train") -> DataFrame:
    """Rows with a mark of those that train, a share of them by a hash of seed and id."""
    return df.withColumn(name, seeded_number(seed, id_col) % 1000 < int(1000 * train))


def mixtures(human: DataFrame, synthetic: DataFrame, n: int = 1000, fractions: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), seed: int = 42, id_col: str = "doc_id", shrink: bool = False) -> DataFrame:
    """For each fraction int(n * fraction) synthetic rows and the rest human ones, labelled. Where a pool is too small it raises, or with shrink n is the smaller pool's size."""
    from pyspark.sql import Window

    if shrink:
        n = min(n, *[df.limit(n).count() for df in (human, synthetic)])

    def ranked(df: DataFrame, label: str) -> DataFrame:
        few = sample(df.select(id_col, "text"), n, seed, id_col)
        return few.withColumn("r", F.row_number().over(Window.orderBy(seeded(seed, id_col), id_col))).withColumn("source", F.lit(label))  # n rows

    a, b = ranked(synthetic, "synthetic"), ranked(human, "human")
    need_s, need_h = max(int(n * f) for f in fractions), max(n - int(n * f) for f in fractions)
    for df, need, what in ((a, need_s, "synthetic"), (b, need_h, "human")):
        if (have := df.count()) < need:
            raise ValueError(f"{need} {what} rows are needed, {have} are there")
    plan = df_of_fractions(human.sparkSession, n, fractions)
    parts = [x.join(F.broadcast(plan), x.r <= plan[c]) for x, c in ((a, "n_synthetic"), (b, "n_human"))]
    return parts[0].unionByName(parts[1]).select(F.col("fraction").alias("true_synthetic_fraction"), "source", id_col, "text")


def df_of_fractions(spark, n: int, fractions) -> DataFrame:
    return spark.createDataFrame([(float(f), int(n * f), n - int(n * f)) for f in fractions], "fraction double, n_synthetic int, n_human int")
