"""Numeric columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_change(x: Column, base: Column) -> Column:
    """(x - base) / base; null where base is missing or not positive."""
    return F.when(base > 0, (x - base) / base)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normal_tail(z: Column | str) -> Column:
    """P(Z > z) of the standard normal; for few rows of results."""

    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), na_action="ignore")

    return F.pandas_udf(tail, "double")(z)


def student_two_sided(t: Column | str, df: Column | str) -> Column:
    """P(|T| > |t|) of Student's distribution, by integrating cos(x) ** (df - 1) up to atan(t / sqrt(df)); for few rows of results."""

    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        def one(t: float, n: float) -> float:
            if t != t or n != n or n < 1:
                return math.nan
            x = np.linspace(0, math.atan(abs(t) / math.sqrt(n)), 4001)
            y = np.cos(x) ** (n - 1)
            area = (y[0] + y[-1] + 4 * y[1::2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3
            return max(0.0, 1 - 2 * area * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi))

        return pd.Series([one(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)])

    return F.nullif(F.pandas_udf(tail, "double")(t, df), F.lit(float("nan")))


def seeded(seed: int, id_col: str) -> Column:
    """Hash of seed and id as a hexadecimal string: the order and the buckets of all sampling."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)


def seeded_number(seed: int, id_col: str) -> Column:
    return F.conv(F.substring(seeded(seed, id_col), 57, 8), 16, 10).cast("bigint")
