"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.scratch import materialise


def number_rows(df: DataFrame, order: list[str], name: str = "numbered") -> tuple[DataFrame, int]:
    """Gapless global row numbers (column row_no, from 0) in the order of the given columns.

    Range partitions are written once with each row's place in its partition, so the
    boundaries cannot differ between the count and the numbering; only one count per
    partition comes to the driver. Rows that tie in every column may swap numbers.
    """
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096))  # deals out repeated rows
    ranged = df.withColumn("_spread", spread).repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col("_spread"))
    placed = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_place", F.monotonically_increasing_id()).drop("_spread")
    placed = materialise(placed, name)
    part = F.shiftright("_place", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p] = total
        total += n
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "_p long, _start long")
    numbered = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")  # one row per range partition
    row_no = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("row_no", row_no).drop("_p", "_start", "_place"), total
