"""Gapless numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, group: str, key: Sequence[str], ties: Sequence[str], out: str, blocks: int | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each value of ``group``.

    A group is cut into ``blocks`` parts by a hash of its ``key`` columns. Rows are
    numbered inside their part and moved on by the sizes of the parts before it, so
    no window partition holds more than a part, however large the group. Part sizes
    need only ``group`` and ``key``. Rows equal in ``key`` and ``ties`` are
    interchangeable; their numbers are any of those they share.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")
    rows = df.withColumn("_part", cut)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
        .select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*key, *ties)) - 1
    return (
        rows.withColumn("_place", inside)
        .join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
        .withColumn(out, (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_part", "_group", "_of", "_start", "_place")
    )
