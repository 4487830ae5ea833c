"""Running sums and numbering inside groups of any size.

A plain window over a document would put that document in one task. Here each
group is cut into blocks of its integer order column: every window partition
holds at most ``BLOCK`` index values, and the blocks of a group (at most 2^31 /
BLOCK for a 32-bit index) are offset by a second window over block totals.
A null in a group column is a group of its own, and rows without an index come
first. Rows of equal index are ordered by ``ties``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def running_total(
    df: DataFrame, group: Sequence[str], index: str, value: Column, out: str, block: int = BLOCK, ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the group."""
    keys = [*group, "_block"]
    rows = df.withColumns({"_value": value, "_block": F.floor(F.col(index) / block)})
    earlier_blocks = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.sum("_value").alias("_total"))
        .select(*[F.col(k).alias(f"_of{n}") for n, k in enumerate(keys)], F.coalesce(F.sum("_total").over(earlier_blocks), F.lit(0)).alias("_offset"))
    )
    earlier_rows = Window.partitionBy(*keys).orderBy(index, *ties).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(earlier_rows), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_of{n}")) for n, k in enumerate(keys)]
    return numbered.join(offsets, same).withColumn(out, F.col("_offset") + F.col("_inside")).select(*df.columns, out)
