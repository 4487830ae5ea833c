"""Column names that do not meet those of a caller's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, with underscores added where a column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_key(name: Column) -> Column:
    """An id as text, a null one included, so that plain equality joins it."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("null"))
