"""Joins in which nulls meet nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, which come from the left side; a null equals a null.

    For rows without a document id, which a plain join on the id would lose. It is
    still an equality join: hashed, sorted and split like any other.
    """
    named = right.withColumnsRenamed({k: f"_same{n}" for n, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_same{n}")) for n, k in enumerate(keys)]
    return left.join(named, on, how).drop(*[f"_same{n}" for n in range(len(keys))])
