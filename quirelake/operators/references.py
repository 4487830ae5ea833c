"""What a graph of references reaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.session import settle

#: Marked tables read side by side before they are written as one.
MARKS = 16


def reachable(roots: DataFrame, edges: DataFrame, key: Sequence[str] = ("doc_id", "object_id")) -> DataFrame:
    """Keys of all objects that the roots refer to, directly or through others.

    ``roots`` has the key columns, ``edges`` has them and, as ``to_`` and their name,
    those of the object referred to. A mark phase: each round follows the references of the
    objects marked last and marks what was not marked before, until nothing is added;
    cycles end by themselves. Rounds are as many as the longest shortest path, and are
    written to the shared folder. Equal references collapse before they are followed.
    Roots are reached whether or not any reference names them; nulls refer to nothing.
    """
    key = list(key)
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    to = [F.col(f"to_{k}").alias(k) for k in key]
    links = settle(edges.where(whole).select(*key, *[f"to_{k}" for k in key]).distinct(), "references")
    marked = fresh = settle(roots.where(whole).select(*key).distinct(), "marked")
    held = 1
    while True:
        fresh = settle(fresh.join(links, key).select(*to).where(whole).distinct().join(marked, key, "left_anti"), "marked")
        if fresh.isEmpty():
            return marked
        marked, held = marked.unionByName(fresh), held + 1
        if held == MARKS:
            marked, held = settle(marked, "marked"), 1


def unreachable(rows: DataFrame, roots: DataFrame, edges: DataFrame, key: Sequence[str] = ("doc_id", "object_id")) -> DataFrame:
    """Rows of objects no root reaches: those that only refer to each other are among them.

    A row with a null in its key is reached by nothing.
    """
    return rows.join(reachable(roots, edges, key), list(key), "left_anti").select(*rows.columns)
