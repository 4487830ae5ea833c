"""Trees of any depth: parents of headings, reading order of outlines."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.operators.matching import join_same
from quirelake.operators.prefix import running_total
from quirelake.session import settle

#: Fixed value: levels of headings.
LEVELS = 6
#: Entries of a document that are walked in one task; larger documents are ordered in rounds.
WALKED = 1 << 16


def heading_outline(headings: DataFrame) -> DataFrame:
    """Headings as outline entries: ``doc_id, node_id, parent_id, ordinal, level, title, page``.

    ``headings`` has doc_id, ordinal, level and title (see ``markup_headings``). The parent
    of a heading is the last earlier one of a lower level; a document may skip levels or begin
    with any. A document's headings come out of one row, so they may meet in one window.
    """
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.col("ordinal")), ignorenulls=True).over(before)) for n in range(1, LEVELS)]
    return headings.select(
        "doc_id", F.col("ordinal").alias("node_id"), F.greatest(*last).alias("parent_id"), "ordinal", "level", "title", F.lit(0).alias("page"))


def _walk(held: pa.RecordBatch) -> pa.RecordBatch:
    """The entries of whole documents, one document after the other, in reading order with their place and depth."""
    docs, nodes, parents, ordinals = (held.column(k).to_pylist() for k in range(4))
    rows: list[int] = []
    places: list[int] = []
    depths: list[int] = []
    start = 0
    for stop in range(1, len(docs) + 1):
        if stop < len(docs) and docs[stop] == docs[start]:
            continue
        one: dict = {}
        for k in range(start, stop):
            at = ((parents[k] is not None, parents[k]), (ordinals[k] is not None, ordinals[k]))
            if nodes[k] not in one or at < one[nodes[k]][0]:
                one[nodes[k]] = at, k
        below = defaultdict(list)
        for node, (at, k) in one.items():
            below[parents[k]].append((at[1], node, k))
        first = len(rows)
        waiting = [(0, k) for *_, k in sorted(below[None], reverse=True)]
        while waiting:
            depth, k = waiting.pop()
            places.append(len(rows) - first)
            rows.append(k)
            depths.append(depth)
            waiting += ((depth + 1, j) for *_, j in sorted(below.get(nodes[k], ()), reverse=True))
        start = stop
    taken = held.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(places, pa.int64()), pa.array(depths, pa.int64())], names=[*held.schema.names, "reading_order", "depth"])


def _walked(entries: DataFrame) -> DataFrame:
    """Documents ordered in the task that holds them; the first four columns are doc_id, node_id, parent_id and ordinal."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            docs = rest.column(0).to_pylist()
            cut = len(docs)
            while cut and docs[cut - 1] == docs[-1]:
                cut -= 1
            if cut:  # the last document may go on
                yield _walk(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            yield _walk(rest)

    long = [T.StructField(c, T.LongType()) for c in ("reading_order", "depth")]
    return entries.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(of, T.StructType([*entries.schema.fields, *long]))


def preorder(outline: DataFrame, walked: int = WALKED) -> DataFrame:
    """Outline entries with ``reading_order`` (from zero in their document) and ``depth``.

    ``outline`` has doc_id, node_id, parent_id (null at the top) and ordinal. Siblings
    are ordered by ordinal, then node_id. Of several rows of one node, the first by
    parent and ordinal counts. Entries under a missing parent, and cycles, are left out.
    A document of at most ``walked`` rows is walked where its rows meet: they are shuffled
    once, whatever the depth. Larger ones are ordered in rounds (:func:`_toured`).
    """
    at = ["doc_id", "node_id", "parent_id", "ordinal"]
    entries = settle(outline.where("node_id IS NOT NULL").select(*at, *[c for c in outline.columns if c not in at]), "outline-entries")
    large = settle(entries.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > walked).select("doc_id"), "outline-large")
    if large.isEmpty():
        found = _walked(entries)
    else:
        found = _walked(join_same(entries, large, ["doc_id"], "left_anti")).unionByName(_toured(join_same(entries, large, ["doc_id"], "left_semi")))
    return settle(found.select(*outline.columns, "reading_order", "depth"), "outline-ordered")


def _toured(outline: DataFrame) -> DataFrame:
    """As :func:`preorder`, for documents of any size.

    An Euler tour: every entry is entered and left, each of these steps knows the next, and
    by pointer doubling each sums up all steps after it. Rounds grow with the logarithm of a
    document's entries, not with depth, and no entry waits for another. Steps
    are joined by their own key, so a document may hold any share of them.
    """
    nodes = settle(
        outline.groupBy("doc_id", "node_id").agg(F.min(F.struct("parent_id", "ordinal")).alias("_at"))
        .select("doc_id", "node_id", "_at.parent_id", "_at.ordinal").where("node_id IS NOT NULL"), "outline")
    placed = settle(running_total(nodes, ["doc_id", "parent_id"], "ordinal", F.lit(1), "place", ties=["node_id"]), "outline-places")

    def same(*pairs: tuple[str, str]):
        return [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]

    other = placed.select(F.col("doc_id").alias("d"), F.col("parent_id").alias("p"), F.col("place").alias("k"), F.col("node_id").alias("found"))
    first = other.where("k = 0 AND p IS NOT NULL")
    inside = placed.join(first, same(("doc_id", "d"), ("node_id", "p")), "left").select(
        "doc_id", "node_id", F.lit(False).alias("leaving"),
        F.coalesce("found", "node_id").alias("next_id"), F.col("found").isNull().alias("next_leaving"),
        F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("deeper"))
    behind = placed.join(other, same(("doc_id", "d"), ("parent_id", "p")) + [F.col("place") + 1 == F.col("k")], "left").select(
        "doc_id", "node_id", F.lit(True).alias("leaving"),
        F.coalesce("found", "parent_id").alias("next_id"), F.col("found").isNull().alias("next_leaving"),
        F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("deeper"))
    steps = settle(inside.unionByName(behind), "outline-steps")
    # A document of n entries has 2n steps; what is not at the end then goes round or hangs from nothing.
    most = nodes.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    for _ in range(math.ceil(math.log2(2 * most + 1))):
        on = steps.select(
            F.col("doc_id").alias("d"), F.col("node_id").alias("i"), F.col("leaving").alias("l"),
            F.col("next_id").alias("then"), F.col("next_leaving").alias("then_leaving"), F.col("entered").alias("e"), F.col("deeper").alias("w"))
        open_ = steps.where("next_id IS NOT NULL")
        met = open_.join(on, same(("doc_id", "d")) + [F.col("next_id") == F.col("i"), F.col("next_leaving") == F.col("l")], "left")
        found = F.col("i").isNotNull()
        steps = settle(met.select(
            "doc_id", "node_id", "leaving",
            F.when(found, F.col("then")).otherwise(F.col("next_id")).alias("next_id"),
            F.when(found, F.col("then_leaving")).otherwise(F.col("next_leaving")).alias("next_leaving"),
            (F.col("entered") + F.coalesce("e", F.lit(0))).alias("entered"), (F.col("deeper") + F.coalesce("w", F.lit(0))).alias("deeper"),
        ).unionByName(steps.where("next_id IS NULL")), "outline-steps")
    ended = steps.where("next_id IS NULL AND NOT leaving").select(F.col("doc_id").alias("d"), F.col("node_id").alias("i"), "entered", (-F.col("deeper")).alias("depth"))
    total = ended.groupBy(F.col("d").alias("t")).agg(F.max("entered").alias("all"))
    ranked = ended.join(total, F.col("d").eqNullSafe(F.col("t"))).select("d", "i", (F.col("all") - F.col("entered")).alias("reading_order"), "depth")
    one = outline.join(placed.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_i"), F.col("parent_id").alias("_p"), F.col("ordinal").alias("_o")),
                       same(("doc_id", "_d"), ("node_id", "_i"), ("parent_id", "_p"), ("ordinal", "_o"))).dropDuplicates(["doc_id", "node_id"])
    return one.join(ranked, same(("doc_id", "d"), ("node_id", "i"))).select(*outline.columns, "reading_order", "depth")


def leaf_order(ordered: DataFrame) -> DataFrame:
    """``doc_id, node_id, reading_order`` of the entries without children, numbered by themselves.

    For structure trees, whose leaves are spans of a page: join them on ``node_id``.
    """
    parents = ordered.where("parent_id IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("parent_id").alias("_p")).distinct()
    leaves = ordered.join(parents, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("node_id") == F.col("_p")), "left_anti")
    return running_total(leaves, ["doc_id"], "reading_order", F.lit(1), "_leaf").select("doc_id", "node_id", F.col("_leaf").alias("reading_order"))
