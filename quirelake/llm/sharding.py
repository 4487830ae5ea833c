"""Shards by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.numbering import gapless

#: A tree is a list of regions, a region (name, weight, racks), a rack (name,
#: weight, shards), a shard (name, weight, number).
Shard = tuple[str, float, int]
Rack = tuple[str, float, Sequence[Shard]]
Region = tuple[str, float, Sequence[Rack]]


def tree(shards: int, regions: int = 2, racks: int = 2, per_rack: int = 4) -> list[Region]:
    """The tree of ``shards`` equal shards, numbers in order.

    The first fill a grid of ``regions x racks x per_rack``, which the parameters fix
    and not the count; each number beyond it is a region of its own with one rack and
    one shard. So the tree of one more shard is this one and a new region. A store
    of fewer shards than the grid has no grid: all its shards are regions.
    """
    full = regions * racks * per_rack
    return grown(grid(regions, racks, per_rack), shards - full) if shards >= full else grown([], shards)


def grid(regions: int, racks: int, per_rack: int) -> list[Region]:
    def rack(at: int) -> Rack:
        return (f"rack{at}", float(per_rack), [(f"shard{at * per_rack + k}", 1.0, at * per_rack + k) for k in range(per_rack)])

    return [(f"region{g}", float(racks * per_rack), [rack(g * racks + r) for r in range(racks)]) for g in range(regions)]


def grown(old: Sequence[Region], more: int = 1) -> list[Region]:
    """The tree with ``more`` shards added, each as a new region.

    Old regions keep their names and weights, so their draws stay as they were: a
    document moves only if a new region draws lowest, and then into that region.
    """
    first = sum(len(rack[2]) for region in old for rack in region[2])
    return [*old, *((f"region+{n}", 1.0, [(f"rack+{n}", 1.0, [(f"shard{n}", 1.0, n)])]) for n in range(first, first + more))]


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate ``weight``, from the key and the node's name alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 1) / float(1 << 53)
    return -F.log(unit) / F.lit(float(weight))


def _lowest(key: Column, nodes: Sequence[tuple], path: str) -> Column:
    """The path of the child with the lowest draw; of equal draws the first name wins."""
    live = [n for n in nodes if n[1] > 0]
    if not live:
        raise ValueError(f"no node of positive weight below {path or 'the root'}")
    if len(live) == 1:
        return F.lit(f"{path}/{live[0][0]}")
    return F.array_min(F.array(*[F.struct(_draw(key, f"{path}/{n[0]}", n[1]).alias("draw"), F.lit(f"{path}/{n[0]}").alias("at")) for n in live]))["at"]


def descend(df: DataFrame, key: Column, nodes: Sequence[Region], out: str) -> DataFrame:
    """Add ``out``: the shard number of a key, by region, rack and shard in turn.

    A row draws among the children of the node it has reached, level by level.
    Changing a weight moves keys only into or out of the subtree whose weight
    changed. A null key has a place like any other.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    df = df.withColumn("_at", _lowest(key, nodes, ""))
    level = [(f"/{n[0]}", n[2]) for n in nodes if n[1] > 0]
    while not isinstance(level[0][1], int):
        cases = [(F.col("_at") == path, _lowest(key, below, path)) for path, below in level]
        df = df.withColumn("_at", reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), cases[:-1], cases[-1][1]))
        level = [(f"{path}/{n[0]}", n[2]) for path, below in level for n in below if n[1] > 0]
    numbers = F.create_map(*[F.lit(x) for leaf in level for x in leaf])
    return df.withColumn(out, numbers[F.col("_at")].cast("int")).drop("_at")


def assign_shards(docs: DataFrame, shards: int = 16, nodes: Sequence[Region] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``key``: the document id and the tree decide. ``size`` is the bytes
    of the text plus 1 (a null text has none), ``slot`` numbers a shard's rows from
    0, and ``grown_shard`` is the place after one more shard joins. Repeated rows go
    to one shard, in slots of their own; null ids are one key. An empty table gives
    no rows; other columns are not read, whatever their names.
    """
    nodes = nodes or tree(shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = descend(descend(placed, F.col("doc_id"), nodes, "shard"), F.col("doc_id"), grown(nodes), "grown_shard")
    return gapless(placed, "shard", ["doc_id"], ["text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
