"""Near copies by 5-word similarity: SimHash and MinHash bands propose pairs, the exact Jaccard of shingles links them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.components import components
from quirelake.llm.names import fresh, id_key
from quirelake.llm.simhash import DISTANCE, bucket_links, buckets, fingerprint, plan, signatures
from quirelake.session import settle

SHINGLE = 5
#: Texts link at this Jaccard of their shingles or more.
SIMILAR = 0.8
#: A pair at 0.8 shares no band with a chance of ``(1 - 0.8 ** 5) ** 32``, 3 in a million.
BANDS, ROWS = 32, 5
SEED = 42
#: Shingles permuted at once.
BLOCK = 1 << 10
#: Texts whose shingles a worker holds while the others of their bucket stream by.
HELD = 1024

_DRAW = np.random.default_rng(SEED)
_FLIP, _FACTOR, _MIX = (_DRAW.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, BANDS * ROWS))


def grams(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words, or none, is one shingle."""
    words = text.lower().split()
    width = min(shingle, len(words))
    each = map(b" ".join, zip(*(words[k:] for k in range(width)))) if words else [b""]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key a band, over the least values of ``ROWS`` permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[at : at + BLOCK, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * _MIX
    return (mixed ^ (mixed >> np.uint64(32))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _marks(rows: DataFrame) -> DataFrame:
    """``doc_id, mark, node, n, fp, keys`` of rows of ``doc_id, mark, text``: ``node`` names a set of shingles, ``fp`` is operator 7's fingerprint."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                held = grams(text or b"")
                nodes.append(_node(held))
                sizes.append(len(held))
                prints.append(fingerprint(text or b""))
                keys.append(bands(held).view(np.int64))
            held, marks = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held, pa.array(sizes, pa.int64()), marks, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "mark", "node", "n", "fp", "keys"])

    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, node long, n long, fp long, keys array<long>")


def simhash_pairs(marks: DataFrame, similar: float = SIMILAR, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: pairs of texts that operator 7's search links and whose sizes allow ``similar``; stars, not all pairs.

    Texts of one fingerprint meet the least of them; fingerprints within ``distance`` bits, found by
    the pigeonhole search, meet by theirs.
    """
    nodes = settle(marks.select("node", "n", "fp").distinct(), "similar-prints")
    heads = settle(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head")), "similar-heads")
    stars = bucket_links(buckets(signatures(heads, plan(heads, distance)), distance), distance)
    one, two = (heads.select(F.col("fp").alias(f"_{x}"), F.col("head").alias(f"head_{x}")) for x in "ab")
    far = stars.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("head_a", "head_b")
    same = nodes.join(heads.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).where("node <> head.node").select(F.col("head").alias("head_a"), F.struct("node", "n").alias("head_b"))
    fit = (F.col("head_a.node") != F.col("head_b.node")) & _alike(F.col("head_a.n"), F.col("head_b.n"), similar)
    return far.unionByName(same).where(fit).select(F.col("head_a.node").alias("a"), F.col("head_b.node").alias("b"))


def _alike(n: Column, m: Column, similar: float) -> Column:
    """Sets of these sizes may be as similar as asked."""
    return F.least(n, m) >= F.greatest(n, m) * F.lit(similar)


def _grams(rows: DataFrame) -> DataFrame:
    """``node, grams`` of rows of ``node, text``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([grams(text or b"").tobytes()], pa.binary())], names=["node", "grams"])

    return rows.mapInArrow(of, "node long, grams binary")


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` that are as similar as asked."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = (batch.column(k).to_pylist() for k in (2, 3))
            good = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similar for x, y in zip(mine, other)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(f"_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    met = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    return met.select("a", "b", "grams_a", "grams_b").mapInArrow(of, "a long, b long")


class _Asked:
    """Sets of shingles by which the sets that stream by are looked up."""

    def __init__(self, nodes: list[int], roots: list[int], sets: list[np.ndarray]):
        self.nodes, self.roots = np.array(nodes), np.array(roots)
        self.sizes = np.array([len(s) for s in sets])
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        # Those of one root are tied already.
        first: dict[int, int] = {}
        self.tied = [first.setdefault(r, k) for k, r in enumerate(roots)]

    def _top(self, k: int) -> int:
        while self.tied[k] != k:
            self.tied[k] = k = self.tied[self.tied[k]]
        return k

    def links(self, node: int, root: int, held: np.ndarray, similar: float) -> Iterator[tuple[int, int]]:
        """Links that connect what this set and the sets asked for make similar, and are not connected here yet."""
        low, high = np.searchsorted(self.values, held, "left"), np.searchsorted(self.values, held, "right")
        runs = high - low
        at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        both = np.bincount(self.owners[at], minlength=len(self.nodes))
        near = np.flatnonzero((both / (self.sizes + len(held) - both) >= similar) & (self.nodes != node)).tolist()
        if near and any(self.roots[k] != root for k in near):
            yield int(self.nodes[near[0]]), node
        for k in near[1:]:
            one, other = self._top(near[0]), self._top(k)
            if one != other:
                self.tied[other] = one
                yield int(self.nodes[near[0]]), int(self.nodes[k])


def _bucket_links(asked: DataFrame, similar: float) -> DataFrame:
    """``a, b`` of rows ``key, part, streams, node, root, grams``: links between the texts
    held (``streams`` false, at most some ``HELD``) and those that stream by."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, index = None, [], None
        for batch in batches:
            out = []
            keys, parts, streams, nodes, roots = (batch.column(k).to_pylist() for k in range(5))
            for k in range(len(batch)):
                if (keys[k], parts[k]) != name:
                    name, held, index = (keys[k], parts[k]), [], None
                grams = np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64)
                if not streams[k]:
                    held.append((nodes[k], roots[k], grams.copy()))
                elif held:
                    index = index or _Asked(*map(list, zip(*held)))
                    out += index.links(nodes[k], roots[k], grams, similar)
            links = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])

    dealt = asked.select("key", "part", "streams", "node", "root", "grams").repartition("key", "part").sortWithinPartitions("key", "part", "streams")
    return dealt.mapInArrow(of, "a long, b long").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, held: int = HELD) -> DataFrame:
    """``doc_id, mark, root`` of every row of ``docs``: rows whose texts are linked have one ``root``.

    Linked are texts of a Jaccard of at least ``similar`` over their distinct 5-word
    shingles, and what such links connect. Texts without words are alike. ``mark`` is
    a hash of the text.

    Pairs are proposed by operator 7's search over SimHash fingerprints and by MinHash bands, which reach
    the pairs further apart than its bits; only their exact Jaccard links them. A bucket's members first meet its least one, a pair each. Those that are not
    connected to it by then are looked up against all members, in the task of their
    bucket: some ``held`` of them at a time are held there and the others
    stream by. What comes out is a link at most for each text that streams by, so a large group of
    copies makes no more rows than it has members. Buckets of the same members count once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    marks = settle(_marks(rows), "similar-marks")
    keyed = marks.select("node", "n", F.explode("keys").alias("key")).distinct()
    least = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("last")).where("head.node < last").select(F.col("key").alias("_key"), "head")
    shared = settle(keyed.join(least, F.col("key") == F.col("_key")).select("key", "node", "n", "head"), "similar-shared")
    near = settle(simhash_pairs(marks, similar), "similar-near")
    banded = shared.where("node <> head.node").where(_alike(F.col("n"), F.col("head.n"), similar)).select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    first = settle(near.unionByName(banded).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-first")
    members = shared.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    chosen = marks.join(members, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("of"))
    chosen = chosen.select("node", id_key(F.col("of.doc_id")).alias("_id"), F.col("of.mark").alias("_mark"))
    texts = rows.join(chosen, (id_key(F.col("doc_id")) == F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("node", "text")
    sets = settle(_grams(texts).dropDuplicates(["node"]), "similar-sets")
    links = settle(_verified(first, sets, similar), "similar-links")
    roots = settle(components(links, "similar-roots"), "similar-stars").select(F.col("node").alias("_of"), "root")

    rooted = shared.join(roots, F.col("node") == F.col("_of"), "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.col("head.node").alias("_head"))
    heads = rooted.where("node = _head").select(F.col("key").alias("_key"), F.col("root").alias("head"))
    placed = settle(rooted.join(heads, F.col("key") == F.col("_key")).select("key", "node", "root", (F.col("root") != F.col("head")).alias("apart")), "similar-placed")
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"m{k}") for k in (1, 2)]
    buckets = placed.groupBy("key").agg(F.count_if("apart").alias("asking"), F.count("*").alias("size"), *mark).where("asking > 0")
    buckets = buckets.groupBy("size", "m1", "m2").agg(F.min(F.struct("key", "asking")).alias("one")).select(
        F.col("one.key").alias("_key"), F.ceil(F.col("one.asking") / held).cast("int").alias("parts"))
    open_ = placed.join(buckets, F.col("key") == F.col("_key"))
    asking = open_.where("apart").select("key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("streams"), "node", "root")
    passing = open_.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("streams"), "node", "root")
    asked = asking.unionByName(passing).join(sets.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    more = settle(_bucket_links(asked, similar), "similar-more")
    final = components(links.unionByName(more), "similar-final").select(F.col("node").alias("_of"), "root")
    return marks.join(final, F.col("node") == F.col("_of"), "left").select("doc_id", "mark", F.coalesce("root", "node").alias("root"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Of the rows of ``docs`` that :func:`similar_groups` links, the one of the smallest id, with all its columns.

    A null id counts after all others. Rows that share an id are one only if linked.
    """
    key, mark = fresh(docs, "_key", "_mark")
    best = similar_groups(docs, id_col, text_col, similar).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("of"))
    stay = best.select(id_key(F.col("of.doc_id")).alias(key), F.col("of.mark").alias(mark))
    marked = docs.withColumn(key, id_key(F.col(id_col))).withColumn(mark, text_key(F.col(text_col)))
    return marked.join(stay, [key, mark]).dropDuplicates([key, mark]).select(docs.columns)
