"""Near duplicates by SimHash and a generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.components import components
from quirelake.llm.names import fresh, id_key
from quirelake.session import settle

BITS = 64
#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 2
SHINGLE = 3
SEED = 42
#: A bucket of more fingerprints is cut into finer buckets.
BUCKET = 4096
#: Cost of a signature in the shuffle against that of comparing two fingerprints.
SIGNATURE_COST, COMPARE_COST = 1.0, 0.02
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint: bit ``k`` is set in over half the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (as a signed long) of every row; a null text has no words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            marks = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(of, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


# Planning the search


def bit_products(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each two bits are set together."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            rows += len(raw)
        flat = np.append(total.ravel(), rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "n"])

    sums = prints.select("fp").mapInArrow(of, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    cells = np.array([r["n"] for r in sums], float) if sums else np.zeros(BITS * BITS + 1)
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_groups(rows: int, together: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in ``groups`` parts of near equal width, each grown by its most correlated bit."""
    n = max(rows, 1)
    rate = together.diagonal() / n
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    tie = np.abs((together / n - np.outer(rate, rate)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, found = set(range(BITS)), []
    for g in range(groups):
        width = len(free) // (groups - g)
        part = [max(sorted(free), key=lambda b: tie[b, sorted(free)].sum())]
        free.discard(part[0])
        while len(part) < width:
            part.append(max(sorted(free), key=lambda b: tie[b, part].sum()))
            free.discard(part[-1])
        found.append(sorted(part))
    return found


def candidates(rows: int, rates: np.ndarray, part: list[int], most: int) -> list[float]:
    """Expected fingerprints within 0 .. ``most`` bits of a random one, in one part.

    The number of differing bits is a sum of independent trials, bit ``b`` differing
    at ``2 p (1 - p)`` for its rate ``p`` over all fingerprints.
    """
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for b in part:
        differ = 2 * rates[b] * (1 - rates[b])
        chance = chance * (1 - differ) + np.append(0, chance[:-1]) * differ
    return [float(rows * x) for x in np.cumsum(chance)]


def allocate(rows: int, rates: np.ndarray, parts: list[list[int]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Cheapest thresholds with ``sum(t + 1) = distance + 1``; -1 leaves a part out.

    If every part differed by more than its threshold, the whole would differ by at
    least ``sum(t + 1) > distance`` bits, so no link is missed.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        near = candidates(rows, rates, part, distance)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance - used + 1):
                ball = sum(len(list(combinations(range(len(part)), k))) for k in range(t + 1))
                more = 0.0 if t < 0 else SIGNATURE_COST * ball + COMPARE_COST * near[t]
                if used + t + 1 not in step or cost + more < step[used + t + 1][0]:
                    step[used + t + 1] = (cost + more, [*chosen, t])
        best = step
    return best[distance + 1]


def plan(prints: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The parts to probe and their thresholds, over the cheapest number of parts."""
    rows, together = bit_products(prints)
    rates = together.diagonal() / max(rows, 1)
    options = []
    for groups in range(1, distance + 3):
        parts = correlated_groups(rows, together, groups)
        cost, chosen = allocate(rows, rates, parts, distance)
        options.append((cost, groups, [(p, t) for p, t in zip(parts, chosen) if t >= 0]))
    return min(options)[2]


# Probing and verifying


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def signatures(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``cover, key, fp``: the fingerprint's bits in a part, as they are and with up to t flipped."""
    found = []
    for bits, most in parts:
        flips = [_mask(list(c)) for k in range(most + 1) for c in combinations(bits, k)]
        flip = F.explode(F.array(*[F.lit(f).cast("long") for f in flips])) if len(flips) > 1 else F.lit(0).cast("long")
        cover = F.lit(_mask(bits)).cast("long")
        found.append(prints.select(cover.alias("cover"), F.col("fp"), flip.alias("flip")).select(
            "cover", (F.col("fp").bitwiseAND(F.col("cover"))).bitwiseXOR(F.col("flip")).alias("key"), "fp"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _finer(cover: int, distance: int) -> list[int]:
    """Masks that cut the bits outside ``cover`` into ``distance + 1`` parts."""
    rest = [b for b in range(BITS) if not (cover >> b) & 1]
    return [_mask(rest[k :: distance + 1]) for k in range(distance + 1)]


def buckets(rows: DataFrame, distance: int = DISTANCE, limit: int = BUCKET, label: str = "buckets") -> DataFrame:
    """The signatures with every bucket of over ``limit`` rows cut finer.

    Two linked fingerprints of a bucket differ in at most ``distance`` of the bits
    its key leaves open, so they agree on one of ``distance + 1`` parts of those.
    Cutting ends at covers whose few open bits bound a bucket by themselves.
    """
    covers = [r["cover"] for r in rows.select("cover").distinct().collect()]  # as many as the plan has parts
    done = None
    while covers:
        big = settle(
            rows.where(F.col("cover").isin(covers)).groupBy("cover", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("cover").alias("of"), F.col("key").alias("at")), label
        )
        if big.isEmpty():
            break
        same = (F.col("cover") == F.col("of")) & (F.col("key") == F.col("at"))
        small = rows.join(big, same, "left_anti")
        done = small if done is None else done.unionByName(small)
        hot = rows.join(big, same, "left_semi")
        masks = {c: _finer(c, distance) for c in covers}
        table = F.create_map(*[x for c, ms in masks.items() for x in (F.lit(c).cast("long"), F.array(*[F.lit(m).cast("long") for m in ms]))])
        rows = settle(
            hot.select("cover", "key", "fp", F.explode(table[F.col("cover")]).alias("more")).select(
                F.col("cover").bitwiseOR(F.col("more")).alias("cover"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("more"))).alias("key"), "fp"), label
        )
        covers = sorted({_signed((c | m) & ((1 << BITS) - 1)) for c, ms in masks.items() for m in ms if BITS - bin((c | m) & ((1 << BITS) - 1)).count("1") > 8})
        if not covers:
            break
    return rows if done is None else done.unionByName(rows)


def _stars(prints: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A star over every group of fingerprints that links within the bucket connect."""
    left = np.unique(prints)
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 256):
                near |= (np.bitwise_count(left[:, None] ^ frontier[None, at : at + 256]) <= distance).any(axis=1)
            frontier, left = left[near], left[~near]
            yield from ((int(root), int(x)) for x in frontier)


def bucket_links(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links that connect what the true links inside each bucket connect."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        last = None

        def emit(members: list[np.ndarray], out: list[tuple[int, int]]) -> None:
            bucket = np.concatenate(members) if len(members) > 1 else members[0]
            if len(bucket) > 1:
                out += _stars(bucket, distance)

        def packed(out: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            cover, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fp):
                continue
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((np.diff(cover) != 0) | (np.diff(key) != 0)) + 1
            edges = [0, *cuts.tolist(), len(fp)]
            out: list[tuple[int, int]] = []
            for start, end in zip(edges, edges[1:]):
                name = (cover[start], key[start])
                if name != last:
                    if kept:
                        emit(kept, out)
                    kept, last = [], name
                kept.append(fp[start:end])
            yield packed(out)
        out = []
        if kept:
            emit(kept, out)
        yield packed(out)

    dealt = rows.repartition("cover", "key").sortWithinPartitions("cover", "key")
    return dealt.mapInArrow(of, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, limit: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``distance``
    differing bits, the row's own included. Null and empty texts have fingerprint
    zero and link like any other; null ids never name a component unless it holds
    no other. Repeated rows share their component. Equal fingerprints are one from
    the start, so copies make no pairs. An empty table gives no rows; other columns
    are not read, whatever their names.
    """
    prints = settle(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    place = _places(prints, distance, limit)
    return prints.join(place, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id"
    )


def _places(prints: DataFrame, distance: int, limit: int = BUCKET) -> DataFrame:
    """``_fp, component_id, root`` of every fingerprint."""
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    rows = buckets(signatures(distinct, plan(distinct, distance)), distance, limit)
    roots = components(bucket_links(rows, distance), "simhash-links")
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    place = settle(named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id", "root"), "simhash-place")
    return place


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that name their component, one per component, with all their columns.

    Rows that share an id, a null one included, are one document only if they are linked.
    """
    key, mark = fresh(docs, "_key", "_mark")
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark")).alias("doc_id"), F.col(text_col).alias("text"))
    prints = settle(fingerprints(texts), "simhash-prints")
    rooted = prints.join(_places(prints, distance), F.col("fp") == F.col("_fp"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id.id").isNull(), "doc_id")).alias("of"))
    stay = best.select(id_key(F.col("of.doc_id.id")).alias(key), F.col("of.doc_id.mark").alias(mark))
    marked = docs.withColumn(key, id_key(F.col(id_col))).withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.join(stay, [key, mark]).dropDuplicates([key, mark]).select(docs.columns)
