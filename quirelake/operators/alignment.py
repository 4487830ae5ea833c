"""Two versions of a document's lines, aligned."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.operators.matching import join_same
from quirelake.operators.prefix import running_total
from quirelake.session import settle

#: Lines, and bytes of their texts, of a group whose two versions are aligned in one task; larger groups are aligned in rounds.
WALKED, WALKED_BYTES = 1 << 16, 1 << 26


def heaviest_rise(starts: Sequence[int], weights: Sequence[int]) -> list[int]:
    """Places of the rising subsequence of ``starts`` (all different) with the greatest weight."""
    order = {start: rank for rank, start in enumerate(sorted(starts), 1)}
    # Tree of prefix maxima over ranks: the best chain that ends at or below a rank.
    best, last = [0] * (len(starts) + 1), [-1] * (len(starts) + 1)
    before = [-1] * len(starts)
    top, end = 0, -1
    for k, (start, weight) in enumerate(zip(starts, weights)):
        rank = order[start]
        most, at, i = 0, -1, rank - 1
        while i:
            if best[i] > most:
                most, at = best[i], last[i]
            i &= i - 1
        before[k], most = at, most + weight
        if most > top:
            top, end = most, k
        i = rank
        while i <= len(starts):
            if most > best[i]:
                best[i], last[i] = most, k
            i += i & -i
    chain = []
    while end >= 0:
        chain.append(end)
        end = before[end]
    return chain[::-1]


def _kept(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of ``(*group, gap, left_no, right_no)``, a longest set that rises on both sides in each gap.

    Pairs next to each other on both sides stand or fall together, so a worker holds
    runs of them, not lines: a gap of a hundred million lines with ten passages moved
    about is some twenty runs.
    """
    names = [*group, "gap", "left_no", "right_no", "run"]
    schema = T.StructType([f for f in pairs.select(*group, "gap", "left_no", "right_no").schema] + [T.StructField("run", T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def runs() -> Iterator[list]:
            held: list = []
            for batch in batches:
                kinds[:] = [*batch.schema.types, pa.int64()]
                for *key, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and held[0] == key and left == held[1] + held[3] and right == held[2] + held[3]:
                        held[3] += 1
                        continue
                    if held:
                        yield held
                    held = [key, left, right, 1]
            if held:
                yield held

        for key, found in groupby(runs(), key=lambda r: r[0]):
            _, lefts, rights, sizes = zip(*found)
            stay = heaviest_rise(rights, sizes)
            columns = [[k] * len(stay) for k in key] + [[c[s] for s in stay] for c in (lefts, rights, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    dealt = pairs.select(*names[:-1]).repartition(*group, "gap").sortWithinPartitions(*names[:-2])
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("run") - 1)).alias("_step")
    return dealt.mapInArrow(of, schema).select(*names, steps).select(
        *group, (F.col("left_no") + F.col("_step")).alias("left_no"), (F.col("right_no") + F.col("_step")).alias("right_no"))


def _stay(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the pairs of a gap, in order of their left side, a longest set that rises on both, as in :func:`_kept`."""
    runs: list[list[int]] = []
    for left, right in pairs:
        if runs and left == runs[-1][0] + runs[-1][2] and right == runs[-1][1] + runs[-1][2]:
            runs[-1][2] += 1
        else:
            runs.append([left, right, 1])
    chosen = heaviest_rise([r[1] for r in runs], [r[2] for r in runs])
    return [(runs[k][0] + i, runs[k][1] + i) for k in chosen for i in range(runs[k][2])]


def _numbered(lines: Sequence[tuple[int, str]]) -> dict[tuple[str, int], int]:
    """Places of lines by text and how many equal ones come before."""
    seen: Counter = Counter()
    out = {}
    for place, text in lines:
        out[text, seen[text]] = place
        seen[text] += 1
    return out


def differences(left: Sequence[str], right: Sequence[str]) -> tuple[list[tuple[int, int]], list[tuple[int | None, int | None, str]]]:
    """Places of kept lines, and places and state of the others, of two versions that fit in memory."""
    sides = list(enumerate(left)), list(enumerate(right))
    same: list[tuple[int, int]] = []
    gaps = []
    waiting = [sides]
    while waiting:
        one, other = waiting.pop()
        counts, others = Counter(t for _, t in one), Counter(t for _, t in other)
        there: dict = {t: place for place, t in other}
        pairs = [(place, there[t]) for place, t in one if counts[t] == 1 and others[t] == 1]
        open_ = bool(pairs)
        if not open_:  # no line is alone on both sides: repeated lines meet by number
            there = _numbered(other)
            pairs = [(place, there[key]) for key, place in _numbered(one).items() if key in there]
        kept = _stay(pairs)
        same += kept
        first, second = (one[0][0] if one else 0), (other[0][0] if other else 0)
        i, j = 0, 0
        for a, b in [*kept, (first + len(one), second + len(other))]:
            part = one[i : a - first], other[j : b - second]
            if all(part) and open_:
                waiting.append(part)
            elif any(part):
                gaps.append(part)
            i, j = a - first + 1, b - second + 1
    stays = {a for a, _ in same}, {b for _, b in same}
    here, there = (_numbered([line for line in side if line[0] not in kept]) for side, kept in zip(sides, stays))
    moved = [(place, there[key]) for key, place in here.items() if key in there]
    gone = {a for a, _ in moved}, {b for _, b in moved}
    out: list[tuple[int | None, int | None, str]] = [(a, b, "moved") for a, b in moved]
    for gap in gaps:
        one, other = ([place for place, _ in lines if place not in away] for lines, away in zip(gap, gone))
        met = min(len(one), len(other))
        out += [(a, b, "changed") for a, b in zip(one, other)]
        out += [(a, None, "deleted") for a in one[met:]] + [(None, b, "inserted") for b in other[met:]]
    return same, out


def _walked(a: DataFrame, b: DataFrame, group: Sequence[str], same: bool) -> DataFrame:
    """As :func:`align_lines`, for groups that fit a task: lines are shuffled once, with their texts."""
    names = [*group, "left_no", "right_no", "state", "left", "right"]
    both = a.withColumn("_right", F.lit(False)).unionByName(b.withColumn("_right", F.lit(True)))
    columns = [F.col("line_no").cast("long").alias("line_no"), F.col("text").cast("string").alias("text")]
    dealt = both.select(*group, "_right", *columns).repartition(*group).sortWithinPartitions(*group, "_right", "line_no", "text")
    keys = [T.StructField(f.name, f.dataType) for f in dealt.select(*group).schema]
    kinds = [("left_no", T.LongType()), ("right_no", T.LongType()), ("state", T.StringType()), ("left", T.StringType()), ("right", T.StringType())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def read() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [*batch.schema.types[: len(group)], pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        for key, found in groupby(read(), key=lambda r: r[: len(group)]):
            lines: tuple[list, list] = [], []
            for *_, right, no, text in found:
                lines[right].append((no, text))
            kept, changes = differences(*([text or "" for _, text in side] for side in lines))
            if same:
                changes += [(a, b, "same") for a, b in kept]
            for a, b, state in changes:
                left, right = (None, None) if a is None else lines[0][a], (None, None) if b is None else lines[1][b]
                out.append((*key, left[0], right[0], state, left[1], right[1]))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return dealt.mapInArrow(of, T.StructType([*keys, *(T.StructField(n, t) for n, t in kinds)]))


def align_lines(a: DataFrame, b: DataFrame, group: Sequence[str] = ("doc_id",), same: bool = False, walked: int = WALKED) -> DataFrame:
    """Differences of two versions: ``(*group, left_no, right_no, state, left, right)``.

    ``a`` and ``b`` have the group columns, ``line_no`` (unique in a group) and
    ``text``. Lines that occur once on each side are anchors; the longest set of them
    that rises on both sides is kept, and the gaps between kept lines are searched in
    the same way until no gap has an anchor. Repeated lines of a gap then meet by
    their number: its third blank line on one side and on the other. What is left is
    ``moved`` if the text is left on the other side too, ``changed`` in pairs, by
    order, where both sides of a gap have lines, else ``deleted`` or ``inserted``. With ``same``, kept
    lines are returned too. A null text counts as empty; a null in a group
    column is a group of its own.

    A group of at most ``walked`` lines, both versions together, is aligned where its lines
    meet: they are shuffled once. Larger ones are aligned in rounds (:func:`_in_rounds`).
    """
    group = list(group)
    sizes = a.select(*group, "text").unionByName(b.select(*group, "text")).groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = settle(sizes.where((F.col("n") > walked) | (F.col("bytes") > WALKED_BYTES)).select(*group), "aligned-large")
    if large.isEmpty():
        return _walked(a, b, group, same)
    small, rest = ([join_same(df.select(*group, "line_no", "text"), large, group, how) for df in (a, b)] for how in ("left_anti", "left_semi"))
    return _walked(*small, group, same).unionByName(_in_rounds(*rest, group, same))


def _in_rounds(a: DataFrame, b: DataFrame, group: list[str], same: bool) -> DataFrame:
    """As :func:`align_lines`, for groups of any size.

    Texts are hashed where they are read and only digests are shuffled, but for the
    differences themselves. Counts and numbers are taken in blocks, so a document may
    hold any share of the lines.
    """

    def met(one: DataFrame, other: DataFrame, keys: Sequence[str], how: str, also: Sequence[str] = ()) -> DataFrame:
        return join_same(one, other.select(*keys, *also), keys, how)

    def lines(df: DataFrame, name: str) -> DataFrame:
        digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
        return df.select(*group, F.col("line_no").cast("long").alias(name), digest.alias("mark"), F.lit(0).cast("long").alias("gap"), F.lit(False).alias("kept"))

    def once(df: DataFrame, name: str) -> DataFrame:
        counted = df.where("NOT kept").groupBy(*group, "gap", "mark").agg(F.count("*").alias("_n"), F.min(name).alias(name))
        return counted.where("_n = 1").drop("_n")

    def gaps(df: DataFrame, kept: DataFrame, name: str) -> DataFrame:
        """Mark kept lines; a line's gap is the number of kept lines before it."""
        marked = met(df, kept.withColumn("_now", F.lit(True)), [*group, name], "left", ["_now"])
        marked = marked.withColumn("kept", F.col("kept") | F.coalesce("_now", F.lit(False))).drop("_now", "gap")
        return settle(running_total(marked, group, name, F.col("kept").cast("long"), "gap").select(*df.columns), "aligned-lines")

    left, right = settle(lines(a, "left_no"), "aligned-lines"), settle(lines(b, "right_no"), "aligned-lines")
    pairs = None
    while True:
        anchors = settle(met(once(left, "left_no"), once(right, "right_no"), [*group, "gap", "mark"], "inner", ["right_no"]), "aligned-anchors")
        last = anchors.isEmpty()
        if last:  # no gap has a line that is alone on both sides: repeated lines meet by number
            again = [running_total(df.where("NOT kept"), [*group, "gap", "mark"], name, F.lit(1), "again") for df, name in ((left, "left_no"), (right, "right_no"))]
            anchors = met(*again, [*group, "gap", "mark", "again"], "inner", ["right_no"])
        kept = settle(_kept(anchors, group), "aligned-kept")
        pairs = kept if pairs is None else pairs.unionByName(kept)
        left, right = gaps(left, kept, "left_no"), gaps(right, kept, "right_no")
        if last:
            break
    rest = [running_total(df.where("NOT kept"), [*group, "mark"], name, F.lit(1), "again") for df, name in ((left, "left_no"), (right, "right_no"))]
    moved = settle(met(*rest, [*group, "mark", "again"], "inner", ["right_no"]).select(*group, "left_no", "right_no"), "aligned-moved")
    lone = [
        running_total(met(df.where("NOT kept"), moved, [*group, name], "left_anti"), [*group, "gap"], name, F.lit(1), "again").select(*group, "gap", "again", name)
        for df, name in ((left, "left_no"), (right, "right_no"))
    ]
    names = [*group, "gap", "again"]
    one, other = lone[0], lone[1].select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(names)], "right_no")
    both = one.join(other, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(names)], "full_outer")
    here = F.col("left_no").isNotNull()
    edited = both.select(
        *[F.when(here, F.col(k)).otherwise(F.col(f"_k{n}")).alias(k) for n, k in enumerate(group)], "left_no", "right_no",
        F.when(F.col("left_no").isNull(), "inserted").when(F.col("right_no").isNull(), "deleted").otherwise("changed").alias("state"))
    out = edited.unionByName(moved.withColumn("state", F.lit("moved")))
    if same:
        out = out.unionByName(pairs.withColumn("state", F.lit("same")))

    def texts(df: DataFrame, name: str, side: str) -> DataFrame:
        return df.select(*group, F.col("line_no").cast("long").alias(name), F.col("text").alias(side))

    out = met(out, texts(a, "left_no", "left"), [*group, "left_no"], "left", ["left"])
    out = met(out, texts(b, "right_no", "right"), [*group, "right_no"], "left", ["right"])
    return out.select(*group, "left_no", "right_no", "state", "left", "right")
