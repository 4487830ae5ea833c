"""Passages that repeat across documents, by a sparse suffix array over minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.bitmaps import BITS, bitmap, held_in
from quirelake.llm.names import fresh
from quirelake.session import settle

#: Words of the shortest passage that counts.
PASSAGE = 50
#: Words of the shortest match of two suffixes; the minimum over the ``PASSAGE - PREFIX + 1`` prefixes
#: of a passage-long window chooses its position.
PREFIX = 16
#: Rows held and compared at once. Suffixes of a prefix with more rows are compared
#: window by window, so that no prefix gathers in a task.
RUN = 1 << 14
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 1_000_000
#: Words of one text handled at once.
BLOCK = 1 << 18

_FACTOR = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``width`` words, from runs of doubling length."""
    total, length, power, have = None, 0, hashes, 1
    while length < width:
        factor = np.uint64(pow(_FACTOR, have, 1 << 64))
        if width & have:
            keep = len(hashes) - length - have + 1
            total = power[:keep] if total is None else total[:keep] * factor + power[length : length + keep]
            length += have
        if length < width:
            power = power[:-have] * factor + power[have:]
            have *= 2
    return _mixed(total)


def suffixes(words: np.ndarray, passage: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a text by the suffix each chooses.

    Every window of ``passage`` words chooses the position of its least prefix hash
    inside it, the first of equals. That rests on the window's words alone, so equal
    windows choose equal suffixes at the same distance. Returns the prefix hash and
    the position of each chosen suffix, in order, and its first and last window;
    consecutive windows share a suffix.
    """
    if len(words) < passage:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    heads = _rolled(words, prefix)
    span = passage - prefix + 1
    chosen = np.arange(len(words) - passage + 1) + np.lib.stride_tricks.sliding_window_view(heads, span).argmin(axis=1)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    at = chosen[first]
    return heads[at], at, first, np.append(first[1:], len(chosen)) - 1


#: Stands for a null id while documents are compared.
NO_ID = -(1 << 63)


def _read(batch: pa.RecordBatch, known: _Hashes, passage: int, prefix: int) -> Iterator[tuple[int, list[bytes], tuple[np.ndarray, ...]]]:
    """Row number, words and chosen suffixes of each text, long texts block by block."""
    for row, text in enumerate(batch.column(1).cast(pa.binary())):
        found = (text.as_py() or b"").lower().split()
        if len(found) < passage:
            continue
        words = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        for base in range(0, len(words) - passage + 1, BLOCK):
            head, *places = suffixes(words[base : base + BLOCK + passage - 1], passage, prefix)
            yield row, found, (head, *(p + base for p in places))


def prefix_counts(docs: DataFrame, passage: int, prefix: int) -> DataFrame:
    """``prefix, n, least, most``: chosen suffixes by prefix hash, counted in each batch first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            owners, heads = [], []
            for row, _, found in _read(batch, known, passage, prefix):
                owners.append(np.full(len(found[0]), batch.column(0)[row].as_py()))
                heads.append(found[0])
            if heads:
                head, doc = np.concatenate(heads), np.concatenate(owners)
                order = np.lexsort((doc, head))
                head, doc = head[order], doc[order]
                at = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
                end = np.append(at[1:], len(head))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(head[at].view(np.int64)), pa.array(end - at), pa.array(doc[at]), pa.array(doc[end - 1])], names=["prefix", "n", "least", "most"])

    counted = docs.mapInArrow(of, "prefix long, n long, least long, most long")
    return counted.groupBy("prefix").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def sparse_suffixes(docs: DataFrame, shared, crowded, bits: int, passage: int, prefix: int) -> DataFrame:
    """``prefix, doc_id, start, before, suffix, window, starts, ends``: chosen suffixes whose prefix another document may have.

    ``suffix`` holds the words from the chosen position to the end of the last window
    that chose it, ``before`` those from its first window, number ``start``, up to the
    position; a space ends every word. For a prefix in ``crowded`` a row is a window
    instead: 128 bits of a hash of its words, and where it stands in the text, as word
    ranges: those of a loop touch and are one.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = _Hashes(), ["prefix", "doc_id", "start", "before", "suffix", "window", "starts", "ends"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for row, found, (head, at, first, last) in _read(batch, known, passage, prefix):
                kept = np.flatnonzero(held_in(shared.value, head, bits))
                if not len(kept):
                    continue
                doc = batch.column(0)[row].as_py()
                joined = b" ".join(found) + b" "
                ends = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1))
                many = held_in(crowded.value, head[kept], bits)
                few = kept[~many]
                spans = zip(ends[first[few]].tolist(), ends[at[few]].tolist(), ends[last[few] + passage].tolist())
                parts = [(joined[a:b], joined[b:c]) for a, b, c in spans]
                windows: dict[bytes, tuple[list[int], list[int]]] = {}
                for a, b in zip(first[kept[many]].tolist(), last[kept[many]].tolist()):
                    for k in range(a, b + 1):
                        starts, stops = windows.setdefault(xxhash.xxh3_128_digest(joined[ends[k] : ends[k + passage]]), ([], []))
                        if stops and k <= stops[-1]:
                            stops[-1] = k + passage
                        else:
                            starts.append(k)
                            stops.append(k + passage)
                n, w = len(few), len(windows)
                columns[0] += head[few].view(np.int64).tolist() + [None] * w
                columns[1] += [doc] * (n + w)
                columns[2] += first[few].tolist() + [None] * w
                columns[3] += [p[0] for p in parts] + [None] * w
                columns[4] += [p[1] for p in parts] + [None] * w
                columns[5] += [None] * n + list(windows)
                for k in range(2):
                    columns[6 + k] += [None] * n + [runs[k] for runs in windows.values()]
                if len(columns[0]) >= 1 << 13:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
                    columns = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.mapInArrow(of, "prefix long, doc_id long, start long, before binary, suffix binary, window binary, starts array<long>, ends array<long>")


def _numbered(texts: pa.Array, width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text as numbers, at most ``width`` and 0 beyond its end, and how many it has."""
    listed = pc.split_pattern(texts, " ")
    ends = listed.offsets.to_numpy()
    sizes = np.diff(ends) - 1
    codes = listed.values.dictionary_encode().indices.to_numpy() + 1
    out = np.zeros((len(texts), width), np.uint32)
    take = np.minimum(sizes, width)
    row = np.repeat(np.arange(len(texts)), take)
    col = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
    out[row, col] = codes[(ends[1:] - 2)[row] - col if backwards else ends[:-1][row] + col]
    return out, sizes


def _shared(rows: np.ndarray) -> np.ndarray:
    """Number of leading words that each row has in common with the one above."""
    same = rows[1:] == rows[:-1]
    return np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)) if rows.shape[1] else np.zeros(len(same), np.int64)


def _classes(common: np.ndarray, depth: int) -> np.ndarray:
    """Per row and number of words: a number that rows share if they share those words."""
    new = np.zeros((len(common) + 1, depth + 1), np.int32)
    new[1:] = common[:, None] < np.arange(depth + 1)
    return np.cumsum(new, axis=0, dtype=np.int32)


def _compare(heads: np.ndarray, docs: np.ndarray, starts: np.ndarray, before: pa.Array, suffix: pa.Array, passage: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Word ranges of windows that another document has too, for suffixes in sorted order.

    Neighbours are compared word by word: how far a suffix agrees with the one above
    tells which rows match to the right, for every length. The words before are
    sorted and compared likewise, nearest first, for the extension to the left. A
    window is shared where both sides of it match.
    """
    right, n_right = _numbered(suffix, passage)
    left, n_left = _numbered(before, passage - prefix, backwards=True)
    run = np.append(0, np.cumsum(heads[1:] != heads[:-1]))
    common = np.where(run[1:] == run[:-1], _shared(right), 0)
    to_right = _classes(common, passage)
    reads = np.ascontiguousarray(np.column_stack([run, left]).astype(">u4"))
    order = np.argsort(reads.view(f"S{reads.shape[1] * 4}").ravel(), kind="stable")
    common = np.where(run[order][1:] == run[order][:-1], _shared(left[order]), -1)
    to_left = np.empty((len(run), passage - prefix + 1), np.int32)
    to_left[order] = _classes(common, passage - prefix)
    sizes = n_left + n_right - passage + 1
    owner = np.repeat(np.arange(len(docs)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    away = n_left[owner] - within
    keys = (away * len(docs) + to_left[owner, away]) * len(docs) + to_right[owner, passage - away]
    order = np.lexsort((docs[owner], keys))
    keys, owner, within = keys[order], owner[order], within[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    last = np.append(first[1:], len(keys)) - 1
    least, most = docs[owner[first]], docs[owner[last]]
    same = np.repeat(np.arange(len(first)), last - first + 1)
    hit = (least != most)[same]
    owner, within, same = owner[hit], within[hit], same[hit]
    mine = docs[owner]
    other = np.where(least[same] == mine, most[same], least[same])
    begin = starts[owner] + within
    return _merge(mine, begin, begin + passage, other, least[same] == mine)


def _merge(docs: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join ranges of one document that touch, of equal ``other`` and ``first``."""
    order = np.lexsort((start, first, other, docs))
    docs, start, end, other, first = (x[order] for x in (docs, start, end, other, first))
    if not len(docs):
        return docs, start, end, other, first
    new = np.append(True, (docs[1:] != docs[:-1]) | (other[1:] != other[:-1]) | (first[1:] != first[:-1]) | (start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return docs[at], start[at], end[np.append(at[1:], len(docs)) - 1], other[at], first[at]


def _neighbours(rows: DataFrame, passage: int, prefix: int, run: int) -> DataFrame:
    """Sort suffixes by prefix and words, and compare them as they stream by: matched ranges.

    A prefix has at most ``run`` rows here, so a task holds twice as many at most.
    """
    names = ["doc_id", "start", "end", "other_id", "first"]

    def matched(held: pa.Table) -> pa.RecordBatch:
        heads, docs, starts = (held.column(k).to_numpy() for k in range(3))
        # A prefix that stands alone matches nothing.
        same = heads[1:] == heads[:-1]
        pair = np.append(same, False) | np.append(False, same)
        before, suffix = (held.column(k).filter(pa.array(pair)).combine_chunks() for k in (3, 4))
        found = _compare(heads[pair], docs[pair], starts[pair], before, suffix, passage, prefix) if pair.any() else [heads[:0]] * 4 + [pair[:0]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= run:
                # Keep back the rows of the last prefix: more of them may follow.
                table = pa.Table.from_batches(held)
                heads = table.column(0).to_numpy()
                cut = int(np.searchsorted(heads, heads[-1]))
                if cut:
                    yield matched(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield matched(pa.Table.from_batches(held))

    dealt = rows.repartition("prefix").sortWithinPartitions("prefix", "suffix", "before")
    return dealt.mapInArrow(of, "doc_id long, start long, end long, other_id long, first boolean")


def _crowds(rows: DataFrame) -> DataFrame:
    """Matched ranges of the windows of crowded prefixes: equal ones by their hash."""
    equal = Window.partitionBy("window")
    met = rows.select("window", "doc_id", "starts", "ends", F.min("doc_id").over(equal).alias("least"), F.max("doc_id").over(equal).alias("most")).where("least <> most")
    mine = F.col("doc_id") == F.col("least")
    return met.select(
        "doc_id", F.when(mine, F.col("most")).otherwise(F.col("least")).alias("other_id"), mine.alias("first"), F.inline(F.arrays_zip("starts", "ends"))
    ).select("doc_id", F.col("starts").alias("start"), F.col("ends").alias("end"), "other_id", "first")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX, run: int = RUN, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, n_words, other_id, first``: what documents share.

    Words are runs without ASCII white space, A-Z in lower case; ``start`` and
    ``end`` (exclusive) count them. A word is in a passage if ``passage`` words in a
    row around it are found, word for word, in another document. Ranges that overlap
    or touch are one row per document and ``first``, which is true where no document
    of smaller id has the words; ``other_id`` is the least id among the other documents
    its parts were met in. Documents that share nothing have no rows; neither have null,
    empty and short texts. Rows of equal id are one document, whose repeats within
    itself do not count, and so are rows of null id. Ids are integers. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    counts = settle(prefix_counts(texts, passage, prefix).where("least <> most").select(F.col("prefix").alias("h"), "n"), "suffix-prefixes")
    shared, crowded = send(bitmap(counts, bits)), send(bitmap(counts.where(F.col("n") > run), bits))
    rows = settle(sparse_suffixes(texts, shared, crowded, bits, passage, prefix), "suffix-rows")
    few = rows.where("window IS NULL").select("prefix", "doc_id", "start", "before", "suffix")
    ranges = _neighbours(few, passage, prefix, run).unionByName(_crowds(rows.where("window IS NOT NULL")))
    # One row a place: a document, that of all null ids too, has no more rows than its longest text has words.
    ranges = ranges.groupBy("doc_id", "first", "start").agg(F.max("end").alias("end"), F.min("other_id").alias("other_id"))
    each = Window.partitionBy("doc_id", "first").orderBy("start", "end")
    before = F.max("end").over(each.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("island", F.sum("new").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return islands.groupBy("doc_id", "first", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_id").alias("other_id")).select(
        real("doc_id").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), real("other_id").alias("other_id"), "first")


def cut_repeats(docs: DataFrame, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs``, passages that a document of smaller id has cut from the text."""
    later = repeated_passages(docs, passage, id_col=id_col, text_col=text_col).where("NOT first")
    key, held = fresh(docs, "_id", "_cuts")
    cuts = later.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(held))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        import re

        out = []
        for text, spans in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist()):
            if text and spans:
                places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
                ends = [0, *(places[s["end"] - 1][1] for s in spans if s["end"] <= len(places))]
                starts = [*(places[s["start"]][0] for s in spans if s["end"] <= len(places)), len(text)]
                text = b"".join(text[a:b] for a, b in zip(ends, starts))
            out.append(text)
        return pa.array(out, pa.binary()).cast(pa.string())

    joined = docs.join(cuts, F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col(held))).drop(key, held)
