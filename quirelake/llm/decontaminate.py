"""Benchmark decontamination by a broadcast set of normalised test windows."""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.names import fresh

#: Consecutive item words in a window.
WINDOW = 10
#: Words of test texts in one broadcast set, each some 60 bytes with its window and up to
#: 150 more where it is new: some 55 MB for words of common length. More words make more sets.
SET_WORDS = 1 << 18
#: Windows are looked up in a table of this many bits first.
FILTER_BITS = 22

#: Lower-cases A-Z, keeps digits, a-z and bytes beyond ASCII, and turns the rest into spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_HITS = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, lower-cased in A-Z."""
    return text.translate(_FOLD).split()


class TestSet:
    """The distinct windows of test items, with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, seed: int = 6):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32) for _, text in items]
        self.marks = np.random.default_rng(seed).integers(1, 1 << 63, len(self.vocabulary) + 1, np.uint64)
        #: By width: hashes of the windows in order, their word numbers and items, and the filter.
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for width in {min(window, len(ids)) for ids in texts} - {0}:
            mine = [(ids, number[item]) for ids, (item, _) in zip(texts, items) if min(window, len(ids)) == width]
            hashes = np.concatenate([self._hashes(ids, width) for ids, _ in mine])
            grid = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, width) for ids, _ in mine])
            owner = np.concatenate([np.full(len(ids) - width + 1, k, np.int32) for ids, k in mine])
            order = np.lexsort((owner, hashes))
            hashes, grid, owner = hashes[order], grid[order], owner[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]) | (grid[1:] != grid[:-1]).any(axis=1))
            marked = np.zeros(1 << FILTER_BITS, bool)
            marked[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.tables[width] = hashes[new], grid[new], owner[new], marked

    def _hashes(self, ids: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` words, from hashes of doubling length."""
        total, length, power, have = None, 0, self.marks[ids], 1
        while True:
            if width & have:
                keep = len(power) - length if total is not None else len(power)
                total = power if total is None else total[:keep] * _POWERS(have) + power[length : length + keep]
                length += have
            if length == width:
                return total[: len(ids) - width + 1]
            power = power[:-have] * _POWERS(have) + power[have:]
            have *= 2

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged spans of hit words, and the items hit."""
        found = words(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int32, len(found))
        spans, items = [], set()
        for width, (hashes, grid, owner, marked) in self.tables.items():
            if len(ids) < width:
                continue
            mine = self._hashes(ids, width)
            at = np.flatnonzero(marked[mine >> np.uint64(64 - FILTER_BITS)])
            low, high = (np.searchsorted(hashes, mine[at], side) for side in ("left", "right"))
            for k, a, b in zip(*(x[low < high].tolist() for x in (at, low, high))):
                same = (grid[a:b] == ids[k : k + width]).all(axis=1)
                if same.any():
                    spans.append((k, k + width))
                    items.update(owner[a:b][same].tolist())
        return len(found), merged(spans), [self.names[k] for k in sorted(items)]


def _POWERS(length: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, length, 1 << 64))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def test_sets(benchmark: DataFrame, window: int = WINDOW, set_words: int = SET_WORDS, item_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcast window sets, each of about ``set_words`` words of test texts, built one at a time.

    The words are counted first. Long items are cut into pieces that share all but
    one word of a window, so that every window is in one piece; pieces are dealt to
    sets by a hash of place, id and text. Null texts have no windows.
    """
    spark = benchmark.sparkSession
    found = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    counted = items.withColumn("n", F.size(found))
    total = counted.agg(F.sum("n")).first()[0] or 0
    sets = max(1, math.ceil(total / set_words))
    step = max(1, set_words // 16)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)), F.lit(step)), lambda at: F.struct(
        at.alias("at"), F.array_join(F.slice(found, at + 1, F.lit(step + window - 1)), " ").alias("piece")))
    pieces = counted.select("item", F.inline(F.when(F.col("n") <= step, F.array(F.struct(F.lit(0).alias("at"), F.col("text").alias("piece")))).otherwise(cut)))
    sent = []
    for k in range(sets):
        share = pieces.where(F.pmod(F.xxhash64("at", "item", "piece"), F.lit(sets)) == k).collect()
        sent.append(spark.sparkContext.broadcast(TestSet([(r["item"] or "", r["piece"].encode()) for r in share], window)))
    return sent


def hits(text: Column, sets: list) -> Column:
    """``n_words``, merged ``spans`` of word positions and ``items`` of a text, as a struct.

    The sets take turns on each batch of texts; a worker keeps all of them.
    """

    @F.arrow_udf("struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>")
    def scan(texts: pa.Array) -> pa.Array:
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        rows = [(0, [], set()) for _ in raw]
        for chosen in sets:
            test = chosen.value
            for k, t in enumerate(raw):
                n, spans, items = test.scan(t)
                rows[k] = n, rows[k][1] + spans, rows[k][2].union(items)
        return pa.array([(n, [{"start": s, "end": e} for s, e in merged(spans)], sorted(items)) for n, spans, items in rows], _HITS)

    return scan(text)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", set_words: int = SET_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, items, spans``.

    A window is ``window`` consecutive words of an item, or all words of a shorter
    one. ``spans`` are merged word ranges, end exclusive, that windows cover;
    ``items`` the ids, as sorted strings, of items with a window in the text. Null
    and empty texts have no words and no hits; items without words never occur;
    repeated rows and repeated items change nothing. A null item id reads as the
    empty string. An empty table gives no rows, an empty benchmark no hits. No row is
    shuffled; other columns are not read, whatever their names.
    """
    scanned = docs.select(F.col(id_col).alias("doc_id"), hits(F.col(text_col), test_sets(benchmark, window, set_words)).alias("_hits"))
    covered = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return scanned.select(
        "doc_id", F.col("_hits.n_words").alias("n_words"), covered.alias("n_hit"),
        F.array_sort("_hits.items").alias("items"), F.col("_hits.spans").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", set_words: int = SET_WORDS) -> DataFrame:
    """The rows of ``docs`` without a window of a test item, with all their columns."""
    (held,) = fresh(docs, "_hits")
    marked = docs.withColumn(held, hits(F.col(text_col), test_sets(benchmark, window, set_words)))
    return marked.where(F.size(F.col(held)["spans"]) == 0).drop(held)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", set_words: int = SET_WORDS) -> DataFrame:
    """All rows of ``docs``, hit words and what stands between them cut from the text."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist()):
            if text and found:
                places = [m.span() for m in _WORD.finditer(text)]
                ends = [0, *(places[s["end"] - 1][1] for s in found)]
                starts = [*(places[s["start"]][0] for s in found), len(text)]
                text = b"".join(text[a:b] for a, b in zip(ends, starts))
            out.append(text)
        return pa.array(out, pa.binary()).cast(pa.string())

    (held,) = fresh(docs, "_hits")
    marked = docs.withColumn(held, hits(F.col(text_col), test_sets(benchmark, window, set_words)))
    return marked.withColumn(text_col, cut(F.col(text_col), F.col(held)["spans"])).drop(held)
