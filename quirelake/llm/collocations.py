"""Phrases whose words go together, counted in depth-truncated suffix trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.bitmaps import bitmap, held_in
from quirelake.session import settle

#: Words of the longest phrase, and occurrences that make a candidate.
DEPTH, SUPPORT = 5, 100
#: Phrases reported for each language.
TOP = 2000
#: Suffixes that the prefixes of one group may have together.
BUDGET = 1 << 20
#: Bits of a filter of frequent words or pairs: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Counters that prefixes of three words and more share: one byte each in a worker, one bit when sent back.
SLOTS = 1 << 24
#: Prefixes are counted and dealt to groups by this many cells.
CELLS = 1 << 16
#: Words handled at once, distinct words a worker remembers, bytes of a text split at once.
CHUNK, REMEMBERED, PART = 1 << 21, 500_000, 1 << 23
#: Distinct leaves a worker adds up before it gives them out.
HELD = 1 << 17
#: Parts a language's candidates are ranked in before they meet.
RANKED = 64

# A-Z in lower case, marks that end a piece as a byte no text has, tab as space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10 + b" ")
_END = b"\xff"
#: A group's number is below this; the level of its prefixes is counted above it.
_LEVEL = 1 << 24
#: Counters of one row.
_RUN = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _joined(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(head * np.uint64(0xFF51AFD7ED558CCD) + word)


def hashed(data: bytes, seed: int) -> int:
    """A hash of 64 bits. Words that share one have different ones with another seed."""
    return int.from_bytes(blake2b(data, digest_size=8, key=str(seed).encode()).digest(), "big") if seed else xxhash.xxh64_intdigest(data)


def split_words(text: str | None, depth: int = DEPTH, part: int = PART) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text with ``b"\\xff"`` where a piece ends, and how many of them start phrases.

    A very long text comes in parts; the last words of a part come again at the head of
    the next one, where they start phrases. In words, the bytes 0 and 1 are written as
    two, so that 0 can stand between the words of a phrase and phrases of equal
    first words are neighbours when sorted.
    """
    raw = (text or "").encode().translate(_FOLD)
    if b"\x00" in raw or b"\x01" in raw:
        raw = raw.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    raw = raw.replace(_END, b" \xff ")
    carried, at = [], 0
    while True:
        cut = raw.find(b" ", at + part)
        words = carried + raw[at : cut if cut >= 0 else len(raw)].split()
        if cut < 0:
            words.append(_END)
            yield words, len(words)
            return
        own = max(0, len(words) - depth + 1)
        yield words, own
        carried, at = words[own:], cut


def readable(phrase: str) -> str:
    """A phrase or word as it stands in texts, its words joined by spaces."""
    phrase = phrase.replace("\x00", " ")
    return phrase.replace("\x01\x01", "\x00").replace("\x01\x02", "\x01") if "\x01" in phrase else phrase


class Chunk:
    """Words of some texts by number, 0 where a piece ends, with the language of each.

    ``starts`` is false for words that only follow others here.
    """

    def __init__(self, words: list[bytes], names: list[str], ids: list[np.ndarray], langs: list[int], owned: list[int]):
        sizes = np.array([len(i) for i in ids])
        self.words, self.names, self.ids = words, names, np.concatenate(ids)
        self.langs = np.repeat(np.array(langs), sizes)
        within = np.arange(len(self.ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.starts = within < np.repeat(np.array(owned), sizes)

    def hashes(self, digest: Callable[[bytes], int]) -> np.ndarray:
        """A hash of language and word for every place."""
        word = np.fromiter(map(digest, self.words), np.uint64, len(self.words))
        lang = np.fromiter((digest(_END + n.encode()) for n in self.names), np.uint64, len(self.names))
        return _joined(lang[self.langs], word[self.ids])


def _chunks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[Chunk]:
    known, names = {_END: 0}, {}
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            for words, own in split_words(text.as_py(), depth):
                held[0].append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                held[1].append(names.setdefault(lang.as_py(), len(names)))
                held[2].append(own)
                size += len(words)
                if size >= CHUNK:
                    yield Chunk(list(known), list(names), *held)
                    held, size = ([], [], []), 0
                    if len(known) > REMEMBERED:
                        known, names = {_END: 0}, {}
    if size:
        yield Chunk(list(known), list(names), *held)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(texts: DataFrame, digest: Callable[[bytes], int], depth: int = DEPTH) -> DataFrame:
    """``lang, word, h, n``: occurrences of all words, counted in each worker first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, depth):
            place = np.flatnonzero(chunk.starts & (chunk.ids > 0))
            keys, first, counts = np.unique(chunk.langs[place] << 32 | chunk.ids[place], return_index=True, return_counts=True)
            words = [readable(chunk.words[k].decode()) for k in (keys & 0xFFFFFFFF).tolist()]
            langs = pa.array(chunk.names, pa.string()).take(pa.array(keys >> 32))
            yield pa.RecordBatch.from_arrays(
                [langs, pa.array(words, pa.string()), pa.array(chunk.hashes(digest)[place[first]].view(np.int64)), pa.array(counts)], names=["lang", "word", "h", "n"])

    return texts.mapInArrow(of, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class Kept:
    """What may be part of a frequent phrase: words, pairs and prefixes of three words and more, as bitmaps."""

    digest: Callable[[bytes], int]
    bits: int
    slots: int
    words: Broadcast
    pairs: Broadcast | None = None
    longer: Broadcast | None = None


def pair_counts(texts: DataFrame, kept: Kept, depth: int = DEPTH) -> DataFrame:
    """``first, second, n``: pairs of words of the filter by the words' hashes, and how often they occur."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, depth):
            hashes = chunk.hashes(kept.digest)
            often = (chunk.ids > 0) & held_in(kept.words.value, hashes, kept.bits)
            at = np.flatnonzero(often[:-1] & often[1:] & chunk.starts[:-1])
            code = np.unique(chunk.langs[at] << 32 | chunk.ids[at], return_inverse=True)[1]
            _, found, counts = np.unique(code << 32 | chunk.ids[at + 1], return_index=True, return_counts=True)
            first = at[found]
            columns = [pa.array(hashes[first].view(np.int64)), pa.array(hashes[first + 1].view(np.int64)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["first", "second", "n"])

    return texts.mapInArrow(of, "first long, second long, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))


def pair_hashes(pairs: DataFrame) -> DataFrame:
    """``h, n``: a hash for each pair."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_joined(first, second).view(np.int64)), batch.column(2)], names=["h", "n"])

    return pairs.select("first", "second", "n").mapInArrow(of, "h long, n long")


class Suffixes:
    """Suffixes of a chunk that start with a frequent pair, cut where a pair or a longer prefix is not frequent.

    Once longer prefixes are known, suffixes that are pairs only are left out.
    """

    def __init__(self, chunk: Chunk, kept: Kept, depth: int):
        hashes = chunk.hashes(kept.digest)
        often = (chunk.ids > 0) & held_in(kept.words.value, hashes, kept.bits)
        both = np.append(often[:-1] & often[1:], False)
        at = np.flatnonzero(both)
        both[at] = held_in(kept.pairs.value, _joined(hashes[at], hashes[at + 1]), kept.bits)
        both = np.append(both, False)
        # Two frequent pairs in a row at least: a pair by itself is counted already.
        self.at = np.flatnonzero(both[:-1] & both[1:] & chunk.starts)
        self.depth = np.full(len(self.at), 2)
        #: Hashes of the prefixes of two words and more; of a shorter suffix, those of all it has.
        self.prefixes = [_joined(hashes[self.at], hashes[self.at + 1])]
        more = np.ones(len(self.at), bool)
        for level in range(2, depth):
            step = np.minimum(self.at + level - 1, len(hashes) - 1)
            more &= both[step]
            prefix = _joined(self.prefixes[-1], hashes[np.minimum(step + 1, len(hashes) - 1)])
            if kept.longer:
                more[more] = held_in(kept.longer.value, prefix[more], kept.slots)
            self.depth += more
            self.prefixes.append(np.where(more, prefix, self.prefixes[-1]))
        long = self.depth > 2
        self.at, self.depth, self.prefixes = self.at[long], self.depth[long], [p[long] for p in self.prefixes]


def longer_prefixes(texts: DataFrame, kept: Kept, depth: int = DEPTH, support: int = SUPPORT) -> np.ndarray:
    """A bitmap of the prefixes of three words and more that may be frequent.

    Each worker counts in ``slots`` counters, whatever the corpus, and the counters are
    added up run by run. Prefixes that share one are counted together, so none that is
    frequent is missed. A counter stops at 255, and there it counts as frequent.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(kept.slots, np.uint8)
        for chunk in _chunks(batches, depth):
            found = Suffixes(chunk, kept, depth)
            for level in range(2, depth):
                slot, n = np.unique(found.prefixes[level - 1][found.depth > level] & np.uint64(kept.slots - 1), return_counts=True)
                counts[slot] = np.minimum(counts[slot] + n, 255)
        for run in range(-(-kept.slots // _RUN)):
            own = counts[run * _RUN :][:_RUN]
            place = np.flatnonzero(own)
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([place.astype(np.uint16).tobytes()]), pa.array([own[place].tobytes()])], names=["run", "place", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(sums >= min(support, 255), bitorder="little").tobytes()])], names=["run", "bits"])

        at, sums = -1, np.zeros(_RUN, np.int64)
        for batch in batches:
            for run, place, n in zip(*(c.to_pylist() for c in batch.columns)):
                if run != at:
                    if at >= 0:
                        yield often()
                    at, sums = run, np.zeros(_RUN, np.int64)
                sums[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.uint8)
        if at >= 0:
            yield often()

    counted = texts.mapInArrow(of, "run long, place binary, n binary").repartition("run").sortWithinPartitions("run")
    out = np.zeros(max(kept.slots, _RUN) // 8, np.uint8)
    for run, found in counted.mapInArrow(added, "run long, bits binary").collect():
        out[run * (_RUN // 8) :][: _RUN // 8] = np.frombuffer(found, np.uint8)
    return out


def prefix_groups(texts: DataFrame, kept: Kept, pair_cells: list, depth: int = DEPTH, budget: int = BUDGET) -> list[np.ndarray]:
    """Vertical partitioning: the group of every cell of prefixes, by number of words from two.

    Cells of prefixes fill groups up to ``budget`` suffixes. Those of a cell over the
    budget are counted again with one more word, and so on; -1 says to look there. What
    the driver sees are sums of ``CELLS`` cells a level, whatever the corpus.
    """
    tables, group, cells = [], 0, pair_cells
    for level in range(2, depth + 1):
        sums = np.zeros(CELLS, np.int64)
        for cell, n in cells:
            sums[cell] = n
        table, filled = np.zeros(CELLS, np.int64), 0
        large = (sums > budget) & (level < depth)
        for cell in np.flatnonzero(~large & (sums > 0)).tolist():
            if filled and filled + sums[cell] > budget:
                group, filled = group + 1, 0
            table[cell], filled = level * _LEVEL + group, filled + sums[cell]
        table[large] = -1
        tables.append(table)
        group += 1
        if not large.any():
            break

        def of(batches: Iterator[pa.RecordBatch], level: int = level, known: tuple = tuple(tables)) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches, depth):
                found = Suffixes(chunk, kept, depth)
                longer = found.depth > level
                for k, table in enumerate(known):
                    longer &= table[_cell(found.prefixes[k])] < 0
                counts = np.bincount(_cell(found.prefixes[level - 1][longer]), minlength=CELLS)
                cell = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], names=["cell", "n"])

        cells = texts.mapInArrow(of, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return tables


def leaf_totals(texts: DataFrame, kept: Kept, tables: list[np.ndarray], depth: int = DEPTH) -> DataFrame:
    """``grp, lang, leaf, n``: truncated suffixes, equal ones added up in each worker first, with their group."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, str, str], int] = {}

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*totals), kinds)), pa.array(totals.values(), pa.int64())], names=["grp", "lang", "leaf", "n"])

        for chunk in _chunks(batches, depth):
            found = Suffixes(chunk, kept, depth)
            # Numbers of equal prefixes, word by word; exact, as each level's numbers are dense.
            code = np.unique(chunk.langs[found.at] << 32 | chunk.ids[found.at], return_inverse=True)[1]
            for level in range(1, depth):
                step = np.minimum(found.at + level, len(chunk.ids) - 1)
                code = np.unique(code << 32 | np.where(found.depth > level, chunk.ids[step], 0), return_inverse=True)[1]
            _, first, counts = np.unique(code, return_index=True, return_counts=True)
            # Groups: a prefix in a cell over the budget is looked up with one more word; a suffix that ends there stays, a level up.
            group = np.full(len(first), -1)
            for k, table in enumerate(tables):
                open_ = group < 0
                here = table[_cell(found.prefixes[k][first])]
                ends = (here < 0) & (found.depth[first] == k + 2)
                group = np.where(open_, np.where(ends, (k + 3) * _LEVEL, here), group)
            leaves = [
                b"\x00".join([chunk.words[i] for i in chunk.ids[at : at + length].tolist()]).decode()
                for at, length in zip(found.at[first].tolist(), found.depth[first].tolist())
            ]
            langs = [chunk.names[i] for i in chunk.langs[found.at[first]].tolist()]
            for leaf, n in zip(zip(group.tolist(), langs, leaves), counts.tolist()):
                totals[leaf] = totals.get(leaf, 0) + n
            if len(totals) >= HELD:
                yield batch_of()
                totals.clear()
        if totals:
            yield batch_of()

    return texts.mapInArrow(of, "grp long, lang string, leaf string, n long").groupBy("grp", "lang", "leaf").agg(F.sum("n").alias("n"))


def subtrees(leaves: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``lang, phrase, words, n``: nodes of three words and more that occur ``support`` times.

    Each group's leaves come sorted, so its trees are built along the path of the leaf at
    hand: a node closes when a leaf leaves it, with the sum of its leaves. Nodes above a
    group's prefixes are parts, which are added up.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        path: list[str] = []
        sums: list[int] = []
        tree = None

        def close(depth: int) -> None:
            while len(path) > depth:
                n = sums.pop()
                if len(path) > 2 and (n >= support or len(path) < tree[0] // _LEVEL):
                    out.append((tree[1], readable("\x00".join(path)), len(path), n))
                path.pop()
                if sums:
                    sums[-1] += n

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["lang", "phrase", "words", "n"])

        for batch in batches:
            for grp, lang, leaf, n in zip(*(c.to_pylist() for c in batch.columns)):
                words = leaf.split("\x00")
                same = 0
                if tree == (grp, lang):
                    while same < min(len(path), len(words)) and path[same] == words[same]:
                        same += 1
                close(same)
                tree = (grp, lang)
                path.extend(words[same:])
                sums.extend([0] * (len(words) - same))
                sums[-1] += n
            if len(out) >= 10_000:
                yield batch_of()
                out.clear()
        if tree:
            close(0)
        if out:
            yield batch_of()

    dealt = leaves.repartition("grp").sortWithinPartitions("grp", "lang", "leaf")
    nodes = dealt.mapInArrow(of, "lang string, phrase string, words int, n long")
    return nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= support)


def frequent_phrases(docs: DataFrame, depth: int = DEPTH, support: int = SUPPORT, budget: int = BUDGET, bits: int = FILTER_BITS,
                     lang_col: str = "lang", text_col: str = "text", slots: int = SLOTS, digest: Callable[[bytes, int], int] = hashed) -> tuple[DataFrame, DataFrame]:
    """``(words, phrases)``: ``lang, word, n`` of all words, and ``lang, phrase, words, n``
    of the phrases of two to ``depth`` words that occur at least ``support`` times.

    Prefixes of one word that are too rare drop out, then those of two, which are counted
    by the hashes of their words, then longer ones; the others are dealt to groups by a
    budget, and each group's suffix trees are built by themselves. What prunes are filters
    of a fixed size. A word or prefix that passes by sharing a bit or counter costs time,
    but all counts are of the words themselves: if two words of the corpus share a hash,
    another seed is taken.
    """
    texts = _texts(docs, lang_col, text_col)
    send = texts.sparkSession.sparkContext.broadcast
    for seed in count():
        own = partial(digest, seed=seed)
        words = settle(word_counts(texts, own, depth), "collocation-words")
        if words.groupBy("h").agg(F.count("*").alias("words")).where("words > 1").isEmpty():
            break
    often = words.where(F.col("n") >= support)
    kept = Kept(own, bits, slots, send(bitmap(often, bits)))
    pairs = settle(pair_counts(texts, kept, depth).where(F.col("n") >= support), "collocation-prefixes")
    prefixes = pair_hashes(pairs)
    kept = replace(kept, pairs=send(bitmap(prefixes, bits)))
    kept = replace(kept, longer=send(longer_prefixes(texts, kept, depth, support)))
    cells = prefixes.groupBy(F.shiftrightunsigned("h", 48).alias("cell")).agg(F.sum("n").alias("n")).collect()
    tables = prefix_groups(texts, kept, cells, depth, budget)
    first, second = (often.select(F.col("h").alias(k), F.col("word").alias(f"{k}_word"), *extra) for k, extra in (("first", ["lang"]), ("second", [])))
    named = pairs.join(first, "first").join(second, "second").select("lang", F.concat_ws(" ", "first_word", "second_word").alias("phrase"), F.lit(2).alias("words"), "n")
    phrases = settle(named.unionByName(subtrees(leaf_totals(texts, kept, tables, depth), support)), "collocation-phrases")
    return words.drop("h"), phrases


def scored(words: DataFrame, phrases: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases that no longer one stands for."""
    counts = words.where(F.col("n") >= support).select("lang", F.col("word").alias("phrase"), "n").unionByName(phrases.select("lang", "phrase", "n"))
    listed = F.split("phrase", " ")
    # A phrase in a longer one of equal count is, word by word, in one that is a word longer.
    longer = phrases.where("words > 2").select(
        "lang", "n", F.explode(F.array(F.array_join(F.slice(listed, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(listed, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    own = phrases.join(held, ["lang", "phrase"], "left").where("within IS NULL OR within < n").select("lang", "phrase", F.col("n").alias("a"), "words")
    cuts = own.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(listed, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(listed, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rated = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(1000 * CAST(a AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    lowest = rated.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, depth: int = DEPTH, support: int = SUPPORT, budget: int = BUDGET, bits: int = FILTER_BITS,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Texts, A-Z in lower case, split at ``. , ; : ! ?`` and line breaks into pieces and
    those at spaces and tabs into words. A candidate has two to ``depth`` words
    and occurs ``a`` (at least ``support``) times in pieces of its language, overlaps
    included. Of its cuts in two with ``l`` and ``r`` occurrences the one of lowest score
    ``floor(1000 a n / (l r))`` counts, of equals the first; ``n`` is the words of the
    language. Candidates inside a longer one that occurs as often are left out. Ranks
    go by score, then ``a``, both descending, then the phrase in byte order.

    A null language is ``und``; null, empty and wordless texts have no words; repeated
    rows count as often as they occur. An empty table gives no rows; other columns are
    not read, whatever their names.
    """
    words, phrases = frequent_phrases(docs, depth, support, budget, bits, lang_col, text_col)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked in parts first: a language may have most of the candidates.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    best = scored(words, phrases, support).withColumn("at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("at") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
