"""Spelling variants: words one edit apart, found by scanning sorted lists of words."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.session import settle

#: One in so many runs loses a letter (see ``counted_words``).
TYPO = 97
#: Code points of the shortest word, and how often a word must occur.
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Words of one sorted list; longer lists are cut at a finer segment.
LIST = 512
#: Distinct words a worker counts before it hands them on.
HELD = 400_000

_RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def counted_words(docs: DataFrame, typo: int = TYPO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: all words of the corpus with their occurrences.

    Each worker counts words before any are shuffled and hands them on when it holds
    ``HELD`` distinct ones, so its memory is bounded whatever the texts.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                found = Counter(_RUN.findall((text.as_py() or "").encode().translate(_LOWER).decode()))
                start = zlib.crc32((key.as_py() + ":").encode())
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % typo == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    held[run] += n
                if len(held) >= HELD:
                    yield handed()
        if held:
            yield handed()

    picked = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _listed(words: DataFrame) -> DataFrame:
    """Every word in the lists of its two classes, cut at the middle.

    Class ``size`` holds words of ``size`` and ``size + 1`` code points: any two words
    an edit apart are in one class together. A list is a class with a segment ``[a, b)``:
    its words agree in all but the segment, to which the longer ones add a code point.
    """
    size = F.char_length("word")
    halves = F.array(F.struct(F.lit(0).alias("a"), F.floor(F.col("size") / 2).cast("int").alias("b")), F.struct(F.floor(F.col("size") / 2).cast("int").alias("a"), F.col("size").alias("b")))
    return (
        words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).where(F.col("size") >= 1)
        .select("word", "n", "size", F.inline(halves))
    )


def _list_key() -> list[Column]:
    """A list's name: class, segment and what its words agree in."""
    after = F.col("size") - F.col("b")
    return [
        F.col("size"), F.col("a"), F.col("b"),
        F.substring(F.col("word"), F.lit(1), F.col("a")).alias("head"),
        F.substring(F.col("word"), F.char_length("word") - after + 1, after).alias("tail"),
    ]


def word_lists(words: DataFrame, most: int = LIST) -> DataFrame:
    """``size, a, b, head, tail, word, n``: lists in which all words an edit apart meet.

    A list of over ``most`` words is cut into two of half its segment, with more to
    agree in, again and again. At segments of a single code point a list holds no more
    words than the alphabet gives, whatever share of all words it came from. Lists of
    one word, or of the longer words alone, have no pairs and are left out.
    """
    open_, done = _listed(words), None
    while True:
        keyed = open_.select("word", "n", *_list_key())
        sizes = keyed.groupBy("size", "a", "b", "head", "tail").agg(F.count("*").alias("held"), F.min(F.char_length("word")).alias("least")).where("held > 1 AND least = size").drop("least")
        sizes = settle(sizes, "spelling-lists")
        names = ["size", "a", "b", "head", "tail"]
        large = (F.col("held") > most) & (F.col("b") - F.col("a") > 1)
        met = keyed.join(sizes.withColumn("large", large).drop("held"), names)
        fits = met.where("NOT large").drop("large")
        done = fits if done is None else done.unionByName(fits)
        if sizes.where(large).isEmpty():
            return done
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        parts = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
        open_ = settle(met.where("large").select("word", "n", "size", F.inline(parts)), "spelling-large")


def near_in_list(middles: Sequence[str], size: int, last: bool) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted list of ``middles`` that are one edit apart.

    ``size`` is the shorter length; of longer ones, two never make a pair here. Each
    word meets the words after it in one scan. The rows of its edit matrix, banded to
    one edit, stand on a stack by depth: the next word shares as many of them as it
    shares letters with the one before. Where a row has no value of at most 1 left, all
    words that share this prefix are skipped. A pair whose first difference lies behind
    the segment belongs to another list, except in the last segment.
    """
    total = len(middles)
    shared = [0] * (total + 1)
    for k in range(1, total):
        a, b = middles[k - 1], middles[k]
        top, d = min(len(a), len(b)), 0
        while d < top and a[d] == b[d]:
            d += 1
        shared[k] = d
    for k in range(total - 1):
        query = middles[k]
        long = len(query)
        # rows[d]: distances of a prefix of d letters to the query's of d-1, d, d+1 letters.
        rows = [(2, 0, 1), *[(1, 0, 1)] * shared[k + 1]]
        with_query = depth = shared[k + 1]
        j = k + 1
        while j < total:
            word = middles[j]
            if j > k + 1:
                depth = min(depth, shared[j])
                with_query = min(with_query, shared[j])
                del rows[depth + 1 :]
            skip = 0
            while depth < len(word):
                left, same, right = rows[-1]
                letter = word[depth]
                depth += 1
                # The letter stands against the query's letters depth-1, depth and depth+1.
                low = min(left + (depth < 2 or depth - 2 >= long or query[depth - 2] != letter), same + 1) if depth - 1 <= long else 2
                mid = min(same + (query[depth - 1] != letter), right + 1, low + 1) if depth <= long else 2
                high = min(right + (query[depth] != letter), mid + 1) if depth < long else 2
                if low > 1 and mid > 1 and high > 1:
                    rows.append((2, 2, 2))
                    skip = depth
                    break
                rows.append((low, mid, high))
            if skip:
                # On to the first word that does not share the hopeless prefix.
                j += 1
                near_by = min(total, j + 16)
                while j < near_by and shared[j] >= skip:
                    j += 1
                if j == near_by and j < total and shared[j] >= skip:
                    j = bisect_left(middles, word[:skip] + "\U0010ffff", j, total)
                continue
            gap = len(word) - long
            if -1 <= gap <= 1 and rows[-1][1 - gap] <= 1 and (len(word) == size or long == size):
                if last or with_query < size:
                    yield k, j
            j += 1


def near_words(lists: DataFrame) -> DataFrame:
    """``word, near, form_n, form``: per list and word, its near words and the best of them.

    Lists are sorted by Spark and scanned as they stream by; a worker holds one list.
    Of the near words only their number and the one of largest ``n`` (of equals, the
    smallest word) leave the list.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        for (size, a, b, *_), group in groupby(rows(), key=itemgetter(0, 1, 2, 3, 4)):
            *_, middles, words, counts = zip(*group)
            near: dict[int, list] = {}
            for x, y in near_in_list(middles, b - a, b == size):
                for mine, other in ((x, y), (y, x)):
                    word, n = words[other], counts[other]
                    held = near.setdefault(mine, [0, -1, ""])
                    held[0] += 1
                    if n > held[1] or n == held[1] and word < held[2]:
                        held[1:] = n, word
            out.extend((words[k], *held) for k, held in near.items())
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["word", "near", "form_n", "form"])

    names = ["size", "a", "b", "head", "tail"]
    middle = F.substring(F.col("word"), F.col("a") + 1, F.char_length("word") - F.col("size") + F.col("b") - F.col("a")).alias("middle")
    dealt = lists.select(*names, middle, "word", "n").repartition(*names).sortWithinPartitions(*names, "middle")
    return dealt.mapInArrow(of, "word string, near long, form_n long, form string")


def variants(words: DataFrame, most: int = LIST) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every row of ``words (word, n)``; see ``spelling_groups``."""
    found = near_words(word_lists(words, most)).groupBy("word").agg(
        F.sum("near").alias("n_near"),
        F.min_by(F.struct("form", "form_n"), F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"),
    ).withColumnRenamed("word", "of")
    form = F.when(F.col("best.form_n") >= 2 * F.col("n"), F.col("best"))
    return words.join(found, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form["form"].alias("form"), form["form_n"].alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all rows of ``forms (word, form)``, by pointer doubling.

    Every round a word points twice as far; as counts at least double from a word to
    its form, chains are short. Rounds are written to the shared folder.
    """
    at = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("of"), F.col("root").alias("next"))
        moved = settle(
            at.join(further, F.col("root") == F.col("of"), "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots")
        if moved.where("moved").isEmpty():
            return at
        at = moved.drop("moved")


def spelling_groups(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, typo: int = TYPO, most: int = LIST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: all words of the corpus with their variants.

    Runs are maximal ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z in lower case. Where
    ``typo`` divides the crc32 of ``<id>:<run>``, the run's code point at the crc32
    modulo its length is left out. Words are distinct results of at least ``least_chars``
    code points that occur ``least_count`` times. Words are near if they differ by one
    inserted, deleted or replaced code point. ``form`` is the near word of largest ``n``
    (of equals, the smallest), if that is at least twice the word's, else null; ``root``
    is where following forms ends, the word itself if it has none.

    Null, empty and wordless texts have no words. A null id counts as an empty one.
    Repeated rows count as often as they occur. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    counted = counted_words(docs, typo, id_col, text_col)
    words = settle(counted.where((F.char_length("word") >= least_chars) & (F.col("n") >= least_count)), "spelling-words")
    found = settle(variants(words, most), "spelling-variants")
    ends = roots(found.where("form IS NOT NULL")).select(F.col("word").alias("of"), F.col("root").alias("end"))
    return found.join(ends, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
