"""Best-fit packing of token sequences after Martello-Toth dominance reduction."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.numbering import gapless
from quirelake.llm.tokens import encoder
from quirelake.session import settle

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
#: Closes every document.
END_ID = 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and ``ids``: every document's tokens.

    A document is its token ids and the end id, whole if they fit ``capacity``, else
    cut into pieces of ``capacity`` and a rest.
    """
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[tuple[int, int, int, int, int]] = []
            held: list[bytes] = []
            for at, found in enumerate(known.encode([t or "" for t in texts])):
                ids = found + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        held.append(part)
            at, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            columns = [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start.copy()), pa.array(length.copy()), pa.array(crc.copy())]
            if with_ids:
                offsets = np.append(0, np.cumsum(length)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(held), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(of, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


class Placement(NamedTuple):
    """Pieces of ``length`` numbered from ``first`` go, one each, to ``count`` sequences from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


class Packer:
    """Packs a histogram of lengths; what it holds is bounded by the capacity, not by the pieces."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.first = dict.fromkeys(self.left, 0)
        self.sequence = 0
        self.placed: list[Placement] = []

    def _put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.placed.append(Placement(length, self.first[length], count, sequence, offset))
        self.first[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.sizes.pop(bisect_left(self.sizes, length))

    def _fix(self, members: list[int]) -> None:
        """Close as many sequences of exactly these lengths as there are pieces for."""
        need = Counter(members)
        count = min(self.left[length] // n for length, n in need.items())
        offset = 0
        for length in members:
            self._put(length, count, self.sequence, offset)
            offset += length
        self.sequence += count

    def _others(self, length: int, most: int) -> list[int]:
        """The ``most`` smallest pieces left beside one of ``length``."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(most, self.left[size] - (size == length))
            if len(out) >= most:
                break
        return out[:most]

    def _largest(self, free: int, without: Counter) -> int | None:
        """The largest piece of at most ``free`` beside those in ``without``."""
        at = bisect_right(self.sizes, free) - 1
        while at >= 0 and self.left[self.sizes[at]] <= without[self.sizes[at]]:
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def _dominant(self, length: int) -> list[int] | None:
        """A set around a piece of ``length`` at least as good as any other that holds one.

        The criterion looks at sets of up to three pieces: a set dominates if every
        other one can be exchanged for it, member by member, without a larger piece
        being pushed out than comes in.
        """
        free = self.capacity - length
        small = self._others(length, 3)
        if not small or small[0] > free:
            return [length]
        best = self._largest(free, Counter([length]))
        if best == free or len(small) < 2 or small[0] + small[1] > free:
            return [length, best]
        if len(small) == 3 and sum(small) <= free:
            return None
        a = b = None
        for size in self.sizes[: bisect_right(self.sizes, free)]:
            if self.left[size] > (size == length):
                mate = self._largest(min(size, free - size), Counter([length, size]))
                if mate is not None and (a is None or size + mate >= a + b):
                    a, b = size, mate
        if a is None or best >= a + b:
            return [length, best]
        above = [s for s in self.sizes[bisect_right(self.sizes, b) :][:3] for _ in range(min(2, self.left[s] - (s == length)))][:2]
        if a == best and (len(above) < 2 or sum(above) > free):
            return [length, a, b]
        return None

    def reduce(self) -> None:
        """Fix dominating sets, largest pieces first, until none is left."""
        changed = True
        while changed:
            changed = False
            for length in list(reversed(self.sizes)):
                while length in self.left and (members := self._dominant(length)):
                    self._fix(members)
                    changed = True

    def best_fit(self) -> None:
        """Pack what remains, largest first, each piece where it leaves least room."""
        rooms: list[int] = []
        at_room: dict[int, list[tuple[int, int]]] = {}

        def add(room: int, sequence: int, count: int) -> None:
            if room and count:
                if room not in at_room:
                    at_room[room] = []
                    insort(rooms, room)
                at_room[room].append((sequence, count))

        for length in list(reversed(self.sizes)):
            while length in self.left:
                want = self.left[length]
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    sequence, count = at_room[room].pop()
                    if not at_room[room]:
                        del at_room[room]
                        rooms.pop(at)
                    used = min(want, count)
                    self._put(length, used, sequence, self.capacity - room)
                    add(room, sequence + used, count - used)
                    add(room - length, sequence, used)
                    continue
                each = min(self.capacity // length, want)
                count = want // each
                for k in range(each):
                    self._put(length, count, self.sequence, k * length)
                add(self.capacity - each * length, self.sequence, count)
                self.sequence += count


def place(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Where the pieces of each length go, for a histogram of lengths up to ``capacity``."""
    packer = Packer(counts, capacity)
    packer.reduce()
    packer.best_fit()
    return packer.placed


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``.

    Only the histogram of piece lengths, at most ``capacity`` rows, is brought to the
    driver; the placements it gives are joined back to the pieces, which are numbered
    within their length. A null or empty text is one piece of the end id alone.
    Repeated rows and null ids are packed like any other; an empty table gives no
    rows; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, capacity, tokenizer, end_id, with_ids, id_col, text_col), "packing-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = place(counts, capacity)
    each = Counter(p.length for p in placed)
    # Ranks of a length are cut so that there are about as many stretches as placements.
    width = {length: max(1, n // each[length]) for length, n in counts.items()}
    rows = [(p.length, width[p.length], p.first, p.count, p.sequence, p.offset) for p in placed]
    plan = spark.createDataFrame(rows, "_length long, _width long, _first long, _count long, _sequence long, _offset long")
    plan = plan.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("_first") / F.col("_width")), F.floor((F.col("_first") + F.col("_count") - 1) / F.col("_width")))))
    widths = spark.createDataFrame(sorted(width.items()), "_of long, _cut long")
    numbered = gapless(cut.join(widths, F.col("length") == F.col("_of")).drop("_of"), "length", ["doc_id", "piece"], ["ids_crc32", "start"], "_rank")
    numbered = numbered.withColumn("_at", F.floor(F.col("_rank") / F.col("_cut")))
    met = numbered.join(plan, (F.col("length") == F.col("_length")) & (F.col("_at") == F.col("_stretch")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")))
    return met.select(*cut.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids`` of each packed sequence; at most ``capacity`` ids each."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("held")).select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"))
