"""Pages read column by column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.operators.layout import PAGE, group_lines, page_text
from quirelake.session import settle

#: Widths of the white space that parts columns, and the bands of a column, in points.
COLUMN_GAP, BAND_GAP = 40.0, 20.0


def _parts(block: np.ndarray, start: np.ndarray, size: np.ndarray, gap: float) -> list[np.ndarray]:
    """The boxes of a block, in parts that lie at least ``gap`` apart along an axis."""
    order = block[np.argsort(np.nan_to_num(start[block], nan=-np.inf), kind="stable")]
    reach = np.fmax.accumulate(start[order] + size[order])
    return np.split(order, np.flatnonzero(start[order][1:] - reach[:-1] >= gap) + 1)


def _cut(x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray, column_gap: float, band_gap: float) -> np.ndarray:
    """The region of each box of a page."""
    out = np.zeros(len(x), np.int32)
    waiting, region = [np.arange(len(x))], 0
    while waiting:
        block = waiting.pop()
        for start, size, gap in ((x, width, column_gap), (y, height, band_gap)):
            parts = _parts(block, start, size, gap)
            if len(parts) > 1:
                waiting += [np.sort(part) for part in reversed(parts)]
                break
        else:
            out[block] = region
            region += 1
    return out


def reading_regions(words: DataFrame, column_gap: float = COLUMN_GAP, band_gap: float = BAND_GAP) -> DataFrame:
    """Words with ``region``, the place of their block of text in the page's reading order.

    A recursive cut: where white space at least ``column_gap`` wide runs down a whole
    block, the block falls into columns, read from the left; else where white space
    ``band_gap`` high runs across it, into bands, read from the top. A page's words come
    out of one row, so they may meet in a task: they are shuffled and sorted once, and a
    task holds one page and a batch at a time.
    """

    def cut(pages: pa.Table, firsts: list[int]) -> pa.Table:
        boxes = [pages.column(c).cast(pa.float64()).to_numpy().astype(float) for c in ("x", "y", "width", "height")]
        found = [_cut(*(side[a:b] for side in boxes), column_gap, band_gap) for a, b in zip(firsts, [*firsts[1:], len(pages)])]
        return pages.append_column("region", pa.array(np.concatenate(found)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        firsts, size, last = [], 0, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in PAGE)))
            new = [k for k, key in enumerate(keys) if key != (keys[k - 1] if k else last)]
            if size and new:  # the last page may go on
                done = pa.Table.from_batches([*held, batch.slice(0, new[-1])])
                yield from cut(done, firsts + [size + k for k in new[:-1]]).to_batches()
                held, firsts, size = [batch.slice(new[-1])], [0], len(batch) - new[-1]
            else:
                held.append(batch)
                firsts += [size + k for k in new]
                size += len(batch)
            last = keys[-1] if keys else last
        if size:
            yield from cut(pa.Table.from_batches(held), firsts).to_batches()

    dealt = words.repartition(*PAGE).sortWithinPartitions(*PAGE, "word_no")
    return settle(dealt.mapInArrow(of, T.StructType([*words.schema, T.StructField("region", T.IntegerType())])), "regions")


def column_text(words: DataFrame, tol: float = 2.0, column_gap: float = COLUMN_GAP, band_gap: float = BAND_GAP) -> DataFrame:
    """Text of pages read region by region, line by line: ``doc_id, page, part, text``."""
    placed = reading_regions(words, column_gap, band_gap)
    lines = group_lines(placed.withColumn("page", F.struct("page", "region")), tol)
    order = Window.partitionBy(*PAGE).orderBy("region", "_line")
    numbered = lines.select("doc_id", F.col("page.page").alias("page"), F.col("page.region").alias("region"), F.col("line_no").alias("_line"), "text")
    return page_text(numbered.withColumn("line_no", F.row_number().over(order) - 1))
