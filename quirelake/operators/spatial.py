"""Boxes against words, and the extent of page content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.operators.layout import PAGE

# Side of a grid cell in points; a box over more than WIDE_CELLS cells meets the
# words of its page through the page-wide cell instead of being cut up.
CELL = 256.0
WIDE_CELLS = 256

# A channel at or under this is content; margin around content.
WHITE_LIMIT = 245
BBOX_MARGIN = 10


def _range(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def _cells(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Grid cells a box touches."""
    return F.flatten(
        F.transform(
            _range(x, x + width),
            lambda cx: F.transform(_range(y, y + height), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))),
        )
    )


def words_in_box(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words strictly overlapping a box of their page, with the ``box_id``.

    Words and boxes meet on (document, page, grid cell), so a crowded page is
    spread over its cells. A pair sharing several cells is kept only in the cell
    holding the corner where the overlap begins, so nothing needs deduplicating.
    Boxes wider than ``WIDE_CELLS`` cells meet words in one extra page-wide cell.
    """
    nowhere = F.struct(F.lit(None).cast("bigint").alias("cx"), F.lit(None).cast("bigint").alias("cy"))
    page_wide = F.array(nowhere)
    bx, by, bw, bh = (F.col(c) for c in ("bx", "by", "bw", "bh"))
    across = F.floor((bx + bw) / CELL) - F.floor(bx / CELL) + 1
    down = F.floor((by + bh) / CELL) - F.floor(by / CELL) + 1
    placed_boxes = (
        boxes.select(
            *PAGE, "box_id", F.col("x").alias("bx"), F.col("y").alias("by"),
            F.col("width").alias("bw"), F.col("height").alias("bh"),
        )
        .withColumn("_cell", F.explode(F.when(across * down > WIDE_CELLS, page_wide).otherwise(_cells(bx, by, bw, bh))))
        .withColumns({"_cx": F.coalesce("_cell.cx", F.lit(-(2**62))), "_cy": F.coalesce("_cell.cy", F.lit(-(2**62)))})
        .drop("_cell")
    )
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    placed_words = (
        words.withColumn("_cell", F.explode(F.concat(page_wide, _cells(x, y, w, h))))
        .withColumns({"_cx": F.coalesce("_cell.cx", F.lit(-(2**62))), "_cy": F.coalesce("_cell.cy", F.lit(-(2**62)))})
        .drop("_cell")
    )
    overlap = (bx < x + w) & (bx + bw > x) & (by < y + h) & (by + bh > y)
    here = (F.floor(F.greatest(bx, x) / CELL) == F.col("_cx")) & (F.floor(F.greatest(by, y) / CELL) == F.col("_cy"))
    wide = F.col("_cx") == -(2**62)
    return (
        placed_words.join(placed_boxes, [*PAGE, "_cx", "_cy"])
        .filter(overlap & (wide | here))
        .drop("_cx", "_cy", "bx", "by", "bw", "bh")
    )


def _covered(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Keys of words under some box, each once however many boxes cover it."""
    return words_in_box(words, boxes).select(*PAGE, "word_no").distinct()


def redact(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words that no box of their page overlaps."""
    return words.join(_covered(words, boxes), [*PAGE, "word_no"], "left_anti")


def redaction_audit(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """The words :func:`redact` removes."""
    return words.join(_covered(words, boxes), [*PAGE, "word_no"], "left_semi")


def highlights_from_selection(selected: DataFrame, color: str = "#FFFF00") -> DataFrame:
    """One Highlight mark per selected word, in the annotation schema."""
    return selected.select(
        *PAGE, F.lit("Highlight").alias("kind"), "x", "y", "width", "height",
        F.lit(color).alias("color"), F.lit(None).cast("double").alias("thickness"),
        F.lit(None).cast("boolean").alias("fill"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("int").alias("font_size"),
    )


def boxes_by_page(file_boxes: DataFrame, ids_per_part: int = 1 << 20) -> DataFrame:
    """Lists of redaction rectangles per page, in id order.

    ``file_boxes`` is in file space. A part covers ``ids_per_part`` consecutive
    ids, which bounds the list in one cell.
    """
    rect = F.struct(
        "ann_id", F.col("x").alias("x0"), F.col("y").alias("y0"),
        (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"),
    )
    return (
        file_boxes.groupBy(*PAGE, F.floor(F.col("ann_id") / ids_per_part).alias("part"))
        .agg(F.array_sort(F.collect_list(rect)).alias("boxes"))
    )


def content_bbox(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Extent of non-white pixels per page, grown by a margin and clamped.

    A blank page has no row. Minima and maxima combine before the shuffle.
    """
    ink = (F.col("r") <= WHITE_LIMIT) | (F.col("g") <= WHITE_LIMIT) | (F.col("b") <= WHITE_LIMIT)
    return (
        pixels.filter(ink)
        .groupBy("page_id")
        .agg(F.min("px").alias("l"), F.min("py").alias("t"), F.max("px").alias("r"), F.max("py").alias("b"))
        .select(
            "page_id",
            F.greatest(F.col("l") - BBOX_MARGIN, F.lit(0)).alias("min_x"),
            F.greatest(F.col("t") - BBOX_MARGIN, F.lit(0)).alias("min_y"),
            F.least(F.col("r") + BBOX_MARGIN, F.lit(width - 1)).alias("max_x"),
            F.least(F.col("b") + BBOX_MARGIN, F.lit(height - 1)).alias("max_y"),
        )
    )
