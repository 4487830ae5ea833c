"""Annotations: reading, filtering, marking and saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.color import format_color
from quirelake.functions.geometry import DEFAULT_PAGE_HEIGHT, flip_y
from quirelake.operators.layout import PAGE

# Defaults of annotations read from files.
DEFAULT_COLOR = "#408cff"
DEFAULT_THICKNESS = 2.0
DEFAULT_FONT_SIZE = 12
SUBTYPES = {
    "Highlight": "Highlight",
    "Square": "Rectangle",
    "Circle": "Circle",
    "FreeText": "Text",
    "Text": "StickyNote",
    "Line": "Line",
}
# Box of a note or text mark.
NOTE_WIDTH = 120.0
NOTE_HEIGHT = 24.0


def user_annotations(raw: DataFrame) -> DataFrame:
    """Annotations of files in the flat table form, in screen space.

    ``raw`` has ann_id, doc_id, page, subtype, rect (x0, y0, x1, y1), color
    (r, g, b in 0..1), has_fill, thickness, contents, endings, page_height. Links,
    unknown subtypes and rows without a four-number rect are dropped.
    """
    kind = None
    for subtype, name in SUBTYPES.items():
        when = F.when if kind is None else kind.when
        kind = when(F.col("subtype") == subtype, F.lit(name))
    arrow = F.coalesce(F.exists("endings", lambda e: e.contains("Arrow")), F.lit(False))
    rect = F.col("rect")
    height = F.abs(rect[3] - rect[1])
    color = F.when(F.size("color") == 3, format_color(F.col("color")[0], F.col("color")[1], F.col("color")[2]))
    shape = F.col("kind").isin("Rectangle", "Circle")
    drawn = F.col("kind").isin("Rectangle", "Circle", "Line", "Arrow")
    note = F.col("kind").isin("Text", "StickyNote")
    return (
        raw.filter(F.col("subtype").isin(*SUBTYPES) & (F.size("rect") == 4))
        .withColumn("kind", F.when((F.col("subtype") == "Line") & arrow, F.lit("Arrow")).otherwise(kind))
        .select(
            "ann_id", *PAGE, "kind",
            rect[0].alias("x"),
            flip_y(rect[1], height, F.coalesce("page_height", F.lit(DEFAULT_PAGE_HEIGHT))).alias("y"),
            F.abs(rect[2] - rect[0]).alias("width"),
            height.alias("height"),
            F.coalesce(color, F.lit(DEFAULT_COLOR)).alias("color"),
            F.when(drawn, F.coalesce("thickness", F.lit(DEFAULT_THICKNESS))).alias("thickness"),
            F.when(shape, F.coalesce("has_fill", F.lit(False))).alias("fill"),
            F.when(note, F.coalesce("contents", F.lit(""))).alias("text"),
            F.when(F.col("kind") == "Text", F.lit(DEFAULT_FONT_SIZE)).alias("font_size"),
        )
    )


def without_redactions(annotations: DataFrame) -> DataFrame:
    return annotations.filter(F.col("kind") != "Redact")


def only_redactions(annotations: DataFrame) -> DataFrame:
    return annotations.filter(F.col("kind") == "Redact")


def marks_from_spec(specs: DataFrame) -> DataFrame:
    """Marks from drawn points: kind, start (x0, y0) and end (x1, y1).

    Boxes are normalised to their least corner; lines keep a signed extent;
    notes and text get a fixed box at the start point.
    """
    line = F.col("kind").isin("Line", "Arrow")
    note = F.col("kind").isin("Text", "StickyNote")

    def side(a: str, b: str, fixed: float) -> Column:
        return (
            F.when(line, F.col(b) - F.col(a)).when(note, F.lit(fixed)).otherwise(F.abs(F.col(b) - F.col(a)))
        )

    def corner(a: str, b: str) -> Column:
        return F.when(line | note, F.col(a)).otherwise(F.least(a, b))

    kept = [F.col(c) for c in specs.columns if c not in ("x0", "y0", "x1", "y1")]
    return specs.select(
        *kept,
        corner("x0", "x1").alias("x"),
        corner("y0", "y1").alias("y"),
        side("x0", "x1", NOTE_WIDTH).alias("width"),
        side("y0", "y1", NOTE_HEIGHT).alias("height"),
    )


def annotation_kinds(annotations: DataFrame) -> DataFrame:
    """Number of marks per page and kind."""
    return annotations.groupBy(*PAGE, "kind").agg(F.count("*").alias("marks"))


def to_file_space(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Flip y into file space; a page without a height counts as 792 high."""
    heights = pages.select(*PAGE, F.col("height").alias("_page_height"))
    joined = annotations.join(heights, list(PAGE), "left")
    flipped = flip_y(F.col("y"), F.col("height"), F.coalesce("_page_height", F.lit(DEFAULT_PAGE_HEIGHT)))
    return joined.withColumn("y", flipped).drop("_page_height")


def append_annotations(base: DataFrame, new: DataFrame) -> DataFrame:
    """Stored marks plus new ones; nothing stored is rewritten."""
    return base.unionByName(new, allowMissingColumns=True)


def first_bookmark(events: DataFrame) -> DataFrame:
    """A page keeps its earliest bookmark, labelled by page number."""
    return (
        events.groupBy(*PAGE)
        .agg(F.min("created_at").alias("created_at"))
        .withColumn("label", F.concat(F.lit("Page "), (F.col("page") + 1).cast("string")))
    )


def live_marks(edits: DataFrame) -> DataFrame:
    """Marks left after an edit log (doc_id, ann_id, seq, action), with their last ``seq``.

    The edit of the largest ``seq`` decides for each mark; after ``delete`` it is
    gone. Keyed by mark, so a document's log is shared out however long it is.
    """
    last = edits.groupBy("doc_id", "ann_id").agg(F.max(F.struct("seq", "action")).alias("_last"))
    return last.where("_last.action <> 'delete'").select("doc_id", "ann_id", F.col("_last.seq").alias("seq"))
