"""Words, lines and reading order of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import trimmed, words_of

PAGE = ("doc_id", "page")

# The synthetic layout, in points.
TOP_MARGIN = 40.0
LINE_STEP = 18.0
LEFT_MARGIN = 50.0
WORD_STEP = 45.0
BYTE_WIDTH = 8.0
LINE_HEIGHT = 12.0

# Height of a band of y values in line grouping.
LINE_BAND = 16384.0

# Lines of one page text kept in one cell; longer pages continue in the next part.
LINES_PER_PART = 65536


def layout_words(pages: DataFrame) -> DataFrame:
    """One row per word with its box in screen space.

    Word ``j`` of line ``i`` sits at a place fixed by ``i`` and ``j``; its width
    follows from its length in bytes. Blank lines give no words but keep their
    line number. Everything is computed inside the page's row: no shuffle.
    """
    nested = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.transform(
            words_of(line), lambda word, j: F.struct(i.alias("line_no"), j.alias("place"), word.alias("text"))
        ),
    )
    return (
        pages.select(*PAGE, F.posexplode(F.flatten(nested)).alias("word_no", "w"))
        .select(
            *PAGE,
            "word_no",
            F.col("w.line_no").alias("line_no"),
            F.col("w.text").alias("text"),
            (LEFT_MARGIN + F.col("w.place") * WORD_STEP).alias("x"),
            (TOP_MARGIN - LINE_HEIGHT + F.col("w.line_no") * LINE_STEP).alias("y"),
            (F.octet_length("w.text") * BYTE_WIDTH).alias("width"),
            F.lit(LINE_HEIGHT).alias("height"),
        )
    )


def layout_lines(pages: DataFrame) -> DataFrame:
    """One row per non-blank line: trimmed text, box and nested word boxes.

    Boxes here are file space ``[x0, y0, x1, y1]`` under the page's top edge.
    """
    lines = pages.select(*PAGE, "height", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
        *PAGE, "line_no", trimmed(F.col("line")).alias("text"),
        (F.col("height") - TOP_MARGIN - F.col("line_no") * LINE_STEP).alias("y0"),
    )

    def word_box(word: Column, j: Column) -> Column:
        x0 = LEFT_MARGIN + j * WORD_STEP
        bbox = F.array(x0, F.col("y0"), x0 + F.octet_length(word) * BYTE_WIDTH, F.col("y0") + LINE_HEIGHT)
        return F.struct(word.alias("text"), bbox.alias("bbox"))

    return (
        lines.filter("text != ''")
        .withColumn("words", F.transform(words_of(F.col("text")), word_box))
        .select(
            *PAGE, "line_no", "text",
            F.array(
                F.lit(LEFT_MARGIN), F.col("y0"), F.element_at("words", -1)["bbox"][2], F.col("y0") + LINE_HEIGHT
            ).alias("bbox"),
            "words",
        )
    )


def drop_blank_words(words: DataFrame) -> DataFrame:
    return words.filter(trimmed(F.col("text")) != "")


def span_offsets(spans: DataFrame, sep: str = "") -> DataFrame:
    """Add ``start`` and ``end``: each span's place in the page text, in characters.

    A page's spans come out of one row, so they may meet in one window.
    """
    size = F.length("text")
    before = Window.partitionBy(*PAGE).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size + len(sep)).over(before), F.lit(0))
    return spans.withColumn("start", start).withColumn("end", F.col("start") + size)


def _walk(ys: Column, start: Column, tol: float) -> Column:
    """Pass sorted y values: the last anchor and the number of lines begun.

    ``start`` is a struct (anchor, lines); a y at ``tol`` or more from the anchor
    begins a line and becomes the anchor.
    """

    def step(acc: Column, y: Column) -> Column:
        begins = acc["anchor"].isNull() | (y - acc["anchor"] >= tol)
        return F.struct(
            F.when(begins, y).otherwise(acc["anchor"]).alias("anchor"),
            (acc["lines"] + begins.cast("int")).alias("lines"),
        )

    return F.aggregate(ys, start, step)


def _number(ys: Column, start: Column, tol: float) -> Column:
    """Sorted y values with their line numbers, going on from ``start``."""
    empty = F.array().cast("array<struct<y:double,line_no:int>>")

    def step(acc: Column, y: Column) -> Column:
        state = _walk(F.array(y), F.struct(acc["anchor"].alias("anchor"), acc["lines"].alias("lines")), tol)
        row = F.struct(y.alias("y"), (state["lines"] - 1).alias("line_no"))
        return F.struct(
            state["anchor"].alias("anchor"), state["lines"].alias("lines"), F.concat(acc["out"], F.array(row)).alias("out")
        )

    first = F.struct(start["anchor"].alias("anchor"), start["lines"].alias("lines"), empty.alias("out"))
    return F.aggregate(ys, first, step, lambda acc: acc["out"])


def assign_lines(words: DataFrame, tol: float, band: float = LINE_BAND) -> DataFrame:
    """Add ``line_no``: words whose y is within ``tol`` of the line's first word.

    The anchor is the first word of the line, so drift breaks a line once it
    adds up. Only the distinct y values of a page take part, cut into bands. A
    band can begin its first line only at its lowest y values (those less than
    ``tol`` above its first, and the next one); for each such entry the band
    tells where it ends. Chaining these summaries over a page's bands gives every
    band its entry, and bands then number their values side by side.
    """
    unset = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("lines"))
    ys = F.col("_ys")
    bands = words.groupBy(*PAGE, F.floor(F.col("y") / band).alias("_band")).agg(
        F.array_sort(F.collect_set("y")).alias("_ys")
    )
    low = F.size(F.filter(ys, lambda y: y - ys[0] < tol))
    entries = F.transform(
        F.slice(ys, F.lit(1), low + 1),
        lambda y: F.struct(y.alias("first"), _walk(F.filter(ys, lambda z: z >= y), unset, tol).alias("end")),
    )

    def chain(acc: Column, row: Column) -> Column:
        fits = F.filter(row["entries"], lambda e: acc["anchor"].isNull() | (e["first"] - acc["anchor"] >= tol))
        end = F.get(fits, F.lit(0))["end"]
        entered = F.struct(row["_band"].alias("_band"), F.struct(acc["anchor"].alias("anchor"), acc["lines"].alias("lines")).alias("_start"))
        return F.struct(
            F.coalesce(end["anchor"], acc["anchor"]).alias("anchor"),
            (acc["lines"] + F.coalesce(end["lines"], F.lit(0))).alias("lines"),
            F.concat(acc["out"], F.array(entered)).alias("out"),
        )

    none = F.array().cast("array<struct<_band:bigint,_start:struct<anchor:double,lines:int>>>")
    first = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("lines"), none.alias("out"))
    summaries = F.array_sort(F.collect_list(F.struct("_band", entries.alias("entries"))))
    entered = bands.groupBy(*PAGE).agg(F.aggregate(summaries, first, chain, lambda acc: acc["out"]).alias("_entered"))
    numbered = (
        bands.join(entered.select(*PAGE, F.inline("_entered")), [*PAGE, "_band"])
        .select(*PAGE, F.inline(_number(ys, F.col("_start"), tol)))
    )
    return words.drop("line_no").join(numbered, [*PAGE, "y"])


def group_lines(words: DataFrame, tol: float = 5.0) -> DataFrame:
    """Lines of selected words: words joined by blanks from left to right."""
    return (
        assign_lines(words, tol)
        .groupBy(*PAGE, "line_no")
        .agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY x, word_no)").alias("text"))
    )


def page_text(lines: DataFrame) -> DataFrame:
    """Line texts joined by line ends.

    ``part`` is 0 for any page of ordinary length; a page of more than
    ``LINES_PER_PART`` lines continues in further parts instead of one huge cell.
    """
    return (
        lines.withColumn("part", F.floor(F.col("line_no") / LINES_PER_PART).cast("int"))
        .groupBy(*PAGE, "part")
        .agg(F.expr(r"listagg(text, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text"))
    )


def geometric_text(words: DataFrame, tol: float = 2.0) -> DataFrame:
    """Reading-order text of pages without a structure tree."""
    return page_text(group_lines(words, tol))


def structure_order(spans: DataFrame, struct_tree: DataFrame) -> DataFrame:
    """Add ``reading_order``: the structure tree's order where a span has one,
    its geometric order after those otherwise.

    ``struct_tree`` has doc_id, page, word_no, struct_ord. Pages are expected to
    be read sorted by ``(tagged first, reading_order)``; no sort is forced here.
    """
    keys = [*PAGE, "word_no"]
    joined = spans.join(struct_tree, keys, "left")
    return joined.select(
        *[F.col(c) for c in spans.columns],
        F.coalesce("struct_ord", "word_no").cast("int").alias("reading_order"),
        F.col("struct_ord").isNotNull().alias("tagged"),
    )
