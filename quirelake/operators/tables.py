"""Table detection over laid-out words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import delimited_row
from quirelake.operators.layout import PAGE, assign_lines

# Fixed values of the detection rule.
LINE_TOLERANCE = 2.0
COLUMN_STEP = 5.0
SHARED_COLUMNS = 2
MIN_LINES = 2
# White space between two cells of a line.
CELL_GAP = 12.0
# Table lines kept in one cell.
LINES_PER_PART = 4096


def _table_lines(words: DataFrame) -> DataFrame:
    """Lines of each page with ``run``, the first line of the run they are in.

    A page's words come out of one row, so its lines may meet in one window: the
    words are dealt by page once, and lines, runs and tables come out of that shuffle.
    """
    word = F.struct("x", "word_no", "text")
    column = F.round(F.col("x") / COLUMN_STEP) * COLUMN_STEP
    lines = (
        assign_lines(words, LINE_TOLERANCE)
        .repartition(*PAGE)
        .groupBy(*PAGE, "line_no")
        .agg(
            F.collect_set(column).alias("_starts"),
            F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]).alias("cells"),
            F.min("x").alias("x0"), F.min("y").alias("y0"),
            F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"),
        )
    )
    in_page = Window.partitionBy(*PAGE).orderBy("line_no")
    shared = F.coalesce(F.size(F.array_intersect("_starts", F.lag("_starts").over(in_page))), F.lit(0))
    begun = lines.withColumn("_begins", shared < SHARED_COLUMNS)
    return begun.withColumn("run", F.max(F.when(F.col("_begins"), F.col("line_no"))).over(in_page)).drop("_starts", "_begins")


def detect_tables(words: DataFrame) -> DataFrame:
    """Tables of each page: box, cells, CSV and TSV text.

    Two or more consecutive lines sharing two or more column starts (rounded to
    5 points) form a table. ``part`` is 0 unless a table exceeds
    ``LINES_PER_PART`` lines; the box is that of the whole table.
    """
    run = Window.partitionBy(*PAGE, "run")
    framed = _table_lines(words).withColumns({
        "line_count": F.count("*").over(run), "x": F.min("x0").over(run), "y": F.min("y0").over(run),
        "width": F.max("x1").over(run) - F.min("x0").over(run), "height": F.max("y1").over(run) - F.min("y0").over(run),
    }).filter(F.col("line_count") >= MIN_LINES)
    numbered = framed.withColumn("table_no", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("run")) - 1)
    row = F.struct("line_no", "cells")
    parts = (
        numbered.withColumn("part", F.floor((F.col("line_no") - F.col("run")) / LINES_PER_PART).cast("int"))
        .groupBy(*PAGE, "table_no", "part", "line_count", "x", "y", "width", "height")
        .agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("cells"))
    )
    return parts.withColumns({
        "csv": F.array_join(F.transform("cells", lambda r: delimited_row(r, ",")), "\n"),
        "tsv": F.array_join(F.transform("cells", lambda r: delimited_row(r, "\t")), "\n"),
    })


def ruled_tables(words: DataFrame, cell_gap: float = CELL_GAP) -> DataFrame:
    """Cells of each page's tables: ``doc_id, page, table_no, row_no, column, last_column, x, width, text``.

    White space of at least ``cell_gap`` parts a line into cells. Consecutive lines of
    two cells or more are a run. The cells of the run's fullest lines, laid over each other,
    leave rivers of white space, and what lies between rivers are the columns; so
    columns may be ragged on both sides as long as a river is left. A cell is in all columns it overlaps,
    from ``column`` to ``last_column``: a heading over several columns spans them. One that
    overlaps none belongs to the next column on its right. Runs of fewer than ``MIN_LINES`` lines or
    two columns are no tables.

    A page's words come out of one row, so its lines may meet in one window.
    """
    line = [*PAGE, "line_no"]
    along = Window.partitionBy(*line).orderBy("x", "word_no")
    reach = F.max(F.col("x") + F.col("width")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("x") - reach >= cell_gap), 1).otherwise(0)
    begun = assign_lines(words, LINE_TOLERANCE).repartition(*PAGE).withColumn("_begins", begins)
    celled = begun.withColumn("_cell", F.sum("_begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    cells = celled.groupBy(*line, "_cell").agg(
        F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_no", "text"))), lambda w: w["text"]), " ").alias("text"))
    counted = cells.withColumn("_cells", F.max("_cell").over(Window.partitionBy(*line)))
    # Lines with one cell stay in the window below, so that they end a run.
    in_page = Window.partitionBy(*PAGE).orderBy("line_no")
    ruled = F.col("_cells") > 1
    numbered = counted.withColumn("_lone", F.sum(F.when(ruled, 0).otherwise(1)).over(in_page.rangeBetween(Window.unboundedPreceding, 0))).where(ruled)
    run = [*PAGE, "_lone"]
    full = numbered.withColumn("_full", F.col("_cells") == F.max("_cells").over(Window.partitionBy(*run)))
    across = Window.partitionBy(*run).orderBy("x0", "line_no")
    wide = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    risen = full.where("_full").withColumn("_rises", F.when(wide.isNull() | (F.col("x0") > wide), 1).otherwise(0))
    columns = (
        risen.withColumn("_column", F.sum("_rises").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*run, "_column").agg(F.min("x0").alias("from"), F.max("x1").alias("to"))
        .groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("_columns"))
    )
    size = full.groupBy(*run).agg(F.count_distinct("line_no").alias("_lines"))
    tables = columns.join(size, run).where((F.col("_lines") >= MIN_LINES) & (F.size("_columns") > 1))
    table_no = (F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("_lone")) - 1).alias("table_no")
    left = F.size(F.filter("_columns", lambda c: c["to"] <= F.col("x0")))
    reached = F.size(F.filter("_columns", lambda c: c["from"] < F.col("x1")))
    last = F.size("_columns") - 1
    return full.join(tables, run).select(
        *PAGE, table_no, (F.dense_rank().over(Window.partitionBy(*run).orderBy("line_no")) - 1).alias("row_no"),
        F.least(left, last).alias("column"), F.least(F.greatest(left, reached - 1), last).alias("last_column"),
        F.col("x0").alias("x"), (F.col("x1") - F.col("x0")).alias("width"), "text")
