"""Exports: document text, tables, split and reorganised documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import delimited_row, export_frame, file_stem, page_block
from quirelake.operators.layout import PAGE
from quirelake.operators.matching import join_same
from quirelake.operators.pages import reorder_pages

# Pages of one export cell; longer documents continue in the next part.
PAGES_PER_PART = 1024


def export_text(pages: DataFrame, fmt: str = "txt", pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Documents as ``txt``, ``md`` or ``html``: ``(doc_id, part, text)``.

    The parts of a document, put together in order, are the exported file. Pages
    are numbered from 0 without gaps; a document of up to ``pages_per_part``
    pages has one part.
    """
    head, tail = export_frame(fmt)
    part = F.floor(F.col("page") / pages_per_part).cast("int")
    blocks = pages.select("doc_id", part.alias("part"), "page", page_block(F.col("text"), F.col("page"), fmt).alias("block"))
    parts = blocks.groupBy("doc_id", "part").agg(F.expr("listagg(block, '') WITHIN GROUP (ORDER BY page)").alias("text"))
    if not head and not tail:
        return parts
    last = blocks.groupBy("doc_id").agg(F.max("part").alias("_last"))
    return join_same(parts, last, ["doc_id"]).select(
        "doc_id", "part",
        F.concat(
            F.when(F.col("part") == 0, F.lit(head)).otherwise(F.lit("")),
            "text",
            F.when(F.col("part") == F.col("_last"), F.lit(tail)).otherwise(F.lit("")),
        ).alias("text"),
    )


def _write_sorted(table: DataFrame, order: list[str], path: str) -> None:
    table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_export(export: DataFrame, path: str, folders: bool = False) -> None:
    """Store export parts sorted by document, so reading one document prunes to it.

    ``folders`` writes text files instead, one folder per document, as a hand-over to tools
    that want files; for a whole corpus that is a folder for each of its documents. A part
    ends in a line end, and so does a written row: one of them is left out,
    so the files of a document put together are the export.
    """
    if not folders:
        _write_sorted(export, ["doc_id", "part"], path)
        return
    text = F.when(F.endswith("text", F.lit("\n")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    (
        export.repartitionByRange("doc_id", "part")
        .sortWithinPartitions("doc_id", "part")
        .select("doc_id", text.alias("text"))
        .write.partitionBy("doc_id").option("lineSep", "\n").mode("overwrite").text(path)
    )


def export_tables(tables: DataFrame, sep: str = ",") -> DataFrame:
    """Detected tables as delimited lines: ``(doc_id, page, table_no, part, row_no, line)``."""
    return tables.select(*PAGE, "table_no", "part", F.posexplode("cells").alias("row_no", "_cells")).select(
        *PAGE, "table_no", "part", "row_no", delimited_row(F.col("_cells"), sep).alias("line")
    )


def write_tables(tables: DataFrame, path: str, sep: str = ",", folders: bool = False) -> None:
    """Store table lines sorted in table order; with ``folders`` as text, one folder per document."""
    order = [*PAGE, "table_no", "part", "row_no"]
    lines = export_tables(tables, sep)
    if not folders:
        _write_sorted(lines, order, path)
        return
    (
        lines.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("doc_id", "line")
        .write.partitionBy("doc_id").mode("overwrite").text(path)
    )


def split_pages(pages: DataFrame, page_list: list[int] | None = None) -> DataFrame:
    """Pages of a split with their output name ``{stem}_page_{n}``.

    ``page_list`` is zero-based; ``None`` splits every page, an empty list none;
    pages a document lacks are skipped. ``pages`` has a ``path`` column.
    """
    kept = pages if page_list is None else pages.filter(F.col("page").isin(page_list))
    name = F.concat(file_stem(F.col("path")), F.lit("_page_"), (F.col("page") + 1).cast("string"))
    return kept.withColumn("out_name", name)


def write_split(split: DataFrame, path: str, folders: bool = False) -> None:
    """Store split pages sorted by output name, so reading one page prunes to it.

    ``folders`` gives every page a folder of its own, as a hand-over to tools that
    want files; for a whole corpus that is one small file per page.
    """
    if folders:
        split.write.partitionBy("doc_id", "out_name").mode("overwrite").parquet(path)
        return
    _write_sorted(split, ["doc_id", "out_name"], path)


def write_organised(pages: DataFrame, order: DataFrame, path: str) -> None:
    """Store documents in the user's page order, sorted for page-range reads."""
    (
        reorder_pages(pages, order)
        .repartitionByRange("doc_id", "position")
        .sortWithinPartitions("doc_id", "position")
        .write.mode("overwrite").parquet(path)
    )
