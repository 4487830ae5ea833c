"""Inputs of the registered queries, derived from the given tables.

Each input is a DataFrame function and, under the same name, a common table
expression for the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.layout import layout_words
from quirelake.sources.corpus import paginate

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def with_inputs(*names: str) -> str:
    """``WITH`` clause defining the named inputs and what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = CTES[name]
        for need in needs:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + " "


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as documents, one page per turn."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("page"),
        F.lit(612.0).alias("width"),
        (700 + (F.col("conv_id") * 7 + F.col("turn") * 13) % 200).cast("double").alias("height"),
        ((F.col("turn") % 4) * 90).cast("int").alias("rotation"),
        F.col("role").alias("label"),
        "text",
    )


_cte("turns", (), """
    SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, CAST(612 AS DOUBLE) AS width,
           CAST(700 + (conv_id * 7 + turn * 13) % 200 AS DOUBLE) AS height,
           CAST((turn % 4) * 90 AS INTEGER) AS rotation, role AS label, text
    FROM conversations""")


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut into pages of ten lines."""
    return paginate(table(spark, folder, "documents").select("doc_id", "text"))


_cte("sheets", (), r"""
    SELECT doc_id, CAST((i - 1) // 10 AS INTEGER) AS page, CAST(612 AS DOUBLE) AS width,
           CAST(792 AS DOUBLE) AS height, CAST((i - 1) // 10 + 1 AS VARCHAR) AS label,
           string_agg(line, chr(10) ORDER BY i) AS text
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM documents)
    GROUP BY doc_id, (i - 1) // 10""")

# The White_Space characters in the check engine's pattern syntax.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def turn_words(spark: SparkSession, folder: str) -> DataFrame:
    return layout_words(turns(spark, folder))


def sheet_words(spark: SparkSession, folder: str) -> DataFrame:
    return layout_words(sheets(spark, folder))


def _words_cte(source: str) -> str:
    return rf"""
    SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, j) - 1 AS INTEGER) AS word_no,
           CAST(line_no AS INTEGER) AS line_no, text, 50.0::DOUBLE + 45.0::DOUBLE * (j - 1) AS x,
           28.0::DOUBLE + 18.0::DOUBLE * line_no AS y, 8.0::DOUBLE * strlen(text) AS width, 12.0::DOUBLE AS height
    FROM (SELECT doc_id, page, line_no, unnest(ws) AS text, generate_subscripts(ws, 1) AS j
          FROM (SELECT doc_id, page, line_no, list_filter(regexp_split_to_array(line, '{SPACE}+'), lambda x: x <> '') AS ws
                FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line,
                             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
                      FROM {source})))"""


_cte("turn_words", ("turns",), _words_cte("turns"))
_cte("sheet_words", ("sheets",), _words_cte("sheets"))


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number in ``props`` and a session-zone timestamp."""
    return table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


_cte("clicks", (), """
    SELECT event_id, ts, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A box on a page for each event."""
    return clicks(spark, folder).select(
        F.col("event_id").alias("box_id"),
        F.col("user_id").alias("doc_id"),
        (F.col("k") % 8).alias("page"),
        (50.0 + 45.0 * (F.col("event_id") % 8)).alias("x"),
        (28.0 + 18.0 * (F.col("k") % 6)).alias("y"),
        F.lit(90.0).alias("width"), F.lit(18.0).alias("height"),
    )


_cte("boxes", ("clicks",), """
    SELECT event_id AS box_id, user_id AS doc_id, CAST(k % 8 AS INTEGER) AS page,
           50.0::DOUBLE + 45.0::DOUBLE * (event_id % 8) AS x, 28.0::DOUBLE + 18.0::DOUBLE * (k % 6) AS y,
           90.0::DOUBLE AS width, 18.0::DOUBLE AS height FROM clicks""")

# Event type to annotation kind of the derived marks.
KIND_OF = {"click": "Highlight", "view": "Rectangle", "error": "Redact", "purchase": "Text", "signup": "StickyNote"}


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """An annotation for each event."""
    events = clicks(spark, folder)
    kind = F.lit(None).cast("string")
    for event_type, name in KIND_OF.items():
        kind = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(kind)
    note = F.col("kind").isin("Text", "StickyNote")
    return events.withColumn("kind", kind).select(
        F.col("event_id").alias("ann_id"),
        F.col("user_id").alias("doc_id"),
        (F.col("k") % 8).alias("page"),
        "kind",
        (50.0 + 45.0 * (F.col("event_id") % 8)).alias("x"),
        (28.0 + 18.0 * (F.col("k") % 6)).alias("y"),
        F.lit(90.0).alias("width"), F.lit(18.0).alias("height"),
        F.lit("#FFFF00").alias("color"),
        F.when(F.col("kind") == "Rectangle", F.lit(2.0)).alias("thickness"),
        F.when(F.col("kind") == "Rectangle", F.lit(True)).alias("fill"),
        F.when(note, F.col("event_type")).alias("text"),
        F.when(F.col("kind") == "Text", F.lit(12)).alias("font_size"),
    )


_cte("marks", ("clicks",), """
    SELECT event_id AS ann_id, user_id AS doc_id, CAST(k % 8 AS INTEGER) AS page,
           CASE event_type WHEN 'click' THEN 'Highlight' WHEN 'view' THEN 'Rectangle' WHEN 'error' THEN 'Redact'
                WHEN 'purchase' THEN 'Text' WHEN 'signup' THEN 'StickyNote' END AS kind,
           50.0::DOUBLE + 45.0::DOUBLE * (event_id % 8) AS x, 28.0::DOUBLE + 18.0::DOUBLE * (k % 6) AS y,
           90.0::DOUBLE AS width, 18.0::DOUBLE AS height, '#FFFF00' AS color,
           CASE WHEN event_type = 'view' THEN 2.0::DOUBLE END AS thickness,
           CASE WHEN event_type = 'view' THEN true END AS fill,
           CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS text,
           CASE WHEN event_type = 'purchase' THEN 12 END AS font_size
    FROM clicks""")


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url", "html")


_cte("html_pages", (), "SELECT page_id AS doc_id, url, html FROM pages")
# The same without what is hidden in them.
_cte("shown_pages", (), r"""
    SELECT page_id AS doc_id, url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\z)', ' ', 'g') AS html FROM pages""")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """A pixel for each line item, on one page per supplier."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("page_id"),
        (F.col("l_partkey") % 600).cast("int").alias("px"),
        (F.col("l_orderkey") % 800).cast("int").alias("py"),
        (F.col("l_partkey") % 256).cast("int").alias("r"),
        (F.col("l_suppkey") % 256).cast("int").alias("g"),
        (F.col("l_quantity").cast("int") * 5).alias("b"),
    )


_cte("pixels", (), """
    SELECT l_suppkey AS page_id, CAST(l_partkey % 600 AS INTEGER) AS px, CAST(l_orderkey % 800 AS INTEGER) AS py,
           CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g,
           CAST(l_quantity AS INTEGER) * 5 AS b FROM lineitem""")
