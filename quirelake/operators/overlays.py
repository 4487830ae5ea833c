"""Text laid over pages: headers, footers, watermarks and stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.color import stamp_color
from quirelake.operators.layout import PAGE
from quirelake.operators.pages import page_x_of_y

# Place, size and grey of the overlay texts.
HEADER = {"x": 50.0, "y": 760.0, "size": 10.0, "grey": 0.2}
FOOTER = {"x": 50.0, "y": 30.0, "size": 10.0, "grey": 0.2}
WATERMARK = {"x": 200.0, "y": 400.0, "size": 48.0, "grey": 0.7}
STAMP = {"x": 50.0, "y": 50.0, "size": 36.0}


def _item(kind: str, text: Column, spec: dict[str, float], font: str = "Helvetica", color: Column | None = None) -> Column:
    grey = F.lit(spec.get("grey", 0.0))
    rgb = [grey, grey, grey] if color is None else [color["r"], color["g"], color["b"]]
    return F.struct(
        F.lit(kind).alias("overlay"), text.alias("text"), F.lit(spec["x"]).alias("x"), F.lit(spec["y"]).alias("y"),
        F.lit(font).alias("font"), F.lit(spec["size"]).alias("size"),
        rgb[0].alias("r"), rgb[1].alias("g"), rgb[2].alias("b"),
    )


def header_footer(pages: DataFrame, header: str, footer: str) -> DataFrame:
    """Header and numbered footer of each page, each only if it has text."""
    numbered = page_x_of_y(pages, footer)
    items = F.array(_item("header", F.lit(header), HEADER), _item("footer", F.col("caption"), FOOTER))
    shown = F.filter(items, lambda i: i["text"] != "")
    return numbered.select(*PAGE, F.inline(shown))


def watermark(pages: DataFrame, text: str) -> DataFrame:
    return pages.select(*PAGE, F.inline(F.array(_item("watermark", F.lit(text), WATERMARK))))


def stamps(requests: DataFrame) -> DataFrame:
    """One stamp per request (doc_id, page, label), coloured by its label."""
    item = _item("stamp", F.col("label"), STAMP, "Helvetica-Bold", stamp_color(F.col("label")))
    return requests.select(*PAGE, F.inline(F.array(item)))


def overlay_rows(
    pages: DataFrame, header: str = "", footer: str = "", watermark_text: str = "", stamp_requests: DataFrame | None = None
) -> DataFrame:
    """All overlay rows of a run in one table."""
    out = header_footer(pages, header, footer)
    if watermark_text:
        out = out.unionByName(watermark(pages, watermark_text))
    if stamp_requests is not None:
        out = out.unionByName(stamps(stamp_requests))
    return out
