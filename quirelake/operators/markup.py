"""Titles, headings, links and attributes of web pages; link policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is no markup of the page: comments, scripts and styles, to the end of the page if they are left open.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\z)"
# The value of an attribute, quoted or not.
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
# What each extraction looks for.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"
ANCHOR = r"(?is)<a\s[^>]*>"
HREF = r"(?is)\shref\s*=\s*" + _VALUE
LANGUAGE = r"(?is)<html[^>]*\slang\s*=\s*" + _VALUE
TAG = r"(?is)<[^>]*>"
SAFE_SCHEMES = ("http://", "https://", "mailto:")


def _first(text, pattern: str):
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def shown(html: Column) -> Column:
    """A page without its comments, scripts and styles: one linear pass, and links in them don't count."""
    return F.regexp_replace(html, HIDDEN, " ")


def _value(text: Column, pattern: str) -> Column:
    return F.regexp_replace(_first(text, pattern), r"""^["']|["']$""", "")


def markup_documents(html: DataFrame) -> DataFrame:
    """Title, language and source of each page; NULL where absent.

    ``html`` has doc_id, url, html."""
    return html.select(
        "doc_id", F.col("url").alias("path"),
        _first(shown(F.col("html")), TITLE).alias("title"), _value(shown(F.col("html")), LANGUAGE).alias("language"),
    )


def markup_headings(html: DataFrame) -> DataFrame:
    """Headings in document order with their level; tags inside are removed."""
    found = F.regexp_extract_all(shown(F.col("html")), F.lit(HEADING), F.lit(0))
    return html.select("doc_id", F.posexplode(found).alias("ordinal", "_h")).select(
        "doc_id", "ordinal", F.substring("_h", 3, 1).cast("int").alias("level"),
        F.regexp_replace("_h", TAG, "").alias("title"),
    )


def markup_links(html: DataFrame) -> DataFrame:
    """Anchors with a target. ``#name`` targets are jumps inside the document
    (no url, page 0)."""
    found = F.regexp_extract_all(shown(F.col("html")), F.lit(ANCHOR), F.lit(0))
    target = _value(F.col("_a"), HREF)
    inside = F.col("_url").startswith("#")
    return html.select("doc_id", F.posexplode(found).alias("link_no", "_a")).select(
        "doc_id", "link_no", target.alias("_url")
    ).select(
        "doc_id", F.lit(0).alias("page"), "link_no",
        F.when(~inside, F.col("_url")).alias("url"),
        F.when(inside, F.lit(0)).alias("destination_page"),
    )


def usable_links(links: DataFrame) -> DataFrame:
    """Links with a url or a destination page."""
    return links.filter(F.col("url").isNotNull() | F.col("destination_page").isNotNull())


def safe_links(links: DataFrame) -> DataFrame:
    """Add ``action``: external for allowed schemes, internal for page jumps
    without a url, else blocked."""
    folded = F.lower("url")
    allowed = F.lit(False)
    for scheme in SAFE_SCHEMES:
        allowed = allowed | folded.startswith(scheme)
    action = (
        F.when(F.col("url").isNotNull() & allowed, F.lit("external"))
        .when(F.col("url").isNull() & F.col("destination_page").isNotNull(), F.lit("internal"))
        .otherwise(F.lit("blocked"))
    )
    return links.withColumn("action", action)
