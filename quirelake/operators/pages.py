"""Page tables: checks, selection, labels, order, stacking, reading log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.geometry import norm_rotation
from quirelake.functions.text import fill_placeholders, fold_ascii, page_label, trimmed
from quirelake.operators.layout import PAGE
from quirelake.operators.matching import join_same
from quirelake.operators.prefix import running_total

# Layout of the page stack, in points.
PAGE_SPACING = 20.0
PAGE_PADDING = 30.0
DEFAULT_VIEW_HEIGHT = 2000.0
FOCUS_SHARE = 0.3

# Height of a band of the page stack in the reading-log join.
BAND = 4096.0
# Pages listed in one cell.
PAGES_PER_PART = 65536


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))


def page_exists(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``error``: NULL when the page is there, else a typed message."""
    checked = requests.join(page_counts(pages), "doc_id", "left")
    error = F.when(F.col("page_count").isNull(), F.lit("DocumentNotFound")).when(
        (F.col("page") < 0) | (F.col("page") >= F.col("page_count")),
        F.concat(F.lit("PageNotFound("), F.col("page").cast("string"), F.lit(")")),
    )
    return checked.select(*[F.col(c) for c in requests.columns], error.alias("error"))


def on_page(table: DataFrame, page: int) -> DataFrame:
    return table.filter(F.col("page") == page)


def parse_page_list(spec: str) -> list[tuple[int, int]]:
    """``"1,3-5"`` to zero-based inclusive ranges."""
    ranges = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        ranges.append((int(low) - 1, int(high or low) - 1))
    return ranges


def select_pages(pages: DataFrame, spec: str | None) -> DataFrame:
    """Pages named by a list such as ``1,3-5,10``; ``None`` keeps all, an empty
    list none. The ranges become plain comparisons the scan can push down."""
    if spec is None:
        return pages
    wanted = F.lit(False)
    for low, high in parse_page_list(spec) if spec.strip() else []:
        wanted = wanted | F.col("page").between(low, high)
    return pages.filter(wanted)


def select_pages_by(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """As :func:`select_pages` with one list per document (doc_id, spec).

    Ranges stay ranges in one row per document; they are never spelt out."""
    bounds = F.transform(
        F.split(F.regexp_replace("spec", " ", ""), ","),
        lambda part: F.struct(
            (F.split_part(part, F.lit("-"), F.lit(1)).cast("int") - 1).alias("low"),
            (F.regexp_extract(part, r"(\d+)$", 1).cast("int") - 1).alias("high"),
        ),
    )
    listed = specs.filter(F.trim("spec") != "").select("doc_id", bounds.alias("_bounds"))
    inside = F.exists("_bounds", lambda b: F.col("page").between(b["low"], b["high"]))
    return pages.join(listed, "doc_id").filter(inside).drop("_bounds")


def document_summary(pages: DataFrame) -> DataFrame:
    """Page count and widest page per document."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.max("width").alias("max_width")
    )


def page_heights(pages: DataFrame) -> DataFrame:
    """Ordered page heights per document, ``PAGES_PER_PART`` to a cell."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "height")))
    return (
        pages.groupBy("doc_id", F.floor(F.col("page") / PAGES_PER_PART).cast("int").alias("part"))
        .agg(F.transform(ordered, lambda p: p["height"]).alias("heights"))
    )


def attach_labels(table: DataFrame, pages: DataFrame) -> DataFrame:
    """Add the printed label of each row's page."""
    labels = pages.select(*PAGE, F.col("label").alias("_label"))
    joined = table.join(labels, list(PAGE), "left")
    return joined.withColumn("label", page_label(F.col("_label"), F.col("page"))).drop("_label")


def resolve_page_ref(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``page``: what the user typed as a label or a number.

    The first page whose label matches (ASCII case ignored) wins; otherwise a
    number means the page before it, and zero stays zero; otherwise NULL.
    """
    first = pages.groupBy("doc_id", fold_ascii(F.col("label")).alias("_key")).agg(F.min("page").alias("_page"))
    typed = trimmed(F.col("input"))
    number = F.when(typed.rlike(r"^\+?[0-9]+$"), typed.try_cast("bigint"))
    return (
        requests.withColumn("_key", fold_ascii(typed))
        .join(first, ["doc_id", "_key"], "left")
        .select(
            *[F.col(c) for c in requests.columns],
            F.coalesce(F.col("_page").cast("bigint"), F.when(number > 0, number - 1).otherwise(number)).alias("page"),
        )
    )


def reorder_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages in a new order; ``order`` has doc_id and the list of source pages.

    What is on a page follows it: join other tables on ``source_page`` alike.
    """
    placed = order.select("doc_id", F.posexplode("order").alias("position", "page"))
    return pages.join(placed, list(PAGE)).withColumnRenamed("page", "source_page")


def merge_documents(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Append documents in order and renumber their pages.

    ``plan`` has target_id, ordinal, doc_id: the same document may be merged into
    several targets, or several times into one.
    """
    sized = join_same(plan, page_counts(pages), ["doc_id"])
    placed = running_total(sized, ["target_id"], "ordinal", F.col("page_count"), "_first").drop("page_count")
    return (
        join_same(pages.withColumnRenamed("page", "source_page"), placed, ["doc_id"])
        .withColumn("page", (F.col("source_page") + F.col("_first")).cast("int"))
        .drop("_first")
    )


def page_offsets(pages: DataFrame, zoom: float = 1.0, spacing: float = PAGE_SPACING) -> DataFrame:
    """Add ``offset``: y of each page in the stack."""
    return running_total(pages, ["doc_id"], "page", (F.col("height") + spacing) * zoom, "offset")


def pages_seen(views: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages on screen for each scroll position of a reading log.

    ``views`` has view_id, doc_id, viewport_y, viewport_height, zoom. Result:
    ``first_page`` and exclusive ``end_page`` of the range overlapping the
    viewport grown by half its height (0, 0 if none), and ``main_page``, the last
    page holding the point 0.3 of a viewport down.

    Views and page extents meet on bands of the stack. Extents are kept at zoom
    one and views divided by their zoom, so pages are placed once for all views.
    """
    stack = page_offsets(pages).select(
        *PAGE,
        (F.col("offset") + PAGE_PADDING).alias("top"),
        (F.col("offset") + PAGE_PADDING + F.col("height")).alias("bottom"),
    )

    def bands(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND)))

    banded_pages = stack.withColumn("_band", bands(F.col("top"), F.col("bottom")))
    reach = F.when(F.col("viewport_height") > 0, F.col("viewport_height")).otherwise(F.lit(DEFAULT_VIEW_HEIGHT))
    placed = views.withColumn("_reach", reach).select(
        "view_id", "doc_id",
        (F.greatest(F.col("viewport_y") - F.col("_reach") * 0.5, F.lit(0.0)) / F.col("zoom")).alias("_low"),
        ((F.col("viewport_y") + F.col("_reach") * 1.5) / F.col("zoom")).alias("_high"),
        ((F.col("viewport_y") + F.col("_reach") * FOCUS_SHARE) / F.col("zoom")).alias("_focus"),
    )
    banded_views = placed.filter("_high >= _low").withColumn("_band", bands(F.col("_low"), F.col("_high")))
    on_screen = (F.col("bottom") >= F.col("_low")) & (F.col("top") <= F.col("_high"))
    in_focus = (F.col("_focus") >= F.col("top")) & (F.col("_focus") <= F.col("bottom"))
    seen = (
        banded_views.join(banded_pages, ["doc_id", "_band"])
        .filter(on_screen)
        .groupBy("view_id")
        .agg(
            F.min("page").alias("first_page"),
            (F.max("page") + 1).alias("end_page"),
            F.max(F.when(in_focus, F.col("page"))).alias("main_page"),
        )
    )
    return views.select("view_id", "doc_id").join(seen, "view_id", "left").select(
        "view_id", "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("first_page", "end_page", "main_page")]
    )


def page_x_of_y(pages: DataFrame, fmt: str) -> DataFrame:
    """Add ``caption``: a format with ``{page}`` and ``{pages}`` filled in."""
    placed = join_same(running_total(pages, ["doc_id"], "page", F.lit(1), "_before"), page_counts(pages), ["doc_id"])
    caption = fill_placeholders(F.lit(fmt), F.col("_before") + 1, F.col("page_count"))
    return placed.withColumn("caption", caption).drop("_before", "page_count")


def delete_page(pages: DataFrame, annotations: DataFrame, page: int) -> tuple[DataFrame, DataFrame]:
    """Remove one page of every document with its annotations; close the gap."""

    def close(table: DataFrame) -> DataFrame:
        shifted = F.when(F.col("page") > page, F.col("page") - 1).otherwise(F.col("page"))
        return table.filter(F.col("page") != page).withColumn("page", shifted)

    return close(pages), close(annotations)


def edit_pages(pages: DataFrame, rotate: str | None = None, delete: str | None = None, order: str | None = None) -> DataFrame:
    """Rotate, delete and reorder pages of every document at once.

    ``rotate`` reads ``1-5:90 7:180``, ``delete`` and ``order`` read ``3,7-9``; all
    name pages as they are in the input. Ordered pages come first, the first naming
    of a page counts, and the others follow in their order. Pages a document lacks
    are skipped. Adds ``source_page``; pages are numbered anew without gaps.
    """
    page, turned = F.col("page"), F.col("rotation")
    for part in (rotate or "").split():
        spec, _, degrees = part.partition(":")
        for low, high in parse_page_list(spec):
            turned = F.when(page.between(low, high), norm_rotation(turned, F.lit(int(degrees)))).otherwise(turned)
    gone = F.lit(False)
    for low, high in parse_page_list(delete) if delete else []:
        gone = gone | page.between(low, high)
    listed = []
    place = 0
    for low, high in parse_page_list(order) if order else []:
        listed.append((page.between(low, high), place + page - low))
        place += high - low + 1
    rank = place + page
    for named, at in reversed(listed):
        rank = F.when(named, at).otherwise(rank)
    kept = pages.withColumn("rotation", turned.cast("int")).where(~gone).withColumns({"source_page": page, "_rank": rank})
    return running_total(kept, ["doc_id"], "_rank", F.lit(1), "_page").withColumn("page", F.col("_page").cast("int")).drop("_rank", "_page")
