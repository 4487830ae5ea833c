"""Form fields: filling and placing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.records import button_kind, field_checked, field_value_text, option_index

FIELD = ("doc_id", "name")


def fill_form(fields: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Fields with new values where an update names them.

    Of several updates of a field the last by ``order`` that gives a value counts; of equal
    ones, and without an order, the greatest value. Updates collapse to one row a field before they meet the fields.
    """
    given = updates.where(F.col("value").isNotNull())
    last = F.max(F.struct(*([order] if order else []), F.col("value").alias("_new")))["_new"]
    new = given.groupBy(*FIELD).agg(last.alias("_new"))
    joined = fields.join(new, list(FIELD), "left")
    return joined.withColumn("value", F.coalesce("_new", "value")).drop("_new")


def rejected_updates(fields: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that name no field; they are reported, not fatal."""
    return updates.join(fields.select(*FIELD), list(FIELD), "left_anti")


def field_page(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``page``: the first page listing the field's first widget, else 0.

    ``fields`` has doc_id, name, widgets; ``pages`` has doc_id, page, annots.
    """
    listed = (
        pages.select("doc_id", "page", F.explode("annots").alias("_widget"))
        .groupBy("doc_id", "_widget")
        .agg(F.min("page").alias("_page"))
    )
    return (
        fields.withColumn("_widget", F.get("widgets", F.lit(0)))
        .join(listed, ["doc_id", "_widget"], "left")
        .withColumn("page", F.coalesce("_page", F.lit(0)))
        .drop("_widget", "_page")
    )


def list_fields(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """The form fields of documents as one table: ``doc_id, name, kind, value, checked, options, selected_index, page``.

    ``fields`` has doc_id, name, type (``button``, ``choice`` or ``text``), flags, value,
    state (of a button), options and widgets; ``pages`` is as in :func:`field_page`.
    """
    kind = F.when(F.col("type") == "button", button_kind(F.col("flags"))).otherwise(F.col("type"))
    checked = F.when(F.col("type") == "button", field_checked(F.col("state")))
    index = F.when(F.col("type") == "choice", option_index(F.col("options"), F.col("value")))
    shown = field_value_text(F.col("kind"), F.col("value"), F.col("checked"), F.col("options"), F.col("selected_index"))
    told = fields.withColumns({"kind": kind, "checked": checked, "selected_index": index}).withColumn("value", shown)
    return field_page(told, pages).select("doc_id", "name", "kind", "value", "checked", "options", "selected_index", "page")
