"""Record expressions: metadata, geography, form fields, tagged JSON, trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIO_FLAG = 32768  # bit 15 of the field flags

# The annotation kinds and the fields of each, in their JSON form.
STYLE_FIELDS = {
    "Text": ("text", "color", "font_size"),
    "Highlight": ("color",),
    "Rectangle": ("color", "thickness", "fill"),
    "Redact": ("color",),
    "Circle": ("color", "thickness", "fill"),
    "Line": ("color", "thickness"),
    "Arrow": ("color", "thickness"),
    "StickyNote": ("comment", "color"),
}
# Where a JSON field is kept in the flat annotation table, when named otherwise.
STYLE_COLUMNS = {"comment": "text"}

METADATA_FIELDS = (
    "title", "author", "subject", "keywords", "creator", "producer", "creation_date", "modification_date",
)


def merge_metadata(primary: Column, fallback: Column) -> Column:
    """Metadata struct: the primary source wins field by field.

    ``primary`` has title, creators[], description, subjects[], keywords,
    creator_tool, producer, create_date, modify_date; ``fallback`` has the eight
    plain fields.
    """

    def joined(name: str) -> Column:
        items = primary[name]
        return F.when(F.size(items) > 0, F.array_join(items, ", "))

    sources = {
        "title": [primary["title"]],
        "author": [joined("creators")],
        "subject": [primary["description"], joined("subjects")],
        "keywords": [primary["keywords"]],
        "creator": [primary["creator_tool"]],
        "producer": [primary["producer"]],
        "creation_date": [primary["create_date"]],
        "modification_date": [primary["modify_date"]],
    }
    return F.struct(*[F.coalesce(*sources[name], fallback[name]).alias(name) for name in METADATA_FIELDS])


def _quoted(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.get(found, F.lit(0))


def geo_name(wkt: Column, epsg: Column, kind: Column) -> Column:
    """First quoted name in the WKT, else ``EPSG:n``, else the system's type."""
    return F.coalesce(
        _quoted(wkt, r'^[^"]*"([^"]*)"'), F.concat(F.lit("EPSG:"), epsg.cast("string")), kind
    )


def geo_projection(wkt: Column) -> Column:
    return _quoted(wkt, r'(?s)PROJECTION\[[^"]*"([^"]*)"')


def geo_unit(preferred: Column, other: Column) -> Column:
    return F.coalesce(preferred, other)


def option_index(options: Column, value: Column) -> Column:
    """Zero-based place of a value among the options, NULL when absent."""
    place = F.array_position(options, value)
    return F.when(place > 0, place.cast("int") - 1)


def option_label(options: Column, index: Column) -> Column:
    """Option at a zero-based index; empty when there is none."""
    return F.coalesce(F.get(options, index), F.lit(""))


def field_value_text(kind: Column, value: Column, checked: Column, options: Column, index: Column) -> Column:
    """The string a form field is filled with."""
    mark = F.when(checked, F.lit("Yes")).otherwise(F.lit("Off"))
    return (
        F.when(kind.isin("checkbox", "radio"), mark)
        .when(kind == "choice", option_label(options, index))
        .otherwise(value)
    )


def field_checked(name: Column) -> Column:
    return F.coalesce(name != "Off", F.lit(False))


def button_kind(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(RADIO_FLAG) != 0, F.lit("radio")).otherwise(F.lit("checkbox"))


def style_from_json(style: Column) -> Column:
    """Flat struct of an externally tagged style such as ``{"Redact": {...}}``."""
    tree = F.try_parse_json(style)
    kind = F.get(F.json_object_keys(style), F.lit(0))

    def pick(field: str, kind_type: str) -> Column:
        owners = [k for k, fields in STYLE_FIELDS.items() if field in fields]
        return F.coalesce(*[F.try_variant_get(tree, f"$.{owner}.{field}", kind_type) for owner in owners])

    return F.struct(
        F.when(kind.isin(*STYLE_FIELDS), kind).alias("kind"),
        pick("color", "string").alias("color"),
        pick("thickness", "double").alias("thickness"),
        pick("fill", "boolean").alias("fill"),
        F.coalesce(pick("text", "string"), pick("comment", "string")).alias("text"),
        pick("font_size", "int").alias("font_size"),
    )


def style_to_json(kind: Column, columns: dict[str, Column]) -> Column:
    """The tagged JSON text of a flat style row."""
    out = None
    for name, fields in STYLE_FIELDS.items():
        body = F.struct(*[columns[STYLE_COLUMNS.get(f, f)].alias(f) for f in fields])
        text = F.to_json(F.struct(body.alias(name)))
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out


def session_entry(entry: Column) -> Column:
    """A saved tab: a bare JSON string (path only) or a full object."""
    tree = F.try_parse_json(entry)
    bare = F.schema_of_variant(tree) == "STRING"

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(tree, f"$.{name}", kind)

    return F.struct(
        F.when(bare, F.try_variant_get(tree, "$", "string")).otherwise(field("path", "string")).alias("path"),
        field("current_page", "int").alias("current_page"),
        field("zoom", "double").alias("zoom"),
        field("viewport_y", "double").alias("viewport_y"),
        field("rotation", "int").alias("rotation"),
        field("auto_crop", "boolean").alias("auto_crop"),
    )


def trust_status(kind: Column, names: Column, message: Column) -> Column:
    """Chain verdict as text; a NULL kind means there was nothing to check."""
    return (
        F.when(kind.isNull(), F.lit("No CMS contents"))
        .when(kind == "trusted", F.concat(F.lit("Trusted: "), F.array_join(names, " -> ")))
        .when(kind == "untrusted", F.concat(F.lit("Untrusted: "), message))
        .otherwise(F.concat(F.lit("Unsupported: "), message))
    )
