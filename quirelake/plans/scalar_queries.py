"""Registered queries over the scalar functions (inventory 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import color, dates, geometry, protect, records, text
from quirelake.operators import markup, search
from quirelake.plans.inputs import boxes, clicks, html_pages, marks, pixels, table, turns, with_inputs
from quirelake.plans.registry import query


@query("X1_html_escape", """
    SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("X2_page_block", with_inputs("turns") + """
    SELECT doc_id, page,
           '## Page ' || (page + 1) || chr(10) || chr(10) || text || chr(10) || chr(10) AS md,
           '<section><h2>Page ' || (page + 1) || '</h2><pre>'
             || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></section>' || chr(10) AS html,
           '--- Page ' || (page + 1) || ' ---' || chr(10) || chr(10) || text || chr(10) || chr(10) AS txt
    FROM turns""")
def _(spark, folder):
    blocks = [text.page_block(F.col("text"), F.col("page"), fmt).alias(fmt) for fmt in ("md", "html", "txt")]
    return turns(spark, folder).select("doc_id", "page", *blocks)


@query("X3_fill_placeholders", with_inputs("turns") + """
    SELECT doc_id, page, label || ' ' || (page + 1) || ' of ' || doc_id || ' {other}' AS caption FROM turns""")
def _(spark, folder):
    fmt = F.concat(F.col("label"), F.lit(" {page} of {pages} {other}"))
    return turns(spark, folder).select(
        "doc_id", "page", text.fill_placeholders(fmt, F.col("page") + 1, F.col("doc_id")).alias("caption")
    )


@query("X4_file_names", r"""
    SELECT page_id, name, stem, regexp_extract(url, '^(.*/)[^/]+/*$', 1) || stem || '_signed.pdf' AS signed
    FROM (SELECT page_id, url, name, regexp_replace(name, '(?s)^(.+)\.[^.]*$', '\1') AS stem
          FROM (SELECT page_id, url, regexp_extract(url, '([^/]+)/*$', 1) AS name FROM pages))""")
def _(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", text.file_name(url).alias("name"), text.file_stem(url).alias("stem"),
        text.suffix_name(url, "signed").alias("signed"),
    )


@query("X5_dehyphenate", r"""
    SELECT doc_id, regexp_replace(replace(text, 'en ', 'en-' || chr(10)), '([a-z])-\n([a-z])', '\1\2', 'g') AS text
    FROM documents""")
def _(spark, folder):
    broken = F.replace("text", F.lit("en "), F.lit("en-\n"))
    return table(spark, folder, "documents").select("doc_id", text.dehyphenate(broken).alias("text"))


@query("X6_flip_y", with_inputs("boxes") + "SELECT box_id, 792.0::DOUBLE - y - height AS file_y, y AS screen_y FROM boxes")
def _(spark, folder):
    file_y = geometry.flip_y(F.col("y"), F.col("height"), F.lit(792.0))
    back = geometry.flip_y(F.col("file_y"), F.col("height"), F.lit(792.0))
    return boxes(spark, folder).withColumn("file_y", file_y).select("box_id", "file_y", back.alias("screen_y"))


@query("X7_rotate_box", with_inputs("boxes") + """
    SELECT box_id, CAST((box_id % 4) * 90 AS INTEGER) AS rotation,
           CASE box_id % 4 WHEN 1 THEN 792 - (y + height) WHEN 2 THEN 612 - (x + width) WHEN 3 THEN y ELSE x END AS rx,
           CASE box_id % 4 WHEN 1 THEN x WHEN 2 THEN 792 - (y + height) WHEN 3 THEN 612 - (x + width) ELSE y END AS ry,
           CASE WHEN box_id % 2 = 1 THEN height ELSE width END AS rw,
           CASE WHEN box_id % 2 = 1 THEN width ELSE height END AS rh,
           x AS back_x, y AS back_y, width AS back_w, height AS back_h
    FROM boxes""")
def _(spark, folder):
    size = (F.lit(612.0), F.lit(792.0))
    turned = boxes(spark, folder).withColumn("rotation", ((F.col("box_id") % 4) * 90).cast("int")).withColumn(
        "t", geometry.rotate_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"), *size, F.col("rotation"))
    )
    back = geometry.unrotate_box(F.col("t.x"), F.col("t.y"), F.col("t.width"), F.col("t.height"), *size, F.col("rotation"))
    return turned.withColumn("u", back).selectExpr(
        "box_id", "rotation", "t.x AS rx", "t.y AS ry", "t.width AS rw", "t.height AS rh",
        "u.x AS back_x", "u.y AS back_y", "u.width AS back_w", "u.height AS back_h",
    )


@query("X8_norm_rotation", with_inputs("turns") + """
    SELECT doc_id, page, CAST((((rotation - 90 * page) % 360) + 360) % 360 AS INTEGER) AS rotation FROM turns""")
def _(spark, folder):
    turned = geometry.norm_rotation(F.col("rotation"), -90 * F.col("page")).cast("int")
    return turns(spark, folder).select("doc_id", "page", turned.alias("rotation"))


@query("X9_cells_to_text", """
    SELECT c_custkey,
           q || c_name || ',1' || q || ',' || c_mktsegment || chr(10) || said || ',' || c_nationkey AS csv,
           c_name || ',1' || chr(9) || c_mktsegment || chr(10) || said || chr(9) || c_nationkey AS tsv
    FROM (SELECT *, q || 'say ' || q || q || c_name || q || q || q AS said FROM (SELECT *, chr(34) AS q FROM customer))""")
def _(spark, folder):
    first = F.array(F.concat("c_name", F.lit(",1")), F.col("c_mktsegment"))
    second = F.array(F.concat(F.lit('say "'), F.col("c_name"), F.lit('"')), F.col("c_nationkey").cast("string"))
    cells = F.array(first, second)
    return table(spark, folder, "customer").select(
        "c_custkey", text.cells_to_csv(cells).alias("csv"), text.cells_to_tsv(cells).alias("tsv")
    )


_HEX = "lower(printf('%06X', CAST((c_custkey * 7919) % 16777216 AS INTEGER)))"


def _digit(expr: str) -> str:
    return f"(strpos('0123456789abcdef', {expr}) - 1)"


_CHANNELS = ", ".join(
    f"""CASE WHEN kind = 'name' THEN NULL
         WHEN kind = 'short' THEN round({_digit(f"substr(hex, {i + 1}, 1)")} * 17 / 255.0, 6)
         ELSE round(({_digit(f"substr(hex, {2 * i + 1}, 1)")} * 16 + {_digit(f"substr(hex, {2 * i + 2}, 1)")}) / 255.0, 6) END AS {c}"""
    for i, c in enumerate("rgb")
)


@query("X10_parse_color", f"""
    SELECT c_custkey, {_CHANNELS}
    FROM (SELECT c_custkey, {_HEX} AS hex,
                 CASE c_mktsegment WHEN 'BUILDING' THEN 'name' WHEN 'MACHINERY' THEN 'short' ELSE 'long' END AS kind
          FROM customer)""")
def _(spark, folder):
    code = F.format_string("%06X", (F.col("c_custkey") * 7919) % 16777216)
    shown = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("red"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit(" #"), F.substring(code, 1, 3), F.lit(" ")))
        .otherwise(code)
    )
    return table(spark, folder, "customer").withColumn("c", color.parse_color(shown)).select(
        "c_custkey", *[F.round(f"c.{c}", 6).alias(c) for c in "rgb"]
    )


@query("X11_format_color", """
    SELECT l_orderkey, l_linenumber,
           printf('#%02X%02X%02X', CAST(floor(l_discount * 255) AS INTEGER), CAST(floor(l_tax * 255) AS INTEGER),
                  CAST(floor(l_quantity / 50 * 255) AS INTEGER)) AS cut,
           printf('#%02X%02X%02X', CAST(floor(l_discount * 255 + 0.5) AS INTEGER), CAST(floor(l_tax * 255 + 0.5) AS INTEGER),
                  CAST(floor(l_quantity / 50 * 255 + 0.5) AS INTEGER)) AS rounded
    FROM lineitem""")
def _(spark, folder):
    rgb = (F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        color.format_color(*rgb).alias("cut"), color.format_color(*rgb, mode="round").alias("rounded"),
    )


@query("X12_cmyk", """
    SELECT l_orderkey, l_linenumber, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b,
           round(CASE WHEN top <= 0 THEN 0 ELSE (top - r) / top END, 6) AS c,
           round(CASE WHEN top <= 0 THEN 0 ELSE (top - g) / top END, 6) AS m,
           round(CASE WHEN top <= 0 THEN 0 ELSE (top - b) / top END, 6) AS y,
           round(1 - top, 6) AS k
    FROM (SELECT *, greatest(r, g, b) AS top
          FROM (SELECT l_orderkey, l_linenumber, (1 - l_discount) * (1 - k) AS r, (1 - l_tax) * (1 - k) AS g,
                       (1 - l_quantity / 50) * (1 - k) AS b
                FROM (SELECT *, (l_linenumber - 1) / 6.0::DOUBLE AS k FROM lineitem)))""")
def _(spark, folder):
    k = (F.col("l_linenumber") - 1) / F.lit(6.0)
    rgb = color.cmyk_to_rgb(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, k)
    both = table(spark, folder, "lineitem").withColumn("p", rgb)
    back = color.rgb_to_cmyk(F.col("p.r"), F.col("p.g"), F.col("p.b"))
    return both.withColumn("q", back).select(
        "l_orderkey", "l_linenumber",
        *[F.round(f"p.{c}", 6).alias(c) for c in "rgb"], *[F.round(f"q.{c}", 6).alias(c) for c in "cmyk"],
    )


_SHADES = {
    "inverted": "255 - {v}",
    "eco": "CASE WHEN mean > 200 THEN 255 ELSE {v} END",
    "black_white": "CASE WHEN mean > 128 THEN 255 ELSE 0 END",
    "lighten": "least({v} + 20, 255)",
    "no_shadow": "CASE WHEN r > 230 AND g > 230 AND b > 230 THEN 255 ELSE {v} END",
    "grayscale": "(r * 299 + g * 587 + b * 114) // 1000",
    "none": "{v}",
}
_TONES = {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}
_SEPIA = ", ".join(
    f"CAST(floor(least(CAST(r AS FLOAT) * CAST({a} AS FLOAT) + CAST(g AS FLOAT) * CAST({b} AS FLOAT) "
    f"+ CAST(b AS FLOAT) * CAST({c} AS FLOAT), CAST(255 AS FLOAT))) AS INTEGER) AS sepia_{v}"
    for v, (a, b, c) in _TONES.items()
)


@query("X14_pixel_filters", with_inputs("pixels") + "SELECT page_id, px, py, " + ", ".join(
    f"CAST({rule.format(v=v)} AS INTEGER) AS {name}_{v}" for name, rule in _SHADES.items() for v in "rgb"
) + ", " + _SEPIA + " FROM (SELECT *, (r + g + b) // 3 AS mean FROM pixels)")
def _(spark, folder):
    shaded = pixels(spark, folder)
    names = [*_SHADES, "sepia"]
    for name in names:
        shaded = shaded.withColumn(name, color.apply_filter(name, F.col("r"), F.col("g"), F.col("b")))
    return shaded.select("page_id", "px", "py", *[F.col(f"{n}.{v}").alias(f"{n}_{v}") for n in names for v in "rgb"])


@query("X15_fit_scale", """
    SELECT p_partkey, round(least(1.0, 1600.0 / greatest(p_size * 100, p_retailprice)), 6) AS scale,
           round(least(160.0 / greatest(p_retailprice, 1.0), 5.0), 6) AS thumbnail FROM part""")
def _(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.round(geometry.fit_scale(F.col("p_size") * 100, F.col("p_retailprice")), 6).alias("scale"),
        F.round(geometry.thumbnail_scale(F.col("p_retailprice")), 6).alias("thumbnail"),
    )


@query("X16_time_ago", with_inputs("clicks") + """
    SELECT event_id, CASE
        WHEN event_type IN ('error', 'signup') THEN 'unknown'
        WHEN age >= 2592000 THEN strftime(make_timestamp(since * 1000000), '%b %d, %Y')
        WHEN age >= 604800 THEN (age // 604800) || CASE WHEN age // 604800 = 1 THEN ' week ago' ELSE ' weeks ago' END
        WHEN age >= 86400 THEN (age // 86400) || CASE WHEN age // 86400 = 1 THEN ' day ago' ELSE ' days ago' END
        WHEN age >= 3600 THEN (age // 3600) || CASE WHEN age // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
        WHEN age >= 60 THEN (age // 60) || CASE WHEN age // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END
        WHEN age >= 1 THEN age || CASE WHEN age = 1 THEN ' second ago' ELSE ' seconds ago' END
        ELSE 'just now' END AS age
    FROM (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS since,
                 CAST(floor(value * value * value * k) AS BIGINT) AS age FROM clicks)""")
def _(spark, folder):
    at = F.unix_timestamp("ts")
    age = F.floor(F.col("value") * F.col("value") * F.col("value") * F.col("k"))
    now = F.when(F.col("event_type") == "error", at - 10).otherwise(at + age)
    known = F.when(F.col("event_type") != "signup", at)
    return clicks(spark, folder).select("event_id", dates.time_ago(known, now).alias("age"))


@query("X17_parse_doc_date", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'none'
           WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
           ELSE strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS parsed
    FROM orders""")
def _(spark, folder):
    raw = (
        F.when(F.col("o_orderstatus") == "P", F.lit("about noon"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+02'00'")))
    )
    shown = F.date_format(dates.parse_doc_date(raw), "yyyy-MM-dd HH:mm:ss")
    return table(spark, folder, "orders").select("o_orderkey", F.coalesce(shown, F.lit("none")).alias("parsed"))


@query("X18_merge_metadata", """
    SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE 'untitled' END AS title,
           CASE WHEN lang = 'fr' THEN lang ELSE lang || ', ' || source END AS author,
           CASE WHEN n_chars > 1000 THEN 'long' ELSE source || ', ' || lang END AS subject,
           CASE WHEN n_chars > 1000 THEN lang ELSE 'none' END AS keywords,
           'tool' AS creator, source AS producer, 'D:2024' AS creation_date, coalesce(NULL, 'n/a') AS modification_date
    FROM documents""")
def _(spark, folder):
    none = F.lit(None).cast("string")
    long = F.col("n_chars") > 1000
    primary = F.struct(
        F.when(F.col("lang") == "en", F.col("source")).alias("title"),
        F.when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("creators"),
        F.when(long, F.lit("long")).alias("description"),
        F.array("source", "lang").alias("subjects"),
        F.when(long, F.col("lang")).alias("keywords"),
        none.alias("creator_tool"), F.col("source").alias("producer"), F.lit("D:2024").alias("create_date"),
        none.alias("modify_date"),
    )
    plain = {
        "title": F.lit("untitled"), "author": F.col("lang"), "subject": none, "keywords": F.lit("none"),
        "creator": F.lit("tool"), "producer": none, "creation_date": none, "modification_date": F.lit("n/a"),
    }
    fallback = F.struct(*[c.alias(n) for n, c in plain.items()])
    return table(spark, folder, "documents").withColumns({"p": primary, "f": fallback}).withColumn(
        "m", records.merge_metadata(F.col("p"), F.col("f"))
    ).select("doc_id", "m.*")


@query("X19_geo", """
    SELECT c_custkey,
           CASE WHEN c_nationkey < 8 THEN 'zone ' || c_nationkey WHEN c_nationkey < 16 THEN 'EPSG:' || (4000 + c_nationkey)
                ELSE 'GEO' END AS name,
           CASE WHEN c_nationkey < 8 THEN 'map ' || c_mktsegment ELSE 'none' END AS projection,
           CASE WHEN c_nationkey < 16 THEN 'KM' ELSE 'M' END AS unit
    FROM customer""")
def _(spark, folder):
    nation = F.col("c_nationkey")
    wkt = F.when(nation < 8, F.concat(
        F.lit('PROJCS["zone '), nation.cast("string"), F.lit('",GEOGCS["x"],PROJECTION["map '), F.col("c_mktsegment"), F.lit('"]]')
    ))
    epsg = F.when(nation < 16, 4000 + nation)
    unit = records.geo_unit(F.when(nation < 16, F.lit("KM")), F.lit("M"))
    return table(spark, folder, "customer").select(
        "c_custkey", records.geo_name(wkt, epsg, F.lit("GEO")).alias("name"),
        F.coalesce(records.geo_projection(wkt), F.lit("none")).alias("projection"), unit.alias("unit"),
    )


_OPTIONS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")


@query("X20_options", """
    SELECT c_custkey, CAST(coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
           WHEN 'MACHINERY' THEN 3 END, -1) AS INTEGER) AS place,
           CASE c_nationkey WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'MACHINERY'
           ELSE '' END AS label
    FROM customer""")
def _(spark, folder):
    options = F.array(*[F.lit(o) for o in _OPTIONS])
    return table(spark, folder, "customer").select(
        "c_custkey", F.coalesce(records.option_index(options, F.col("c_mktsegment")), F.lit(-1)).alias("place"),
        records.option_label(options, F.col("c_nationkey")).alias("label"),
    )


@query("X21_field_values", """
    SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN CASE WHEN (c_nationkey & 4) <> 0 THEN 'radio' ELSE 'checkbox' END
                           WHEN c_nationkey < 15 THEN 'choice' ELSE 'text' END AS kind,
           CASE WHEN c_nationkey < 10 THEN CASE WHEN c_mktsegment <> 'BUILDING' THEN 'Yes' ELSE 'Off' END
                WHEN c_nationkey < 15 THEN CASE WHEN c_nationkey - 10 < 4 THEN list_extract(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY'], c_nationkey - 9) ELSE '' END
                ELSE c_name END AS value
    FROM customer""")
def _(spark, folder):
    nation = F.col("c_nationkey")
    state = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Off")).otherwise(F.col("c_mktsegment"))
    kind = F.when(nation < 10, records.button_kind(nation * 8192)).when(nation < 15, F.lit("choice")).otherwise(F.lit("text"))
    options = F.array(*[F.lit(o) for o in _OPTIONS])
    return table(spark, folder, "customer").withColumn("kind", kind).select(
        "c_custkey", "kind",
        records.field_value_text(F.col("kind"), F.col("c_name"), records.field_checked(state), options, nation - 10).alias("value"),
    )


@query("X22_style_json", with_inputs("marks") + """
    SELECT ann_id, kind, color, coalesce(thickness, -1) AS thickness, coalesce(fill, false) AS fill,
           coalesce(text, '') AS text, coalesce(font_size, -1) AS font_size,
           CASE kind WHEN 'Highlight' THEN '{"Highlight":{"color":"#FFFF00"}}'
                WHEN 'Rectangle' THEN '{"Rectangle":{"color":"#FFFF00","thickness":2.0,"fill":true}}'
                WHEN 'Redact' THEN '{"Redact":{"color":"#FFFF00"}}'
                WHEN 'Text' THEN '{"Text":{"text":"' || text || '","color":"#FFFF00","font_size":12}}'
                WHEN 'StickyNote' THEN '{"StickyNote":{"comment":"' || text || '","color":"#FFFF00"}}' END AS style
    FROM marks""")
def _(spark, folder):
    flat = marks(spark, folder)
    columns = {c: F.col(c) for c in ("color", "thickness", "fill", "text", "font_size")}
    return (
        flat.select("ann_id", records.style_to_json(F.col("kind"), columns).alias("style"))
        .withColumn("s", records.style_from_json(F.col("style")))
        .select(
            "ann_id", "s.kind", "s.color", F.coalesce("s.thickness", F.lit(-1.0)).alias("thickness"),
            F.coalesce("s.fill", F.lit(False)).alias("fill"), F.coalesce("s.text", F.lit("")).alias("text"),
            F.coalesce("s.font_size", F.lit(-1)).alias("font_size"), "style",
        )
    )


@query("X23_session_entry", with_inputs("clicks") + """
    SELECT event_id, 'doc_' || k AS path, CASE WHEN event_type = 'click' THEN -1 ELSE k END AS current_page,
           CASE WHEN event_type = 'click' THEN -1 ELSE 1.5 END::DOUBLE AS zoom FROM clicks""")
def _(spark, folder):
    name = F.concat(F.lit("doc_"), F.col("k").cast("string"))
    full = F.to_json(F.struct(name.alias("path"), F.col("k").alias("current_page"), F.lit(1.5).alias("zoom")))
    entry = F.when(F.col("event_type") == "click", F.concat(F.lit('"'), name, F.lit('"'))).otherwise(full)
    return clicks(spark, folder).select("event_id", records.session_entry(entry).alias("s")).select(
        "event_id", "s.path", F.coalesce("s.current_page", F.lit(-1)).alias("current_page"),
        F.coalesce("s.zoom", F.lit(-1.0)).alias("zoom"),
    )


@query("X24_page_label", with_inputs("turns") + """
    SELECT doc_id, page, CASE WHEN label = 'user' THEN CAST(page + 1 AS VARCHAR) ELSE label END AS label FROM turns""")
def _(spark, folder):
    printed = F.when(F.col("label") != "user", F.col("label"))
    return turns(spark, folder).select("doc_id", "page", text.page_label(printed, F.col("page")).alias("label"))


@query("X25_context_snippet", """
    SELECT doc_id, CAST(hit - 1 AS INTEGER) AS pos, CASE WHEN hit > 21 THEN '...' ELSE '' END
           || substr(text, CAST(greatest(hit - 20, 1) AS BIGINT), CAST(hit + 22 - greatest(hit - 20, 1) AS BIGINT))
           || CASE WHEN hit + 21 < length(text) THEN '...' ELSE '' END AS snippet
    FROM (SELECT doc_id, text, unnest(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'en')) AS hit
          FROM documents WHERE contains(text, 'en'))""")
def _(spark, folder):
    whole = table(spark, folder, "documents").select("doc_id", F.lit(0).alias("page"), "text")
    return search.search_snippets(whole, "en", case_sensitive=True).select("doc_id", "pos", "snippet")


@query("X26_encrypt_round_trip", "SELECT doc_id, text, true AS hidden, true AS wrong_key_is_null FROM documents")
def _(spark, folder):
    right, wrong = F.lit("0123456789abcdef0123456789abcdef"), F.lit("fedcba9876543210fedcba9876543210")
    locked = table(spark, folder, "documents").withColumn("locked", protect.encrypt_column(F.col("text"), right))
    return locked.select(
        "doc_id", protect.decrypt_column(F.col("locked"), right).alias("text"),
        (F.col("locked") != F.col("text").cast("binary")).alias("hidden"),
        protect.decrypt_column(F.col("locked"), wrong).isNull().alias("wrong_key_is_null"),
    )


@query("X27_stamp_color", with_inputs("clicks") + """
    SELECT event_id, label,
           CASE label WHEN 'APPROVED' THEN 0.0 WHEN 'REJECTED' THEN 0.8 WHEN 'CONFIDENTIAL' THEN 0.6 WHEN 'DRAFT' THEN 0.8 ELSE 0.0 END::DOUBLE AS r,
           CASE label WHEN 'APPROVED' THEN 0.5 WHEN 'DRAFT' THEN 0.4 ELSE 0.0 END::DOUBLE AS g,
           CASE label WHEN 'CONFIDENTIAL' THEN 0.6 WHEN 'FINAL' THEN 0.8 ELSE 0.0 END::DOUBLE AS b
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED'
                 WHEN 'signup' THEN 'CONFIDENTIAL' WHEN 'view' THEN 'DRAFT' ELSE 'FINAL' END AS label FROM clicks)""")
def _(spark, folder):
    kind = F.col("event_type")
    label = (
        F.when(kind == "click", F.lit("APPROVED")).when(kind == "error", F.lit("REJECTED"))
        .when(kind == "signup", F.lit("CONFIDENTIAL")).when(kind == "view", F.lit("DRAFT")).otherwise(F.lit("FINAL"))
    )
    return clicks(spark, folder).select("event_id", label.alias("label")).withColumn(
        "c", color.stamp_color(F.col("label"))
    ).select("event_id", "label", "c.*")


@query("X28_trust_status", """
    SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'No CMS contents'
           WHEN c_mktsegment = 'BUILDING' THEN 'Trusted: ' || c_name || ' -> Root'
           WHEN c_mktsegment = 'MACHINERY' THEN 'Untrusted: ' || c_name ELSE 'Unsupported: ' || c_name END AS status
    FROM customer""")
def _(spark, folder):
    kind = F.when(F.col("c_nationkey") >= 5, (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("trusted"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("untrusted")).otherwise(F.lit("unsupported"))
    ))
    return table(spark, folder, "customer").select(
        "c_custkey", records.trust_status(kind, F.array(F.col("c_name"), F.lit("Root")), F.col("c_name")).alias("status")
    )


@query("X29_markup_documents", with_inputs("shown_pages") + r"""
    SELECT doc_id, url AS path, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
           regexp_replace(regexp_extract(html, '(?is)<html[^>]*\slang\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS language FROM shown_pages""")
def _(spark, folder):
    return markup.markup_documents(html_pages(spark, folder)).select(
        "doc_id", "path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("language", F.lit("")).alias("language")
    )


@query("X29_markup_headings", with_inputs("shown_pages") + r"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal, CAST(substr(h, 3, 1) AS INTEGER) AS level,
           regexp_replace(h, '(?is)<[^>]*>', '', 'g') AS title
    FROM (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS hs FROM shown_pages))""")
def _(spark, folder):
    return markup.markup_headings(html_pages(spark, folder))


_LINKS = r"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS link_no, regexp_replace(regexp_extract(a, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS url
    FROM (SELECT doc_id, unnest(xs) AS a, generate_subscripts(xs, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(html, '(?is)<a\s[^>]*>') AS xs FROM shown_pages))"""


@query("X29_markup_links", with_inputs("shown_pages") + f"""
    SELECT doc_id, link_no, CASE WHEN url LIKE '#%' THEN '' ELSE url END AS url,
           CASE WHEN url LIKE '#%' THEN 0 ELSE -1 END AS destination_page FROM ({_LINKS})""")
def _(spark, folder):
    return markup.markup_links(html_pages(spark, folder)).select(
        "doc_id", "link_no", F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("destination_page", F.lit(-1)).alias("destination_page"),
    )


@query("P2_usable_links", with_inputs("shown_pages") + f"SELECT doc_id, link_no FROM ({_LINKS}) WHERE url <> ''")
def _(spark, folder):
    links = markup.markup_links(html_pages(spark, folder)).withColumn("url", F.nullif("url", F.lit("")))
    return markup.usable_links(links).select("doc_id", "link_no")


@query("P3_safe_links", with_inputs("shown_pages") + f"""
    SELECT doc_id, link_no, url, CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' OR lower(url) LIKE 'mailto:%'
           THEN 'external' WHEN url LIKE '#%' THEN 'internal' ELSE 'blocked' END AS action
    FROM (SELECT doc_id, -1 AS link_no, url FROM shown_pages UNION ALL ({_LINKS}))""")
def _(spark, folder):
    html = html_pages(spark, folder)
    links = markup.markup_links(html).unionByName(
        html.select("doc_id", F.lit(-1).alias("link_no"), "url"), allowMissingColumns=True
    )
    return markup.safe_links(links).select("doc_id", "link_no", F.coalesce("url", F.lit("")).alias("url"), "action")
