"""Registered queries over layout, search, spatial and page operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions.text import WHITESPACE
from quirelake.operators import annotations, layout, overlays, pages, search, spatial, tables
from quirelake.plans.inputs import (
    SPACE, boxes, clicks, marks, pixels, sheets, table, turn_words, turns, with_inputs,
)
from quirelake.plans.registry import query
from quirelake.sources.sinks import export_tables


# --- layout -----------------------------------------------------------------

@query("X13_layout_words", with_inputs("turn_words") + "SELECT * FROM turn_words")
def _(spark, folder):
    return turn_words(spark, folder)


@query("X13_layout_words_documents", with_inputs("sheet_words") + """
    SELECT doc_id, page, COUNT(*) AS words, CAST(SUM(x) AS DOUBLE) AS x, CAST(SUM(y) AS DOUBLE) AS y,
           CAST(SUM(width) AS DOUBLE) AS width FROM sheet_words GROUP BY ALL""")
def _(spark, folder):
    words = layout.layout_words(sheets(spark, folder))
    return words.groupBy("doc_id", "page").agg(
        F.count("*").alias("words"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("width").alias("width")
    )


_TURN_LINES = rf"""
    SELECT doc_id, page, CAST(i - 1 AS INTEGER) AS line_no, height,
           regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS text
    FROM (SELECT doc_id, page, height, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM turns)"""


@query("X13_layout_lines", with_inputs("turns", "turn_words") + f"""
    SELECT l.doc_id, l.page, l.line_no, l.text, 50.0::DOUBLE AS x0, l.height - 40 - 18.0 * l.line_no AS y0,
           w.x1, l.height - 28 - 18.0 * l.line_no AS y1, w.words
    FROM ({_TURN_LINES}) l JOIN (
        SELECT doc_id, page, line_no, max_by(x + width, word_no) AS x1, CAST(COUNT(*) AS INTEGER) AS words
        FROM turn_words GROUP BY ALL) w USING (doc_id, page, line_no)
    WHERE l.text <> ''""")
def _(spark, folder):
    lines = layout.layout_lines(turns(spark, folder))
    sides = [F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return lines.select("doc_id", "page", "line_no", "text", *sides, F.size("words").alias("words"))


@query("P5_drop_blank_words", with_inputs("turns") + f"SELECT doc_id, page, line_no, text FROM ({_TURN_LINES}) WHERE text <> ''")
def _(spark, folder):
    whole = turns(spark, folder).select(
        "doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    )
    kept = layout.drop_blank_words(whole)
    return kept.select("doc_id", "page", "line_no", F.regexp_replace("text", f"^{WHITESPACE}+|{WHITESPACE}+$", "").alias("text"))


@query("W5_span_offsets", with_inputs("turn_words") + """
    SELECT doc_id, page, word_no, CAST(e - length(text) AS BIGINT) AS start, CAST(e AS BIGINT) AS end
    FROM (SELECT *, SUM(length(text)) OVER (PARTITION BY doc_id, page ORDER BY word_no) AS e FROM turn_words)""")
def _(spark, folder):
    return layout.span_offsets(turn_words(spark, folder)).select("doc_id", "page", "word_no", "start", "end")


@query("W6_group_lines", "WITH RECURSIVE " + with_inputs("turn_words")[5:] + """,
    tight AS (SELECT doc_id, page, word_no, text, x, y / 6 AS y FROM turn_words),
    ys AS (SELECT DISTINCT doc_id, page, y FROM tight),
    following AS (SELECT a.doc_id, a.page, a.y, MIN(b.y) AS y2 FROM ys a
                  JOIN ys b ON a.doc_id = b.doc_id AND a.page = b.page AND b.y >= a.y + 5 GROUP BY ALL),
    anchors AS (SELECT doc_id, page, MIN(y) AS y FROM ys GROUP BY ALL
                UNION ALL SELECT f.doc_id, f.page, f.y2 FROM anchors a JOIN following f USING (doc_id, page, y)),
    placed AS (SELECT t.doc_id, t.page, t.word_no, t.text, t.x, COUNT(*) - 1 AS line_no
               FROM tight t JOIN anchors a ON t.doc_id = a.doc_id AND t.page = a.page AND a.y <= t.y GROUP BY ALL)
    SELECT doc_id, page, CAST(line_no AS INTEGER) AS line_no, string_agg(text, ' ' ORDER BY x, word_no) AS text
    FROM placed GROUP BY ALL""")
def _(spark, folder):
    tight = turn_words(spark, folder).withColumn("y", F.col("y") / 6)
    return layout.group_lines(tight)


PAGE_TEXT = f"""
    SELECT doc_id, page, 0 AS part, string_agg(text, chr(10) ORDER BY line_no) AS text
    FROM (SELECT doc_id, page, line_no, regexp_replace(text, '{SPACE}+', ' ', 'g') AS text FROM ({_TURN_LINES}))
    WHERE text <> '' GROUP BY doc_id, page"""


@query("T2_geometric_text", with_inputs("turns") + PAGE_TEXT)
def _(spark, folder):
    return layout.geometric_text(turn_words(spark, folder))


@query("A7_page_text", with_inputs("turns") + f"""
    SELECT doc_id, page, 0 AS part, string_agg(text, chr(10) ORDER BY line_no) AS text
    FROM ({_TURN_LINES}) WHERE text <> '' GROUP BY doc_id, page""")
def _(spark, folder):
    return layout.page_text(layout.layout_lines(turns(spark, folder)))


@query("J14_structure_order", with_inputs("turns", "turn_words") + """
    SELECT w.doc_id, w.page, w.word_no, t.label = 'assistant' AS tagged,
           CASE WHEN t.label = 'assistant' THEN 100000 - w.word_no ELSE w.word_no END AS reading_order
    FROM turn_words w JOIN turns t USING (doc_id, page)""")
def _(spark, folder):
    replies = layout.layout_words(turns(spark, folder).filter("label = 'assistant'"))
    tree = replies.select("doc_id", "page", "word_no", (100000 - F.col("word_no")).alias("struct_ord"))
    ordered = layout.structure_order(turn_words(spark, folder), tree)
    return ordered.select("doc_id", "page", "word_no", "tagged", "reading_order")


# --- search -----------------------------------------------------------------

def _hits(source: str, needle: str, fold: bool = True) -> str:
    text = "lower(text)" if fold else "text"
    n = len(needle)
    return f"""
    SELECT doc_id, page, CAST(p - 1 AS INTEGER) AS pos, substr(text, p, {n}) AS text
    FROM (SELECT doc_id, page, text, unnest(list_filter(range(1, length(text) - {n} + 2), lambda i: substr(seen, i, {n}) = '{needle}')) AS p
          FROM (SELECT *, {text} AS seen FROM {source} WHERE contains({text}, '{needle}')))"""


@query("A0_search", with_inputs("sheets") + _hits("sheets", "en"))
def _(spark, folder):
    return search.search(sheets(spark, folder), "En")


@query("A0_search_case_sensitive", with_inputs("turns") + _hits("turns", "En", fold=False))
def _(spark, folder):
    return search.search(turns(spark, folder), "En", case_sensitive=True)


@query("A0_search_overlapping", "WITH whole AS (SELECT doc_id, 0 AS page, text FROM documents)" + _hits("whole", "erer"))
def _(spark, folder):
    whole = table(spark, folder, "documents").select("doc_id", F.lit(0).alias("page"), "text")
    return search.search(whole, "erer")


@query("A1_search_counts", with_inputs("sheets") + f"SELECT doc_id, COUNT(*) AS hits FROM ({_hits('sheets', 'en')}) GROUP BY doc_id")
def _(spark, folder):
    return search.search_counts(search.search(sheets(spark, folder), "en"))


def _queries(spark, folder):
    """Every word of the benchmark texts as a query, named by itself."""
    words = table(spark, folder, "benchmark").select(F.explode(F.split("text", " ")).alias("query")).distinct()
    return words.select(F.col("query").alias("query_id"), "query")


@query("J13_search_many", with_inputs("turns") + """, wanted AS (
        SELECT query_id, lower(query_id) AS q FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS query_id FROM benchmark))
    SELECT query_id, doc_id, page, CAST(p - 1 AS INTEGER) AS pos, substr(text, p, length(q)) AS text
    FROM (SELECT query_id, q, doc_id, page, text,
                 unnest(list_filter(range(1, length(text) - length(q) + 2), lambda i: substr(seen, i, length(q)) = q)) AS p
          FROM (SELECT *, lower(text) AS seen FROM turns) t JOIN wanted ON q <> '' AND contains(seen, q))""")
def _(spark, folder):
    return search.search_many(turns(spark, folder), _queries(spark, folder))


_SQUEEZED = f"""(SELECT doc_id, page, regexp_replace(text, '{SPACE}+', '', 'g') AS text FROM turns)"""


@query("J4_hit_to_span", with_inputs("turns", "turn_words") + f""",
    spans AS (SELECT *, SUM(length(text)) OVER (PARTITION BY doc_id, page ORDER BY word_no) AS e FROM turn_words)
    SELECT h.doc_id, h.page, h.pos, h.text, s.word_no, s.x, s.y, greatest(s.width, 12.0) AS width, greatest(s.height, 12.0) AS height
    FROM ({_hits(_SQUEEZED, "en")}) h JOIN spans s
      ON h.doc_id = s.doc_id AND h.page = s.page AND h.pos < s.e AND h.pos >= s.e - length(s.text)""")
def _(spark, folder):
    squeezed = turns(spark, folder).withColumn("text", F.regexp_replace("text", f"{WHITESPACE}+", ""))
    spans = layout.span_offsets(turn_words(spark, folder))
    return search.hit_to_span(search.search(squeezed, "en"), spans)


_NUMBERED = f"""
    SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS hit_no,
           COUNT(*) OVER (PARTITION BY doc_id) AS n FROM ({_hits("turns", "en")})"""


def _numbered(spark, folder):
    return search.number_hits(search.search(turns(spark, folder), "en"))


@query("W10_number_hits", with_inputs("turns") + f"SELECT doc_id, page, pos, hit_no FROM ({_NUMBERED})")
def _(spark, folder):
    return _numbered(spark, folder).select("doc_id", "page", "pos", "hit_no")


@query("W3_next_prev_hit", with_inputs("turns") + f""", h AS ({_NUMBERED})
    SELECT a.doc_id, a.hit_no, a.page, a.pos, b.page AS next_page, b.pos AS next_pos, c.page AS prev_page, c.pos AS prev_pos
    FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.hit_no = (a.hit_no + 1) % a.n
             JOIN h c ON a.doc_id = c.doc_id AND c.hit_no = (a.hit_no + a.n - 1) % a.n""")
def _(spark, folder):
    return search.next_prev_hit(_numbered(spark, folder))


@query("T4_paged_hits", with_inputs("turns") + f"SELECT doc_id, page, pos, hit_no FROM ({_NUMBERED}) WHERE hit_no >= 10 AND hit_no < 15")
def _(spark, folder):
    return search.paged_hits(_numbered(spark, folder), 10, 5).select("doc_id", "page", "pos", "hit_no")


@query("T1_fuzzy_find", r"""
    SELECT id, title, CAST(-spans AS INTEGER) AS score
    FROM (SELECT p_partkey AS id, p_name AS title,
                 list_min(list_filter(list_transform(range(1, length(seen) + 1),
                     lambda i: length(regexp_extract(substr(seen, i), '^r.*?w.*?g.*?t'))), lambda n: n > 0)) AS spans
          FROM (SELECT *, lower(p_name || ' ' || p_type || ' ' || p_brand) AS seen FROM part))
    WHERE spans IS NOT NULL ORDER BY score DESC, id LIMIT 20""")
def _(spark, folder):
    titles = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("subtitle"),
    )
    return search.fuzzy_find(titles, " RWGT ", 20).select("id", "title", "score")


# --- spatial ----------------------------------------------------------------

_SELECTED = """
    SELECT w.*, b.box_id FROM turn_words w JOIN boxes b ON w.doc_id = b.doc_id AND w.page = b.page
     AND b.x < w.x + w.width AND b.x + b.width > w.x AND b.y < w.y + w.height AND b.y + b.height > w.y"""


@query("J2_words_in_box", with_inputs("turn_words", "boxes") + f"SELECT doc_id, page, word_no, text, box_id FROM ({_SELECTED})")
def _(spark, folder):
    selected = spatial.words_in_box(turn_words(spark, folder), boxes(spark, folder))
    return selected.select("doc_id", "page", "word_no", "text", "box_id")


@query("J3_redact", with_inputs("turn_words", "boxes") + f"""
    SELECT doc_id, page, word_no, text FROM turn_words
    WHERE (doc_id, page, word_no) NOT IN (SELECT (doc_id, page, word_no) FROM ({_SELECTED}))""")
def _(spark, folder):
    return spatial.redact(turn_words(spark, folder), boxes(spark, folder)).select("doc_id", "page", "word_no", "text")


@query("J3_redaction_audit", with_inputs("turn_words", "boxes") + f"SELECT DISTINCT doc_id, page, word_no, text FROM ({_SELECTED})")
def _(spark, folder):
    audit = spatial.redaction_audit(turn_words(spark, folder), boxes(spark, folder))
    return audit.select("doc_id", "page", "word_no", "text")


@query("O5_highlights_from_selection", with_inputs("turn_words", "boxes") + f"""
    SELECT doc_id, page, 'Highlight' AS kind, x, y, width, height, '#FFFF00' AS color FROM ({_SELECTED})""")
def _(spark, folder):
    selected = spatial.words_in_box(turn_words(spark, folder), boxes(spark, folder))
    return spatial.highlights_from_selection(selected).select(
        "doc_id", "page", "kind", "x", "y", "width", "height", "color"
    )


@query("A5_boxes_by_page", with_inputs("marks", "turns") + """
    SELECT doc_id, page, ann_id // 1000 AS part,
           string_agg(ann_id || ':' || CAST(x AS INTEGER) || ',' || CAST(h - y - height AS INTEGER) || ','
             || CAST(x + width AS INTEGER) || ',' || CAST(h - y AS INTEGER), ';' ORDER BY ann_id) AS boxes
    FROM (SELECT m.*, coalesce(t.height, 792) AS h FROM marks m LEFT JOIN turns t USING (doc_id, page) WHERE kind = 'Redact')
    GROUP BY doc_id, page, part""")
def _(spark, folder):
    boxed = annotations.to_file_space(annotations.only_redactions(marks(spark, folder)), turns(spark, folder))

    def shown(b):
        sides = [b[n].cast("int").cast("string") for n in ("x0", "y0", "x1", "y1")]
        return F.concat(b["ann_id"].cast("string"), F.lit(":"), F.concat_ws(",", *sides))

    return spatial.boxes_by_page(boxed, 1000).withColumn("boxes", F.array_join(F.transform("boxes", shown), ";"))


@query("A6_content_bbox", with_inputs("pixels") + """
    SELECT page_id, greatest(MIN(px) - 10, 0) AS min_x, greatest(MIN(py) - 10, 0) AS min_y,
           least(MAX(px) + 10, 599) AS max_x, least(MAX(py) + 10, 799) AS max_y
    FROM pixels WHERE r <= 245 OR g <= 245 OR b <= 245 GROUP BY page_id""")
def _(spark, folder):
    return spatial.content_bbox(pixels(spark, folder), 600, 800)


# --- tables -----------------------------------------------------------------

_TABLES = with_inputs("turn_words") + r""",
    placed AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y) - 1 AS line FROM turn_words),
    lines AS (SELECT doc_id, page, line, list(DISTINCT round(x / 5) * 5) AS starts, MIN(x) AS x0, MIN(y) AS y0,
                     MAX(x + width) AS x1, MAX(y + height) AS y1,
                     string_agg(CASE WHEN regexp_matches(text, '[,"\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END,
                                ',' ORDER BY x) AS csv,
                     string_agg(CASE WHEN regexp_matches(text, '[\t"\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END,
                                chr(9) ORDER BY x) AS tsv
              FROM placed GROUP BY ALL),
    cut AS (SELECT *, CASE WHEN len(list_intersect(starts, lag(starts) OVER w)) >= 2 THEN 0 ELSE 1 END AS first
            FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
    runs AS (SELECT *, SUM(first) OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM cut),
    found AS (SELECT doc_id, page, run, COUNT(*) AS line_count, MIN(x0) AS x, MIN(y0) AS y, MAX(x1) - MIN(x0) AS width,
                     MAX(y1) - MIN(y0) AS height, string_agg(csv, chr(10) ORDER BY line) AS csv,
                     string_agg(tsv, chr(10) ORDER BY line) AS tsv, MIN(line) AS top
              FROM runs GROUP BY ALL HAVING COUNT(*) >= 2),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY run) - 1 AS table_no FROM found)"""


@query("A10_detect_tables", _TABLES + """
    SELECT doc_id, page, table_no, 0 AS part, line_count, x, y, width, height, csv, tsv FROM numbered""")
def _(spark, folder):
    return tables.detect_tables(turn_words(spark, folder)).drop("cells")


@query("S6_export_tables", _TABLES + """
    SELECT doc_id, page, table_no, 0 AS part, CAST(line - top AS INTEGER) AS row_no, runs.tsv AS line
    FROM runs JOIN numbered USING (doc_id, page, run)""")
def _(spark, folder):
    return export_tables(tables.detect_tables(turn_words(spark, folder)), "\t")


# --- pages ------------------------------------------------------------------

@query("P1_page_exists", with_inputs("boxes", "turns") + """
    SELECT box_id, CASE WHEN n IS NULL THEN 'DocumentNotFound' WHEN page >= n THEN 'PageNotFound(' || page || ')' ELSE 'ok' END AS error
    FROM boxes LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM turns GROUP BY doc_id) USING (doc_id)""")
def _(spark, folder):
    checked = pages.page_exists(boxes(spark, folder), turns(spark, folder))
    return checked.select("box_id", F.coalesce("error", F.lit("ok")).alias("error"))


@query("P7_on_page", with_inputs("marks") + "SELECT ann_id, doc_id FROM marks WHERE page = 2")
def _(spark, folder):
    return pages.on_page(marks(spark, folder), 2).select("ann_id", "doc_id")


@query("P8_select_pages", with_inputs("sheets") + "SELECT doc_id, page, text FROM sheets WHERE page IN (0, 2, 3, 4, 9)")
def _(spark, folder):
    return pages.select_pages(sheets(spark, folder), "1, 3-5,10").select("doc_id", "page", "text")


@query("P8_select_pages_by_document", with_inputs("turns") + """
    SELECT doc_id, page FROM turns WHERE page = doc_id % 3 OR page BETWEEN 3 AND 5""")
def _(spark, folder):
    document = turns(spark, folder)
    specs = pages.page_counts(document).select(
        "doc_id", F.concat((F.col("doc_id") % 3 + 1).cast("string"), F.lit(", 4-6")).alias("spec")
    )
    return pages.select_pages_by(document, specs).select("doc_id", "page")


@query("A2_document_summary", with_inputs("turns") + "SELECT doc_id, COUNT(*) AS page_count, MAX(width) AS max_width FROM turns GROUP BY doc_id")
def _(spark, folder):
    return pages.document_summary(turns(spark, folder))


@query("A2_page_heights", with_inputs("turns") + """
    SELECT doc_id, 0 AS part, string_agg(CAST(CAST(height AS INTEGER) AS VARCHAR), ',' ORDER BY page) AS heights FROM turns GROUP BY doc_id""")
def _(spark, folder):
    listed = pages.page_heights(turns(spark, folder))
    return listed.withColumn("heights", F.array_join(F.transform("heights", lambda h: h.cast("int").cast("string")), ","))


@query("J5_attach_labels", with_inputs("boxes", "turns") + """
    SELECT box_id, coalesce(label, CAST(page + 1 AS VARCHAR)) AS label FROM boxes LEFT JOIN turns USING (doc_id, page)""")
def _(spark, folder):
    return pages.attach_labels(boxes(spark, folder), turns(spark, folder)).select("box_id", "label")


@query("J6_resolve_page_ref", with_inputs("clicks", "turns") + """
    SELECT event_id, CAST(coalesce(CASE event_type WHEN 'click' THEN first WHEN 'view' THEN first
           WHEN 'error' THEN greatest(k - 1, 0) WHEN 'signup' THEN 7 END, -1) AS BIGINT) AS page
    FROM clicks LEFT JOIN (SELECT doc_id, label, MIN(page) AS first FROM turns GROUP BY ALL) t
      ON user_id = doc_id AND label = CASE event_type WHEN 'click' THEN 'user' ELSE 'assistant' END""")
def _(spark, folder):
    kind = F.col("event_type")
    typed = (
        F.when(kind == "click", F.lit(" User ")).when(kind == "view", F.lit("ASSISTANT"))
        .when(kind == "error", F.col("k").cast("string")).when(kind == "signup", F.lit("  8  ")).otherwise(F.lit("abc"))
    )
    requests = clicks(spark, folder).select("event_id", F.col("user_id").alias("doc_id"), typed.alias("input"))
    found = pages.resolve_page_ref(requests, turns(spark, folder))
    return found.select("event_id", F.coalesce("page", F.lit(-1)).alias("page"))


def backwards(spark, folder):
    """For each document its pages in reverse order."""
    counted = pages.page_counts(turns(spark, folder))
    order = F.sequence((F.col("page_count") - 1).cast("int"), F.lit(0), F.lit(-1))
    return counted.select("doc_id", order.alias("order"))


@query("J12_reorder_pages", with_inputs("turns") + """
    SELECT doc_id, CAST(COUNT(*) OVER (PARTITION BY doc_id) - 1 - page AS INTEGER) AS position, page AS source_page, text, rotation FROM turns""")
def _(spark, folder):
    moved = pages.reorder_pages(turns(spark, folder), backwards(spark, folder))
    return moved.select("doc_id", "position", "source_page", "text", "rotation")


@query("O1_merge_documents", with_inputs("turns") + """
    SELECT doc_id % 10 AS target_id, doc_id, page AS source_page,
           CAST(row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id, page) - 1 AS INTEGER) AS page FROM turns""")
def _(spark, folder):
    document = turns(spark, folder)
    plan = pages.page_counts(document).select(
        (F.col("doc_id") % 10).alias("target_id"), F.floor(F.col("doc_id") / 10).alias("ordinal"), "doc_id"
    )
    return pages.merge_documents(document, plan).select("target_id", "doc_id", "source_page", "page")


@query("W1_page_offsets", with_inputs("turns") + """
    SELECT doc_id, page, coalesce(SUM((height + 20) * 1.5::DOUBLE) OVER (PARTITION BY doc_id ORDER BY page
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset FROM turns""".replace("AS offset", 'AS "offset"'))
def _(spark, folder):
    return pages.page_offsets(turns(spark, folder), zoom=1.5).select("doc_id", "page", "offset")


@query("W2_pages_seen", with_inputs("turns", "clicks") + """,
    stack AS (SELECT doc_id, page, top, top + height AS bottom FROM (
        SELECT *, 30 + coalesce(SUM(height + 20) OVER (PARTITION BY doc_id ORDER BY page
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM turns)),
    views AS (SELECT event_id, user_id, floor(value * 30) AS vy, CASE WHEN k = 0 THEN 2000.0 ELSE k * 10.0 END::DOUBLE AS vh,
                     1.0::DOUBLE + 0.5::DOUBLE * (event_id % 3) AS zoom FROM clicks),
    spans AS (SELECT event_id, user_id, greatest(vy - vh * 0.5::DOUBLE, 0) / zoom AS lo, (vy + vh * 1.5::DOUBLE) / zoom AS hi,
                     (vy + vh * 0.3::DOUBLE) / zoom AS focus FROM views)
    SELECT event_id AS view_id, user_id AS doc_id, coalesce(MIN(page), 0) AS first_page, coalesce(MAX(page) + 1, 0) AS end_page,
           coalesce(MAX(page) FILTER (WHERE focus BETWEEN top AND bottom), 0) AS main_page
    FROM spans LEFT JOIN stack ON user_id = doc_id AND bottom >= lo AND top <= hi GROUP BY event_id, user_id""")
def _(spark, folder):
    views = clicks(spark, folder).select(
        F.col("event_id").alias("view_id"), F.col("user_id").alias("doc_id"),
        F.floor(F.col("value") * 30).alias("viewport_y"), (F.col("k") * 10.0).alias("viewport_height"),
        (1.0 + 0.5 * (F.col("event_id") % 3)).alias("zoom"),
    )
    return pages.pages_seen(views, turns(spark, folder))


@query("W8_page_x_of_y", with_inputs("turns") + """
    SELECT doc_id, page, 'Leaf ' || (page + 1) || ' / ' || COUNT(*) OVER (PARTITION BY doc_id) AS caption FROM turns""")
def _(spark, folder):
    return pages.page_x_of_y(turns(spark, folder), "Leaf {page} / {pages}").select("doc_id", "page", "caption")


@query("W9_delete_page", with_inputs("turns", "marks") + """
    SELECT doc_id, CASE WHEN page > 1 THEN page - 1 ELSE page END AS page, 'page' AS what, rotation::BIGINT AS id FROM turns WHERE page <> 1
    UNION ALL
    SELECT doc_id, CASE WHEN page > 1 THEN page - 1 ELSE page END, 'mark', ann_id FROM marks WHERE page <> 1""")
def _(spark, folder):
    left, kept = pages.delete_page(turns(spark, folder), marks(spark, folder), 1)
    return left.select("doc_id", "page", F.lit("page").alias("what"), F.col("rotation").cast("bigint").alias("id")).unionByName(
        kept.select("doc_id", "page", F.lit("mark").alias("what"), F.col("ann_id").alias("id"))
    )


@query("W9_edit_pages", with_inputs("turns") + """
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page = 3 THEN 0 WHEN page < 3 THEN page + 1 ELSE page + 10 END) - 1 AS INTEGER) AS page,
           page AS source_page, CASE WHEN page < 3 THEN (rotation + 90) % 360 WHEN page = 6 THEN (rotation + 180) % 360 ELSE rotation END AS rotation, text
    FROM turns WHERE page NOT IN (1, 4)""")
def _(spark, folder):
    edited = pages.edit_pages(turns(spark, folder), rotate="1-3:90 7:180", delete="2,5", order="4,1-3")
    return edited.select("doc_id", "page", "source_page", "rotation", "text")


# --- annotations and overlays -------------------------------------------------

@query("P4_user_annotations", with_inputs("clicks") + """
    SELECT event_id AS ann_id,
           CASE event_type WHEN 'click' THEN 'Highlight' WHEN 'view' THEN 'Rectangle' WHEN 'purchase' THEN 'Text'
                WHEN 'signup' THEN CASE WHEN k < 50 THEN 'Arrow' ELSE 'Line' END END AS kind,
           k::DOUBLE AS x, 792 - (k + 20)::DOUBLE - 20 AS y, 30.0::DOUBLE AS width, 20.0::DOUBLE AS height,
           CASE WHEN event_type = 'click' THEN '#7F3FFF' ELSE '#408cff' END AS color,
           CASE WHEN event_type IN ('view', 'signup') THEN 2.0 ELSE -1.0 END::DOUBLE AS thickness,
           CASE WHEN event_type = 'view' THEN CASE WHEN k < 50 THEN 'yes' ELSE 'no' END ELSE 'none' END AS fill,
           CASE WHEN event_type = 'purchase' THEN 'note ' || k ELSE '' END AS text
    FROM clicks WHERE event_type <> 'error' AND k <= 90""")
def _(spark, folder):
    kind, k = F.col("event_type"), F.col("k").cast("double")
    subtype = (
        F.when(kind == "click", F.lit("Highlight")).when(kind == "view", F.lit("Square")).when(kind == "error", F.lit("Link"))
        .when(kind == "purchase", F.lit("FreeText")).otherwise(F.lit("Line"))
    )
    corners = F.array(k, k + 20, k + 30, k)
    raw = clicks(spark, folder).select(
        F.col("event_id").alias("ann_id"), F.col("user_id").alias("doc_id"), (F.col("k") % 8).alias("page"),
        subtype.alias("subtype"),
        F.when(k > 90, F.slice(corners, 1, 3)).otherwise(corners).alias("rect"),
        F.when(kind == "click", F.array(F.lit(0.5), F.lit(0.25), F.lit(1.0))).otherwise(F.array(F.lit(0.5))).alias("color"),
        F.when(kind == "view", k < 50).alias("has_fill"), F.lit(None).cast("double").alias("thickness"),
        F.concat(F.lit("note "), F.col("k").cast("string")).alias("contents"),
        F.when(k < 50, F.array(F.lit("None"), F.lit("OpenArrow"))).alias("endings"),
        F.lit(None).cast("double").alias("page_height"),
    )
    filled = F.when(F.col("fill"), F.lit("yes")).when(~F.col("fill"), F.lit("no")).otherwise(F.lit("none"))
    return annotations.user_annotations(raw).select(
        "ann_id", "kind", "x", "y", "width", "height", "color", F.coalesce("thickness", F.lit(-1.0)).alias("thickness"),
        filled.alias("fill"), F.coalesce("text", F.lit("")).alias("text"),
    )


@query("P6_without_redactions", with_inputs("marks") + """
    SELECT ann_id, 'kept' AS what FROM marks WHERE kind <> 'Redact'
    UNION ALL SELECT ann_id, 'redaction' FROM marks WHERE kind = 'Redact'""")
def _(spark, folder):
    every = marks(spark, folder)
    kept = annotations.without_redactions(every).select("ann_id", F.lit("kept").alias("what"))
    return kept.unionByName(annotations.only_redactions(every).select("ann_id", F.lit("redaction").alias("what")))


@query("P10_marks_from_spec", with_inputs("clicks") + """
    SELECT event_id, kind,
           CASE WHEN kind IN ('Line', 'Text', 'StickyNote') THEN value ELSE least(value, k) END AS x,
           CASE WHEN kind IN ('Line', 'Text', 'StickyNote') THEN k ELSE least(k, value * 2) END AS y,
           round(CASE kind WHEN 'Line' THEN k - value WHEN 'Text' THEN 120 WHEN 'StickyNote' THEN 120 ELSE abs(k - value) END, 6) AS width,
           round(CASE kind WHEN 'Line' THEN value * 2 - k WHEN 'Text' THEN 24 WHEN 'StickyNote' THEN 24 ELSE abs(value * 2 - k) END, 6) AS height
    FROM (SELECT event_id, value, k::DOUBLE AS k, CASE event_type WHEN 'click' THEN 'Highlight' WHEN 'view' THEN 'Line'
                 WHEN 'purchase' THEN 'Text' WHEN 'signup' THEN 'StickyNote' ELSE 'Circle' END AS kind FROM clicks)""")
def _(spark, folder):
    event = F.col("event_type")
    kind = (
        F.when(event == "click", F.lit("Highlight")).when(event == "view", F.lit("Line")).when(event == "purchase", F.lit("Text"))
        .when(event == "signup", F.lit("StickyNote")).otherwise(F.lit("Circle"))
    )
    k = F.col("k").cast("double")
    specs = clicks(spark, folder).select(
        "event_id", kind.alias("kind"), F.col("value").alias("x0"), k.alias("y0"), k.alias("x1"), (F.col("value") * 2).alias("y1")
    )
    drawn = annotations.marks_from_spec(specs)
    return drawn.withColumns({c: F.round(c, 6) for c in ("width", "height")})


@query("A9_annotation_kinds", with_inputs("marks") + "SELECT doc_id, page, kind, COUNT(*) AS marks FROM marks GROUP BY ALL")
def _(spark, folder):
    return annotations.annotation_kinds(marks(spark, folder))


@query("J1_to_file_space", with_inputs("marks", "turns") + """
    SELECT ann_id, x, coalesce(t.height, 792) - m.y - m.height AS y FROM marks m LEFT JOIN turns t USING (doc_id, page)""")
def _(spark, folder):
    return annotations.to_file_space(marks(spark, folder), turns(spark, folder)).select("ann_id", "x", "y")


@query("O2_append_annotations", with_inputs("marks", "turn_words", "boxes") + f"""
    SELECT doc_id, page, kind, x, y, width, height, ann_id FROM marks
    UNION ALL SELECT doc_id, page, 'Highlight', x, y, width, height, -1 FROM ({_SELECTED})""")
def _(spark, folder):
    selected = spatial.words_in_box(turn_words(spark, folder), boxes(spark, folder))
    both = annotations.append_annotations(marks(spark, folder), spatial.highlights_from_selection(selected))
    return both.select("doc_id", "page", "kind", "x", "y", "width", "height", F.coalesce("ann_id", F.lit(-1)).alias("ann_id"))


@query("W7_first_bookmark", with_inputs("clicks") + """
    SELECT user_id AS doc_id, CAST(k % 8 AS INTEGER) AS page, epoch_us(MIN(ts)) AS created, 'Page ' || (k % 8 + 1) AS label
    FROM clicks GROUP BY user_id, k % 8""")
def _(spark, folder):
    events = clicks(spark, folder).select(
        F.col("user_id").alias("doc_id"), (F.col("k") % 8).alias("page"), F.col("ts").alias("created_at")
    )
    first = annotations.first_bookmark(events)
    return first.select("doc_id", "page", F.unix_micros("created_at").alias("created"), "label")


@query("O4_overlay_rows", with_inputs("turns") + """
    SELECT doc_id, page, 'header' AS overlay, 'Corpus' AS text, 50.0::DOUBLE AS x, 760.0::DOUBLE AS y, 'Helvetica' AS font,
           10.0::DOUBLE AS size, 0.2::DOUBLE AS r, 0.2::DOUBLE AS g, 0.2::DOUBLE AS b FROM turns
    UNION ALL SELECT doc_id, page, 'footer', (page + 1) || '/' || COUNT(*) OVER (PARTITION BY doc_id), 50, 30, 'Helvetica', 10, 0.2, 0.2, 0.2 FROM turns
    UNION ALL SELECT doc_id, page, 'watermark', 'COPY', 200, 400, 'Helvetica', 48, 0.7, 0.7, 0.7 FROM turns
    UNION ALL SELECT doc_id, page, 'stamp', upper(label), 50, 50, 'Helvetica-Bold', 36, 0, 0, 0.8 FROM turns""")
def _(spark, folder):
    document = turns(spark, folder)
    requests = document.select("doc_id", "page", F.upper("label").alias("label"))
    return overlays.overlay_rows(document, "Corpus", "{page}/{pages}", "COPY", requests)
