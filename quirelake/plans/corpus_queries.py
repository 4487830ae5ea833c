"""Registered queries over sources, sinks, documents, forms and quality."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quirelake.operators import annotations, documents, forms, pages, quality, search
from quirelake.operators.markup import markup_headings
from quirelake.plans.inputs import clicks, html_pages, marks, sheets, table, turns, with_inputs
from quirelake.plans.page_queries import backwards
from quirelake.plans.registry import query
from quirelake.session import work_folder
from quirelake.sources import corpus, sinks, snapshot


# --- sources and sinks --------------------------------------------------------

@query("S1_read_corpus", with_inputs("sheets") + "SELECT doc_id, page, width, height, label, text FROM sheets")
def _(spark, folder):
    return corpus.read_corpus(spark, folder).drop("rotation")


_EXPORTED = re.compile(r"## Page (\d+)\n\n(.*?)\n\n(?=## Page|\Z)", re.DOTALL)


def _exported(content: bytes):
    """Extractor of an exported file: its pages."""
    for number, text in _EXPORTED.findall(content.decode("utf-8")):
        yield int(number) - 1, text


@query("S2_read_binary", with_inputs("turns") + "SELECT doc_id, page, text, 'none' AS error FROM turns")
def _(spark, folder):
    """The files an export leaves, read whole and taken apart again."""
    path = work_folder(spark, "files")
    sinks.write_export(sinks.export_text(turns(spark, folder), "md"), path, folders=True)
    found = corpus.read_binary(spark, f"{path}/doc_id=*/*.txt", _exported)
    return found.select(
        F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id"), "page", "text", F.coalesce("error", F.lit("none")).alias("error")
    )


_LINK = re.compile('href="([^"]*)"')
_HEADING = re.compile("<h1>([^<]*)</h1>")


def _paragraphs(content: bytes):
    """Extractor: one page per paragraph end of a web page, with its links and headings."""
    for page, text in enumerate(content.decode("utf-8").split("</p>")):
        yield page, text, _LINK.findall(text), _HEADING.findall(text)


@query("U1_extract", """
    SELECT path, CAST(i - 1 AS INTEGER) AS page, text, array_to_string(regexp_extract_all(text, 'href="([^"]*)"', 1), ' ') AS links,
        array_to_string(regexp_extract_all(text, '<h1>([^<]*)</h1>', 1), ' ') AS headings
    FROM (SELECT url AS path, unnest(string_split(html, '</p>')) AS text,
                 generate_subscripts(string_split(html, '</p>'), 1) AS i FROM pages)""")
def _(spark, folder):
    files = table(spark, folder, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    found = corpus.extract(files, _paragraphs, "page int, text string, links array<string>, headings array<string>")
    return found.where("error IS NULL").select("path", "page", "text", F.array_join("links", " ").alias("links"), F.array_join("headings", " ").alias("headings"))


@query("S3_read_state_json", with_inputs("clicks") + """
    SELECT event_id, CASE WHEN event_type = 'click' THEN k ELSE -1 END AS k,
           CASE event_type WHEN 'click' THEN 1.5 WHEN 'view' THEN 2.0 WHEN 'error' THEN 1.0 ELSE 0.5 END::DOUBLE AS zoom,
           CASE WHEN event_type = 'view' THEN 'Dark' ELSE 'System' END AS theme
    FROM clicks""")
def _(spark, folder):
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", F.format_string('{"k": %d, "zoom": 1.5}', "k"))
        .when(kind == "view", F.lit('{"k": "many", "zoom": 2.0, "theme": "Dark"}'))
        .when(kind == "error", F.lit("not json"))
        .otherwise(F.lit('{"zoom": 0.5}'))
    )
    rows = clicks(spark, folder).select("event_id", state.alias("state"))
    return corpus.read_state_json(rows, "state", "k INT, zoom DOUBLE, theme STRING", {"k": -1, "zoom": 1.0, "theme": "System"})


@query("S4_write_snapshot", "SELECT c_custkey, c_name, upper(c_mktsegment) AS segment FROM customer")
def _(spark, folder):
    path = work_folder(spark, "snapshot")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", F.lower("c_mktsegment").alias("segment"))
    snapshot.write_snapshot(customers, path)
    stored = snapshot.read_snapshot(spark, path)
    snapshot.write_snapshot(stored.withColumn("segment", F.upper("segment")), path)
    return snapshot.read_snapshot(spark, path)


# The skeleton of an exported page file.
_HEAD = """<!DOCTYPE html>
<html>
<head>
<meta charset="utf-8">
<title>Converted PDF</title>
</head>
<body>
"""
_TAIL = """</body>
</html>
"""


def _export_check(block: str, head: str = "", tail: str = "") -> str:
    return with_inputs("sheets") + f"""
    SELECT doc_id, 0 AS part, '{head}' || string_agg({block}, '' ORDER BY page) || '{tail}' AS text
    FROM sheets GROUP BY doc_id"""


@query("S5_export_text", _export_check("'--- Page ' || (page + 1) || ' ---' || chr(10) || chr(10) || text || chr(10) || chr(10)"))
def _(spark, folder):
    return sinks.export_text(sheets(spark, folder), "txt")


@query("S5_export_markdown", _export_check("'## Page ' || (page + 1) || chr(10) || chr(10) || text || chr(10) || chr(10)"))
def _(spark, folder):
    return sinks.export_text(sheets(spark, folder), "markdown")


@query("S5_export_html", _export_check(
    "'<section><h2>Page ' || (page + 1) || '</h2><pre>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    " || '</pre></section>' || chr(10)", _HEAD, _TAIL))
def _(spark, folder):
    return sinks.export_text(sheets(spark, folder), "html")


@query("S5_export_parts", with_inputs("sheets") + """
    SELECT doc_id, CAST(page // 3 AS INTEGER) AS part,
        string_agg('--- Page ' || (page + 1) || ' ---' || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY page) AS text
    FROM sheets GROUP BY 1, 2""")
def _(spark, folder):
    return sinks.export_text(sheets(spark, folder), "txt", pages_per_part=3)


@query("S5_written_export", with_inputs("turns") + """
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line
    FROM (SELECT doc_id, string_agg('## Page ' || (page + 1) || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY page) AS text FROM turns GROUP BY doc_id)""")
def _(spark, folder):
    """The lines of the files an export leaves."""
    path = work_folder(spark, "export")
    sinks.write_export(sinks.export_text(turns(spark, folder), "md"), path, folders=True)
    return spark.read.schema("value string, doc_id bigint").text(path).select("doc_id", F.col("value").alias("line"))


def _filed(spark, folder):
    path = F.concat(F.lit("/corpus/talk."), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return turns(spark, folder).withColumn("path", path)


@query("S7_split_pages", with_inputs("turns") + "SELECT doc_id, page, 'talk.' || doc_id || '_page_' || (page + 1) AS out_name, text FROM turns")
def _(spark, folder):
    path = work_folder(spark, "split")
    sinks.write_split(sinks.split_pages(_filed(spark, folder)), path)
    return spark.read.parquet(path).select("doc_id", "page", "out_name", "text")


@query("S7_split_page_list", with_inputs("turns") + """
    SELECT doc_id, page, 'talk.' || doc_id || '_page_' || (page + 1) AS out_name FROM turns WHERE page IN (0, 3, 6)""")
def _(spark, folder):
    return sinks.split_pages(_filed(spark, folder), [0, 3, 6, 90]).select("doc_id", "page", "out_name")


@query("S8_write_organised", with_inputs("turns") + """
    SELECT doc_id, CAST(COUNT(*) OVER (PARTITION BY doc_id) - 1 - page AS INTEGER) AS position, page AS source_page, text FROM turns""")
def _(spark, folder):
    path = work_folder(spark, "organised")
    sinks.write_organised(turns(spark, folder), backwards(spark, folder), path)
    return spark.read.parquet(path).select("doc_id", "position", "source_page", "text")


# --- documents ------------------------------------------------------------------

@query("A3_document_inventory", with_inputs("turns", "marks", "clicks") + """
    SELECT doc_id, coalesce(o.n, 0) AS outline, coalesce(m.n, 0) AS annotations, coalesce(b.n, 0) AS bookmarks, coalesce(h.n, 0) AS hits
    FROM (SELECT DISTINCT doc_id FROM turns)
    LEFT JOIN (SELECT page_id AS doc_id, COUNT(*) AS n FROM pages GROUP BY 1) o USING (doc_id)
    LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM marks GROUP BY 1) m USING (doc_id)
    LEFT JOIN (SELECT user_id AS doc_id, COUNT(*) AS n FROM clicks WHERE event_type = 'signup' GROUP BY 1) b USING (doc_id)
    LEFT JOIN (SELECT doc_id, SUM(len(regexp_extract_all(lower(text), 'en')))::BIGINT AS n FROM turns GROUP BY 1) h USING (doc_id)""")
def _(spark, folder):
    known = pages.page_counts(turns(spark, folder))
    return documents.document_inventory(known, {
        "outline": markup_headings(html_pages(spark, folder)),
        "annotations": marks(spark, folder),
        "bookmarks": clicks(spark, folder).filter("event_type = 'signup'").select(F.col("user_id").alias("doc_id")),
        "hits": search.search(turns(spark, folder), "en"),
    })


@query("A4_signature_status", with_inputs("turns", "clicks") + """
    SELECT doc_id, CASE WHEN good THEN 'Signed' WHEN NOT good THEN 'Warning' ELSE 'none' END AS status
    FROM (SELECT DISTINCT doc_id FROM turns)
    LEFT JOIN (SELECT user_id AS doc_id, bool_and(k <> 13 AND value < 60) AS good FROM clicks WHERE event_type = 'purchase' GROUP BY 1) USING (doc_id)""")
def _(spark, folder):
    signed = clicks(spark, folder).filter("event_type = 'purchase'").select(
        F.col("user_id").alias("doc_id"), (F.col("k") != 13).alias("digest_verified"), (F.col("value") < 60).alias("crypto_valid")
    )
    status = documents.signature_status(pages.page_counts(turns(spark, folder)), signed)
    return status.select("doc_id", F.coalesce("status", F.lit("none")).alias("status"))


def _layers(spark, folder):
    return table(spark, folder, "nation").select(
        F.col("n_regionkey").cast("bigint").alias("doc_id"),
        F.struct(F.col("n_nationkey").alias("num"), F.lit(0).alias("gen")).alias("object_id"),
        F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("name"), F.lit(True).alias("visible"),
    )


def _toggles(spark, folder):
    """A layer toggle for each event, on the layer numbered by its ``k``."""
    layers = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("doc_id"))
    events = clicks(spark, folder).withColumn("n_nationkey", F.col("k") % 40)
    return events.join(layers, "n_nationkey").select(
        "doc_id", F.struct(F.col("n_nationkey").alias("num"), F.lit(0).alias("gen")).alias("object_id"),
        (F.col("event_type") == "view").alias("visible"), "ts",
    )


@query("P9_drop_missing_layers", "SELECT n_nationkey, n_name AS name FROM nation WHERE n_regionkey > 0")
def _(spark, folder):
    return documents.drop_missing_layers(_layers(spark, folder)).select(F.col("object_id.num").alias("n_nationkey"), "name")


@query("J10_effective_layers", with_inputs("clicks") + """
    SELECT n_nationkey, coalesce(shown, true) AS visible
    FROM nation LEFT JOIN (SELECT k % 40 AS n_nationkey, max_by(event_type = 'view', ts) AS shown FROM clicks GROUP BY 1) USING (n_nationkey)""")
def _(spark, folder):
    now = documents.effective_layers(_layers(spark, folder), _toggles(spark, folder))
    return now.select(F.col("object_id.num").alias("n_nationkey"), "visible")


@query("J9_find_attachment", with_inputs("clicks") + """
    SELECT event_id, coalesce(n_name, '') AS name, CASE WHEN n_name IS NULL THEN 'Attachment not found' ELSE '' END AS error
    FROM clicks LEFT JOIN nation ON n_nationkey = k AND n_regionkey = user_id % 5""")
def _(spark, folder):
    files = table(spark, folder, "nation").select(
        F.col("n_regionkey").cast("bigint").alias("doc_id"),
        F.struct(F.col("n_nationkey").alias("num"), F.lit(0).alias("gen")).alias("object_id"), F.col("n_name").alias("name"),
    )
    asked = clicks(spark, folder).select(
        "event_id", (F.col("user_id") % 5).alias("doc_id"), F.struct(F.col("k").alias("num"), F.lit(0).alias("gen")).alias("object_id")
    )
    found = documents.find_attachment(asked, files)
    return found.select("event_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "error")])


@query("J11_outline_targets", with_inputs("html_pages", "turns") + """
    SELECT h.doc_id, coalesce(t.page, 0) AS page
    FROM html_pages h LEFT JOIN turns t ON h.doc_id = t.doc_id AND t.page = CAST(h.doc_id % 9 AS INTEGER)""")
def _(spark, folder):
    outline = markup_headings(html_pages(spark, folder)).withColumn("dest_page", (F.col("doc_id") % 9).cast("int"))
    return documents.outline_targets(outline, turns(spark, folder)).select("doc_id", "page")


@query("T3_outline_flatten", """
    SELECT r_regionkey::BIGINT AS doc_id, r_regionkey::BIGINT AS node_id, r_name AS title, 0 AS depth, CAST(r_regionkey AS VARCHAR) AS path FROM region
    UNION ALL SELECT n_regionkey, 1000 + n_nationkey, n_name, 1, n_regionkey || '/' || n_nationkey FROM nation
    UNION ALL SELECT n_regionkey, 100000 + c_custkey, c_name, 2, n_regionkey || '/' || n_nationkey || '/' || c_custkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, folder):
    def level(df, doc, node, parent, ordinal, title):
        return df.select(
            doc.cast("bigint").alias("doc_id"), node.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"),
            ordinal.cast("bigint").alias("ordinal"), title.alias("title"), F.lit(0).alias("page"),
        )

    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    top = F.col("r_regionkey")
    tree = (
        level(table(spark, folder, "region"), top, top, F.lit(None), top, F.col("r_name"))
        .unionByName(level(nation, F.col("n_regionkey"), 1000 + F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_nationkey"), F.col("n_name")))
        .unionByName(level(customer, F.col("n_regionkey"), 100000 + F.col("c_custkey"), 1000 + F.col("n_nationkey"), F.col("c_custkey"), F.col("c_name")))
    )
    flat = documents.outline_flatten(tree)
    path = F.array_join(F.transform("path", lambda p: p.cast("string")), "/")
    return flat.select("doc_id", "node_id", "title", "depth", path.alias("path"))


@query("J18_set_meta", """
    SELECT doc_id, CASE WHEN quality = 1 THEN 't' || doc_id ELSE source END AS title, lang AS author,
           CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS subject FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("lang").alias("author"), F.lit("plain").alias("subject"), F.lit("").alias("keywords")
    )
    updates = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("author"), F.when(F.col("toxic") == 1, F.lit("toxic")).alias("subject"),
        F.lit(None).cast("string").alias("keywords"),
    )
    return documents.set_meta(docs, updates).select("doc_id", "title", "author", "subject")


@query("W4_recent_files", with_inputs("clicks") + """
    SELECT user_id, path, epoch_us(last) AS last_opened, CAST(place AS INTEGER) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, path) AS place
          FROM (SELECT user_id, 'doc_' || k AS path, MAX(ts) AS last FROM clicks GROUP BY 1, 2)) WHERE place <= 20""")
def _(spark, folder):
    opens = clicks(spark, folder).select("user_id", F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("path"), "ts")
    return documents.recent_files(opens).withColumn("last_opened", F.unix_micros("last_opened"))


# --- forms ----------------------------------------------------------------------

def _fields(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value"), "c_custkey"
    )


def _updates(spark, folder):
    """The least order priority of each customer, and values for unknown names."""
    least = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("value"))
    known = _fields(spark, folder).drop("value").join(least, "c_custkey").select("doc_id", "name", "value")
    return known.unionByName(table(spark, folder, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("doc_id"), F.col("s_name").alias("name"), F.lit("lost").alias("value")
    ))


@query("J7_fill_form", """
    SELECT c_nationkey::BIGINT AS doc_id, c_name AS name, coalesce(v, c_mktsegment) AS value
    FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, MIN(o_orderpriority) AS v FROM orders GROUP BY 1) USING (c_custkey)""")
def _(spark, folder):
    return forms.fill_form(_fields(spark, folder), _updates(spark, folder)).select("doc_id", "name", "value")


@query("J7_rejected_updates", "SELECT s_nationkey::BIGINT AS doc_id, s_name AS name, 'lost' AS value FROM supplier")
def _(spark, folder):
    return forms.rejected_updates(_fields(spark, folder), _updates(spark, folder))


@query("J8_field_page", """
    SELECT c.c_nationkey::BIGINT AS doc_id, c.c_name AS name, CAST(coalesce(MIN(p.c_custkey % 7), 0) AS INTEGER) AS page
    FROM customer c LEFT JOIN customer p ON p.c_nationkey = c.c_nationkey AND c.c_custkey BETWEEN p.c_custkey + 1 AND p.c_custkey + 40
    GROUP BY ALL""")
def _(spark, folder):
    customer = table(spark, folder, "customer")
    doc = F.col("c_nationkey").cast("bigint").alias("doc_id")
    fields = customer.select(doc, F.col("c_name").alias("name"), F.array("c_custkey").alias("widgets"))
    listed = F.sequence(F.col("c_custkey") + 1, F.col("c_custkey") + 40)
    lists = customer.select(doc, (F.col("c_custkey") % 7).cast("int").alias("page"), listed.alias("annots"))
    return forms.field_page(fields, lists).select("doc_id", "name", "page")


@query("J8_list_fields", """
    SELECT c.c_nationkey::BIGINT AS doc_id, c.c_name AS name,
        CASE WHEN c.c_nationkey < 10 THEN CASE WHEN (c.c_nationkey & 4) <> 0 THEN 'radio' ELSE 'checkbox' END
             WHEN c.c_nationkey < 15 THEN 'choice' ELSE 'text' END AS kind,
        CASE WHEN c.c_nationkey < 10 THEN CASE WHEN c.c_mktsegment <> 'BUILDING' THEN 'Yes' ELSE 'Off' END
             WHEN c.c_nationkey < 15 AND c.c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN '' ELSE c.c_mktsegment END AS value,
        CASE WHEN c.c_nationkey BETWEEN 10 AND 14 THEN CASE c.c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END END::INTEGER AS selected_index,
        CAST(coalesce(MIN(p.c_custkey % 7), 0) AS INTEGER) AS page
    FROM customer c LEFT JOIN customer p ON p.c_nationkey = c.c_nationkey AND c.c_custkey BETWEEN p.c_custkey + 1 AND p.c_custkey + 40
    GROUP BY ALL""")
def _(spark, folder):
    customer = table(spark, folder, "customer")
    nation, doc = F.col("c_nationkey"), F.col("c_nationkey").cast("bigint").alias("doc_id")
    kind = F.when(nation < 10, "button").when(nation < 15, "choice").otherwise("text")
    state = F.when(F.col("c_mktsegment") == "BUILDING", "Off").otherwise(F.col("c_mktsegment"))
    fields = customer.select(
        doc, F.col("c_name").alias("name"), kind.alias("type"), (nation * 8192).alias("flags"), F.col("c_mktsegment").alias("value"),
        state.alias("state"), F.array(F.lit("BUILDING"), F.lit("MACHINERY")).alias("options"), F.array("c_custkey").alias("widgets"))
    listed = F.sequence(F.col("c_custkey") + 1, F.col("c_custkey") + 40)
    lists = customer.select(doc, (F.col("c_custkey") % 7).cast("int").alias("page"), listed.alias("annots"))
    return forms.list_fields(fields, lists).drop("checked", "options")


# --- quality --------------------------------------------------------------------

def _rule_book():
    """Length, language, toxicity and label rules over documents with labels."""
    book = quality.register_rules([
        quality.Rule("length", F.col("n_chars") < 200, "document is short"),
        quality.Rule("language", ~F.col("lang").isin("en", "fr"), "language not covered"),
        quality.Rule("toxic", F.col("toxic") == 1, "marked toxic"),
        quality.Rule("label", F.col("quality").isNull(), "no label"),
    ], "archive")
    return quality.register_rules([quality.Rule("label", F.col("quality").isNull(), "no label")], "labelled", book)


def _validated(spark, folder, profile):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return quality.validate(joined, _rule_book(), profile)


_BROKEN = """
    SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 200 THEN 'length' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' END,
           CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NULL THEN 'label' END], lambda r: r IS NOT NULL)) AS rule
    FROM documents LEFT JOIN labels USING (doc_id)"""


@query("A8_validate", f"""
    SELECT doc_id, 'archive' AS profile, coalesce(n, 0) AS found, n IS NULL AS conforms
    FROM documents LEFT JOIN (SELECT doc_id, CAST(COUNT(*) AS INTEGER) AS n FROM ({_BROKEN}) GROUP BY 1) USING (doc_id)""")
def _(spark, folder):
    report = _validated(spark, folder, "unheard-of")
    return report.select("doc_id", "profile", F.size("violations").alias("found"), "conforms")


@query("A8_violations", f"""
    SELECT doc_id, rule, CASE rule WHEN 'length' THEN 'document is short' WHEN 'language' THEN 'language not covered'
           WHEN 'toxic' THEN 'marked toxic' ELSE 'no label' END AS message FROM ({_BROKEN})""")
def _(spark, folder):
    return quality.violations(_validated(spark, folder, "Archive"))


@query("U2_register_rules", "SELECT 'label' AS rule, COUNT(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, folder):
    return quality.violation_counts(_validated(spark, folder, "labelled"))


@query("A11_distinct_documents", "SELECT sha256(text) AS digest, MIN(doc_id) AS doc_id, COUNT(*) AS copies FROM documents GROUP BY 1")
def _(spark, folder):
    return quality.distinct_documents(table(spark, folder, "documents"))


@query("A11_unreferenced", """
    SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT user_id FROM events)""")
def _(spark, folder):
    left = quality.unreferenced(
        table(spark, folder, "documents"), (table(spark, folder, "labels"), "doc_id"), (table(spark, folder, "events"), "user_id")
    )
    return left.select("doc_id", "n_chars")


@query("A12_read_page_results", with_inputs("turns", "turn_words") + """
    SELECT doc_id, page, 0 AS part, string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY word_no) AS line FROM turn_words GROUP BY ALL)
    GROUP BY doc_id, page""")
def _(spark, folder):
    read = quality.read_page_results(turns(spark, folder))
    return read.select("doc_id", "page", "part", F.regexp_replace("text", " +", " ").alias("text"))


@query("A12_latest_results", with_inputs("clicks") + """
    SELECT user_id AS doc_id, k AS page, max_by(event_type, ts) AS result FROM clicks GROUP BY 1, 2""")
def _(spark, folder):
    results = clicks(spark, folder).select(F.col("user_id").alias("doc_id"), F.col("k").alias("page"), F.col("event_type").alias("result"), "ts")
    return quality.latest_results(results)


@query("J15_tag_untagged", with_inputs("sheets") + """
    SELECT doc_id, page, 'Part' AS element, text AS alt FROM sheets WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, folder):
    return quality.tag_untagged(sheets(spark, folder), table(spark, folder, "labels"))


def _lines(df):
    return df.select("doc_id", F.lit(0).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def _versions(spark, folder):
    """Lines of the documents, and of a later version without the short ones."""
    docs = table(spark, folder, "documents")
    later = docs.filter("n_chars > 300").withColumn("text", F.replace("text", F.lit("tion"), F.lit("TION")))
    return _lines(docs), _lines(later)


_LINE_SETS = """WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    b AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS text, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no
          FROM (SELECT doc_id, replace(text, 'tion', 'TION') AS t FROM documents WHERE n_chars > 300))"""


@query("J16_compare_lines", _LINE_SETS + """
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN b.text IS NULL THEN 'left only' ELSE 'changed' END AS state
    FROM a LEFT JOIN b USING (doc_id, line_no) WHERE b.text IS DISTINCT FROM a.text""")
def _(spark, folder):
    return quality.compare_lines(*_versions(spark, folder)).select("doc_id", "line_no", "state")


@query("O3_changed_lines", _LINE_SETS + """
    SELECT text, CASE WHEN n > 0 THEN 'left only' ELSE 'right only' END AS side, CAST(abs(n) AS BIGINT) AS copies
    FROM (SELECT text, SUM(s) AS n FROM (SELECT text, 1 AS s FROM a UNION ALL SELECT text, -1 FROM b) GROUP BY text) WHERE n <> 0""")
def _(spark, folder):
    return quality.changed_lines(*_versions(spark, folder))


@query("J16_compare_pixels", with_inputs("clicks") + """
    SELECT user_id AS page_id, event_id AS px, k AS py, CASE WHEN event_type = 'view' THEN 'left only' ELSE 'changed' END AS state
    FROM clicks WHERE event_type = 'view' OR floor(value) > 10""")
def _(spark, folder):
    events = clicks(spark, folder)
    spot = [F.col("user_id").alias("page_id"), F.col("event_id").alias("px"), F.col("k").alias("py")]
    before = events.select(*spot, F.lit(0).alias("r"), F.col("k").alias("g"), F.lit(9).alias("b"))
    after = events.filter("event_type <> 'view'").select(
        *spot, F.floor("value").cast("int").alias("r"), F.col("k").alias("g"), F.lit(0).alias("b")
    )
    return quality.compare_pixels(before, after)


@query("J17_verify_digests", """
    SELECT doc_id, CASE WHEN quality IS NULL THEN 'unsigned' WHEN toxic = 1 THEN 'changed' ELSE 'verified' END AS status
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    signed_text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    manifest = docs.join(table(spark, folder, "labels"), "doc_id").select("doc_id", F.sha2(signed_text, 256).alias("digest"))
    return quality.verify_digests(docs, manifest)


# --- edit log -------------------------------------------------------------------

def edit_log(events):
    """Events as edits of marks: a view or an error takes the mark away, the rest set it."""
    action = F.when(F.col("event_type").isin("view", "error"), F.lit("delete")).otherwise(F.lit("add"))
    return events.select(F.col("user_id").alias("doc_id"), F.col("k").alias("ann_id"), F.col("event_id").alias("seq"), action.alias("action"))


LIVE_MARKS = with_inputs("clicks") + """
    SELECT user_id AS doc_id, k AS ann_id, MAX(event_id) AS seq FROM clicks
    GROUP BY 1, 2 HAVING max_by(event_type, event_id) NOT IN ('view', 'error')"""


@query("U3_replay", LIVE_MARKS)
def _(spark, folder):
    return annotations.live_marks(edit_log(clicks(spark, folder)))
