"""Operators against brute force on small fixtures, and by property."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirelake.operators import annotations, documents, layout, pages, prefix, quality, search, spatial, tables

PAGES = "doc_id bigint, page int, width double, height double, label string, text string"


def page_table(spark, texts, height=792.0):
    data = [(d, p, 612.0, height, None, t) for (d, p), t in texts.items()]
    return spark.createDataFrame(data, PAGES)


def word_table(spark, data):
    return spark.createDataFrame(
        data, "doc_id bigint, page int, word_no int, text string, x double, y double, width double, height double"
    )


# --- prefix -------------------------------------------------------------------

def test_running_total_over_many_blocks(spark):
    rng = random.Random(1)
    data = [(d, i, rng.randint(0, 9)) for d in range(3) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(data, "doc_id bigint, i int, v bigint")
    got = rows(prefix.running_total(df, ["doc_id"], "i", F.col("v"), "before", block=16), "doc_id", "i", "before")
    assert got == sorted(
        ((d, i, sum(v for e, j, v in data if e == d and j < i)) for d, i, _ in data), key=repr
    )


# --- search -------------------------------------------------------------------

def brute(text, query):
    seen, needle = text.replace("İ", "i").lower(), query.replace("İ", "i").lower()
    return [i for i in range(len(seen) - len(needle) + 1) if seen[i : i + len(needle)] == needle]


LONG = "".join(random.Random(3).choices("aAbé \n🙂", k=20000))


@pytest.mark.parametrize("query", ["a", "aa", "aba", "É", "🙂b", "A\nb", ".*", "\\E", "a" * 9])
def test_search_is_brute_force(spark, query):
    texts = {(1, 0): LONG, (1, 1): "aaaa", (2, 0): "", (3, 0): "x.*y \\E \\Q", (4, 0): "a" * 4096 + "b" + "a" * 4100}
    got = rows(search.search(page_table(spark, texts), query), "doc_id", "page", "pos", "text")
    want = [(d, p, i, t[i : i + len(query)]) for (d, p), t in texts.items() for i in brute(t, query)]
    assert got == sorted(want, key=repr)


def test_snippets_are_cut_out_of_the_row(spark):
    texts = {(1, 0): LONG, (1, 1): "aba", (2, 0): "x" * 300 + "aba" + "y" * 255 + "aBA", (None, 0): "ab" * 200}
    table = page_table(spark, texts)
    for around in (0, 3, 20, 300):
        got = rows(search.search_snippets(table, "aba", around=around), "doc_id", "page", "pos", "text", "snippet")
        want = []
        for (d, p), t in texts.items():
            for i in brute(t, "aba"):
                low, high = max(i - around, 0), i + 3 + around
                want.append((d, p, i, t[i : i + 3], ("..." if low else "") + t[low:high] + ("..." if high < len(t) else "")))
        assert got == sorted(want, key=repr)
    assert search.search_snippets(table, "").count() == 0


def test_search_options(spark):
    table = page_table(spark, {(1, 0): "En en", (1, 1): "EN İx iX"})
    assert rows(search.search(table, "en", case_sensitive=True), "page", "pos") == [(0, 3)]
    assert rows(search.search(table, "en", page=1), "page", "pos") == [(1, 0)]
    assert rows(search.search(table, "ix"), "page", "pos") == [(1, 3), (1, 6)]
    assert search.search(table, "").count() == 0


def test_search_many_is_search_each(spark):
    texts = {(d, p): "".join(random.Random(d * 9 + p).choices("abcdÉ🙂 ", k=300)) for d in range(4) for p in range(3)}
    wanted = {1: "ab", 8: "AB", 9: "é🙂", 2: "a", 3: "cab", 4: "dabc", 5: "zzz", 6: "", 7: "B C", 10: "d" * 300}
    queries = spark.createDataFrame(list(wanted.items()), "query_id bigint, query string")
    got = rows(search.search_many(page_table(spark, texts), queries), "query_id", "doc_id", "page", "pos")
    want = [(q, d, p, i) for q, s in wanted.items() if s for (d, p), t in texts.items() for i in brute(t, s)]
    assert got == sorted(want, key=repr)


def test_search_many_with_long_and_crowded_queries(spark):
    """Heads that agree and rests that differ, a query over many pieces, and texts that are one letter."""
    draw = random.Random(4)
    whole = "".join(draw.choices("abÉ 🙂", k=3000))
    texts = {(1, 0): whole, (1, 1): "a" * 2000, (None, 0): whole[:700] + "X", (2, 0): whole[1:900], (3, 0): None}
    wanted = {1: whole[:1500], 2: whole[:690], 3: whole[5:69], 4: whole[5:70], 5: "a" * 1990, 6: "a" * 64, 7: "A" * 65, 8: whole[200:264].upper(), 9: whole[:80] + "zz", 10: "x"}
    queries = spark.createDataFrame(list(wanted.items()), "query_id bigint, query string")
    got = rows(search.search_many(page_table(spark, {k: t for k, t in texts.items()}), queries), "query_id", "doc_id", "page", "pos", "text")
    want = [(q, d, p, i, t[i : i + len(s)]) for q, s in wanted.items() for (d, p), t in texts.items() for i in brute(t or "", s)]
    assert got == sorted(want, key=repr)


def test_search_many_without_queries(spark):
    queries = spark.createDataFrame([], "query_id bigint, query string")
    assert search.search_many(page_table(spark, {(1, 0): "a"}), queries).count() == 0


def test_hits_find_their_span(spark):
    words = word_table(spark, [(1, 0, i, t, 50.0 + 45 * i, 28.0, 8.0 * len(t), 10.0) for i, t in enumerate(["co", "op", "", "e" * 3000, "r"])])
    spans = layout.span_offsets(words)
    text = "coop" + "e" * 3000 + "r"
    hits = search.search(page_table(spark, {(1, 0): text}), "o")
    found = search.hit_to_span(hits, spans)
    assert rows(found, "pos", "word_no", "width", "height") == [(1, 0, 16.0, 12.0), (2, 1, 16.0, 12.0)]
    last = search.hit_to_span(search.search(page_table(spark, {(1, 0): text}), "er"), spans)
    assert rows(last, "pos", "word_no") == [(3003, 3)]


def test_hit_steps_go_round(spark):
    numbered = search.number_hits(search.search(page_table(spark, {(1, 0): "a a", (1, 3): "a", (2, 5): "a"}), "a"))
    assert rows(numbered, "doc_id", "page", "pos", "hit_no") == [(1, 0, 0, 0), (1, 0, 2, 1), (1, 3, 0, 2), (2, 5, 0, 0)]
    steps = rows(search.next_prev_hit(numbered), "doc_id", "hit_no", "next_page", "next_pos", "prev_page", "prev_pos")
    assert steps == [(1, 0, 0, 2, 3, 0), (1, 1, 3, 0, 0, 0), (1, 2, 0, 0, 0, 2), (2, 0, 5, 0, 5, 0)]


ITEMS = [(4, "Rotate sheet", "Quarter turn", "Layout"), (5, "Merge binders", None, "Tools"), (6, "Night colours", None, "Look")]


@pytest.mark.parametrize("query,found", [("", [4, 5, 6]), (" ", [4, 5, 6]), ("night", [6]), ("rqt", [4]), ("zzq", [])])
def test_fuzzy_find(spark, query, found):
    titles = spark.createDataFrame(ITEMS, "id bigint, title string, subtitle string, category string")
    assert [r.id for r in search.fuzzy_find(titles, query, 2).collect()] == found


def shortest(text, wanted):
    best = None
    for start in range(len(text)):
        at = start - 1
        for c in wanted:
            at = text.find(c, at + 1)
            if at < 0:
                break
        else:
            best = min(best or 10**9, at - start + 1)
    return best


def test_fuzzy_scores_are_brute_force(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choices("aabc .*É🙂", k=draw.randrange(30))) for _ in range(80)]
    titles = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(texts)], "id bigint, title string, subtitle string, category string")
    for query in ("a", "ab", "aab", "c.*", "É🙂a"):
        got = {r.id: -r.score for r in search.fuzzy_find(titles, query, 100).collect()}
        want = {i: shortest((t + "  ").lower(), query.lower()) for i, t in enumerate(texts)}
        assert got == {i: n for i, n in want.items() if n}


def test_fuzzy_time_is_linear(spark):
    import time

    titles = spark.createDataFrame([(1, "a" * 4000, None, "")], "id bigint, title string, subtitle string, category string")
    search.fuzzy_find(titles, "aaab", 5).collect()
    start = time.perf_counter()
    assert search.fuzzy_find(titles, "aaab", 5).collect() == []
    assert time.perf_counter() - start < 2


# --- layout -------------------------------------------------------------------

def test_layout_keeps_blank_line_numbers(spark):
    words = layout.layout_words(page_table(spark, {(1, 0): "one é\n \n  two"}))
    assert rows(words, "word_no", "line_no", "text", "x", "y", "width") == [
        (0, 0, "one", 50.0, 28.0, 24.0), (1, 0, "é", 95.0, 28.0, 16.0), (2, 2, "two", 50.0, 64.0, 24.0),
    ]


def test_page_text_joins_lines(spark):
    table = page_table(spark, {(1, 0): "upper row, é\nlower row", (1, 1): " \n"})
    out = layout.page_text(layout.layout_lines(table))
    assert rows(out, "page", "text") == [(0, "upper row, é\nlower row")]


def brute_lines(ys, tol):
    anchors, line = {}, -1
    anchor = None
    for y in sorted(set(ys)):
        if anchor is None or y - anchor >= tol:
            anchor, line = y, line + 1
        anchors[y] = line
    return anchors


@pytest.mark.parametrize("band,spread", [(16384.0, 120), (16.0, 120), (3.0, 60), (7.0, 2000)])
def test_lines_break_on_drift(spark, band, spread):
    rng = random.Random(5)
    ys = {d: [round(rng.uniform(-spread, spread), 1) for _ in range(60)] for d in range(3)}
    data = [(d, 0, i, str(i), float(i), y, 5.0, 5.0) for d, many in ys.items() for i, y in enumerate(many)]
    got = rows(layout.assign_lines(word_table(spark, data), 5.0, band), "doc_id", "word_no", "line_no")
    want = [(d, i, brute_lines(many, 5.0)[y]) for d, many in ys.items() for i, y in enumerate(many)]
    assert got == sorted(want, key=repr)


def test_structure_order_falls_back(spark):
    spans = word_table(spark, [(d, 0, i, "w", 0.0, 0.0, 1.0, 1.0) for d in (1, 2) for i in range(2)])
    tree = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 0)], "doc_id bigint, page int, word_no int, struct_ord int")
    out = layout.structure_order(spans, tree)
    assert rows(out, "doc_id", "word_no", "reading_order") == [(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, 1)]


# --- boxes --------------------------------------------------------------------

def random_boxes(rng, n, far):
    return [(rng.uniform(-far, far), rng.uniform(-far, far), rng.uniform(0, far), rng.uniform(0, far)) for _ in range(n)]


@pytest.mark.parametrize("far", [50, 700, 9000])
def test_words_in_box_is_brute_force(spark, far):
    rng = random.Random(far)
    words = [(1 + i % 2, 0, i, f"w{i}", *b) for i, b in enumerate(random_boxes(rng, 60, far / 4))]
    boxes = [(1 + i % 2, 0, i, *b) for i, b in enumerate(random_boxes(rng, 40, far))]
    box_df = spark.createDataFrame(boxes, "doc_id bigint, page int, box_id bigint, x double, y double, width double, height double")
    word_df = word_table(spark, words)
    want = [
        (w[2], b[2]) for w, b in itertools.product(words, boxes)
        if w[0] == b[0] and b[3] < w[4] + w[6] and b[3] + b[5] > w[4] and b[4] < w[5] + w[7] and b[4] + b[6] > w[5]
    ]
    assert rows(spatial.words_in_box(word_df, box_df), "word_no", "box_id") == sorted(want, key=repr)
    covered = {w for w, _ in want}
    left = {r[0] for r in rows(spatial.redact(word_df, box_df), "word_no")}
    assert left == {w[2] for w in words} - covered
    assert spatial.words_in_box(spatial.redact(word_df, box_df), box_df).count() == 0
    assert {r[0] for r in rows(spatial.redaction_audit(word_df, box_df), "word_no")} == covered


def test_content_bbox(spark):
    white = [(p, x, y, 255, 255, 255) for p in (1, 2) for x in range(10) for y in range(10)]
    dark = [(2, 0, 0, 100, 255, 255), (2, 1, 0, 100, 255, 255)]
    df = spark.createDataFrame([r for r in white if r[:3] not in {d[:3] for d in dark}] + dark, "page_id bigint, px int, py int, r int, g int, b int")
    assert rows(spatial.content_bbox(df, 10, 10)) == [(2, 0, 0, 9, 9)]


# --- pages --------------------------------------------------------------------

def test_page_refs(spark):
    labelled = spark.createDataFrame([(1, 0, "i"), (1, 1, "II"), (1, 2, "5")], "doc_id bigint, page int, label string")
    typed = {"ii": 1, "5": 2, "4": 3, "abc": None, "  8  ": 7, "0": 0, "I": 0, "+3": 2, "-3": None}
    df = spark.createDataFrame([(1, t) for t in typed], "doc_id bigint, input string")
    assert dict(rows(pages.resolve_page_ref(df, labelled), "input", "page")) == typed


def test_page_lists(spark):
    table = page_table(spark, {(1, p): "t" for p in range(12)})
    assert [r[0] for r in rows(pages.select_pages(table, "1,3-5,10"), "page")] == [0, 2, 3, 4, 9]
    assert pages.select_pages(table, None).count() == 12
    assert pages.select_pages(table, "").count() == 0


def stack(spark, heights):
    return spark.createDataFrame([(d, p, 612.0, h, None, "") for d, hs in heights.items() for p, h in enumerate(hs)], PAGES)


def brute_seen(heights, y0, vh, zoom):
    reach = vh if vh > 0 else 2000.0
    low, high, focus = max(y0 - reach * 0.5, 0.0), y0 + reach * 1.5, y0 + reach * 0.3
    y, hit, main = 30.0 * zoom, [], 0
    for page, h in enumerate(heights):
        bottom = y + h * zoom
        if y <= focus <= bottom:
            main = page
        if bottom >= low and y <= high:
            hit.append(page)
        y = bottom + 20.0 * zoom
    return (hit[0], hit[-1] + 1, main) if hit else (0, 0, 0)


def test_pages_seen_is_brute_force(spark):
    rng = random.Random(7)
    heights = {1: [1000.0], 2: [1000.0] * 3, 3: [float(rng.randint(0, 900)) for _ in range(50)]}
    views = [(i, rng.choice([1, 2, 3]), float(rng.randint(0, 30000)), float(rng.choice([0, 400, 800])), rng.choice([0.5, 1.0, 2.0])) for i in range(80)]
    views.append((99, 1, 0.0, 800.0, 1.0))
    df = spark.createDataFrame(views, "view_id bigint, doc_id bigint, viewport_y double, viewport_height double, zoom double")
    got = {r[0]: r[1:] for r in rows(pages.pages_seen(df, stack(spark, heights)), "view_id", "first_page", "end_page", "main_page")}
    for view_id, doc, y0, vh, zoom in views:
        assert got[view_id] == brute_seen(heights[doc], y0, vh, zoom)
    assert got[99][:2] == (0, 1)


def test_delete_page_moves_marks(spark):
    table = page_table(spark, {(1, p): str(p) for p in range(3)})
    marks = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (1, 2, 9)], "doc_id bigint, page int, ann_id bigint")
    left, kept = pages.delete_page(table, marks, 1)
    assert rows(left, "page", "text") == [(0, "0"), (1, "2")]
    assert rows(kept, "page", "ann_id") == [(0, 7), (1, 9)]


def test_merge_keeps_order(spark):
    table = page_table(spark, {(1, 0): "a", (1, 1): "b", (2, 0): "c"})
    plan = spark.createDataFrame([(9, 0, 2), (9, 1, 1), (9, 2, 2)], "target_id bigint, ordinal int, doc_id bigint")
    merged = pages.merge_documents(table, plan)
    assert rows(merged, "page", "text") == [(0, "c"), (1, "a"), (2, "b"), (3, "c")]


# --- annotations, documents, edits ----------------------------------------------

def test_first_bookmark(spark):
    df = spark.sql("SELECT 1L doc_id, 5 page, timestamp_seconds(t) created_at FROM VALUES (20), (10) AS v(t)")
    assert rows(annotations.first_bookmark(df).selectExpr("page", "label", "unix_seconds(created_at)")) == [(5, "Page 6", 10)]


def test_outline_drops_what_is_too_deep(spark):
    chain = [(1, i, i - 1 if i else None, 0, f"n{i}", i) for i in range(105)]
    sibling = [(1, 900, None, 1, "second", 0)]
    df = spark.createDataFrame(chain + sibling, "doc_id bigint, node_id bigint, parent_id bigint, ordinal bigint, title string, page int")
    flat = documents.outline_flatten(df).orderBy("doc_id", "path").collect()
    assert [r.title for r in flat] == [f"n{i}" for i in range(101)] + ["second"]
    assert max(r.depth for r in flat) == 100


def test_recent_files_are_capped(spark):
    df = spark.sql("SELECT 1L user_id, concat('f', id % 25) path, timestamp_seconds(id) ts FROM range(50)")
    got = documents.recent_files(df).orderBy("place").collect()
    assert [r.path for r in got] == [f"f{i}" for i in range(24, 4, -1)]


def test_signature_status(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    sigs = spark.createDataFrame([(1, True, True), (2, True, True), (2, True, False)], "doc_id bigint, digest_verified boolean, crypto_valid boolean")
    assert rows(documents.signature_status(docs, sigs)) == [(1, "Signed"), (2, "Warning"), (3, None)]


def test_live_marks(spark):
    rng = random.Random(11)
    log = [(d, rng.randint(0, 9), i, rng.choice(["add", "delete"])) for i in range(300) for d in (1, 2)]
    last = {}
    for doc, mark, seq, action in log:
        last[doc, mark] = (seq, action)
    want = [(*key, seq) for key, (seq, action) in last.items() if action == "add"]
    rng.shuffle(log)
    df = spark.createDataFrame(log, "doc_id bigint, ann_id bigint, seq bigint, action string")
    assert rows(annotations.live_marks(df)) == sorted(want, key=repr)


def test_page_edits_by_list(spark):
    table = page_table(spark, {(d, p): f"{d}.{p}" for d, n in ((1, 6), (2, 2)) for p in range(n)}).withColumn("rotation", F.lit(270))
    out = pages.edit_pages(table, rotate="1:90 5-9:180", delete="2,9", order="6,3-4,6")
    assert rows(out.where("doc_id = 1"), "page", "source_page", "rotation") == [(0, 5, 90), (1, 2, 270), (2, 3, 270), (3, 0, 0), (4, 4, 90)]
    assert rows(out.where("doc_id = 2"), "page", "source_page", "rotation") == [(0, 0, 0)]
    assert rows(pages.edit_pages(table), "doc_id", "page", "source_page") == sorted((d, p, p) for d, n in ((1, 6), (2, 2)) for p in range(n))


# --- tables and quality -----------------------------------------------------------

def test_detect_tables(spark):
    grid = [(1, 0, 3 * r + c, f"{r}{c}", 50.0 + 100 * c, 100.0 + 18 * r, 20.0, 12.0) for r in range(3) for c in range(3)]
    prose = [(1, 0, 20, "title", 300.0, 10.0, 40.0, 12.0), (1, 0, 21, "end", 77.0, 400.0, 40.0, 12.0)]
    found = tables.detect_tables(word_table(spark, grid + prose)).collect()
    assert len(found) == 1
    assert found[0].cells == [["00", "01", "02"], ["10", "11", "12"], ["20", "21", "22"]]
    assert found[0].csv.startswith("00,01,02\n10") and found[0].tsv.startswith("00\t01")
    assert (found[0].x, found[0].y, found[0].width, found[0].height) == (50.0, 100.0, 220.0, 48.0)


def test_long_table_continues_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES_PER_PART", 2)
    grid = [(1, 0, 2 * r + c, f"{r}{c}", 50.0 + 100 * c, 100.0 + 18 * r, 20.0, 12.0) for r in range(5) for c in range(2)]
    parts = tables.detect_tables(word_table(spark, grid)).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2]
    assert sum((p.cells for p in parts), []) == [[f"{r}0", f"{r}1"] for r in range(5)]
    assert {p.height for p in parts} == {84.0}


def columns_at(spark, pattern):
    """A page whose lines have words at the columns given per line."""
    data, n = [], 0
    for line, places in enumerate(pattern):
        for place in places:
            data.append((1, 0, n, f"{line}{place}", 50.0 + 100 * place, 18.0 * line, 8.0, 12.0))
            n += 1
    return word_table(spark, data)


def test_tables_of_a_page_are_numbered(spark):
    pattern = [[0, 1], [0, 1], [2], [0, 3], [0, 3], [0, 3], [0, 3], [0, 3], [0, 3], [1, 2], [5], [1, 2], [1, 2]]
    found = tables.detect_tables(columns_at(spark, pattern)).orderBy("table_no").collect()
    assert [(t.table_no, t.line_count, t.cells[0][0]) for t in found] == [(0, 2, "00"), (1, 6, "30"), (2, 2, "111")]


def test_rules(spark):
    docs = spark.createDataFrame([(1, "ok"), (2, None)], "doc_id bigint, text string")
    book = quality.register_rules([quality.Rule("text", F.col("text").isNull(), "no text")], "first")
    quality.register_rules([], "second", book)
    report = quality.validate(docs, book, "no such profile")
    assert rows(report, "doc_id", "profile", "conforms") == [(1, "first", True), (2, "first", False)]
    assert rows(quality.violations(report)) == [(2, "text", "no text")]


def test_changed_lines_is_multiset_difference(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    b = spark.createDataFrame([("x",), ("z",)], "text string")
    assert rows(quality.changed_lines(a, b)) == [("x", "left only", 1), ("y", "left only", 1), ("z", "right only", 1)]


# --- several updates of one row, and null documents --------------------------------

def test_the_last_update_of_a_field_wins(spark):
    from quirelake.operators import forms

    fields = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "doc_id bigint, name string, value string")
    updates = spark.createDataFrame([(1, "a", "new", 1), (1, "a", "newer", 2), (1, "a", None, 3), (2, "b", "q", 1), (2, "a", "same", 1), (2, "a", "same", 1)], "doc_id bigint, name string, value string, seq int")
    assert rows(forms.fill_form(fields, updates, "seq")) == [(1, "a", "newer"), (1, "b", "y"), (2, "a", "same")]
    assert rows(forms.fill_form(fields, updates.drop("seq"))) == [(1, "a", "newer"), (1, "b", "y"), (2, "a", "same")]


def test_the_last_update_of_metadata_wins(spark):
    docs = spark.createDataFrame([(1, "t", "a"), (2, "u", None), (3, None, None)], "doc_id bigint, title string, author string")
    updates = spark.createDataFrame([(1, "old", "z", 1), (1, "new", None, 2), (2, None, "w", 1), (9, "q", "q", 1)], "doc_id bigint, title string, author string, seq int")
    assert rows(documents.set_meta(docs, updates, ("title", "author"), "seq"), "doc_id", "title", "author") == [(1, "new", "z"), (2, "u", "w"), (3, None, None)]


def test_a_document_listed_twice_is_checked_once(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id bigint, text string")
    mark = lambda t: hashlib.sha256(t.encode()).hexdigest()
    manifest = spark.createDataFrame([(1, mark("x")), (1, mark("a")), (1, mark("a")), (2, mark("x")), (2, mark("y")), (3, None)], "doc_id bigint, digest string")
    assert rows(quality.verify_digests(docs, manifest)) == sorted([(1, "verified"), (2, "changed"), (3, "unsigned"), (None, "unsigned")], key=repr)


def test_null_documents_keep_their_rows(spark):
    table = page_table(spark, {(1, 0): "aa", (1, 1): "a", (None, 0): "a a", (None, 1): "b a"})
    assert rows(pages.page_offsets(table), "doc_id", "page", "offset") == sorted([(1, 0, 0.0), (1, 1, 812.0), (None, 0, 0.0), (None, 1, 812.0)], key=repr)
    assert rows(pages.page_x_of_y(table, "{page}/{pages}"), "doc_id", "page", "caption") == sorted([(1, 0, "1/2"), (1, 1, "2/2"), (None, 0, "1/2"), (None, 1, "2/2")], key=repr)
    numbered = search.number_hits(search.search(table, "a"))
    assert rows(numbered, "doc_id", "page", "pos", "hit_no") == sorted([(1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 0, 2), (None, 0, 0, 0), (None, 0, 2, 1), (None, 1, 2, 2)], key=repr)
    assert rows(search.next_prev_hit(numbered), "doc_id", "hit_no", "next_page", "prev_page") == sorted(
        [(1, 0, 0, 1), (1, 1, 1, 0), (1, 2, 0, 0), (None, 0, 0, 1), (None, 1, 1, 0), (None, 2, 0, 0)], key=repr)
    assert search.paged_hits(numbered, 1, 2).where("doc_id IS NULL").count() == 2
    edited = pages.edit_pages(table.withColumn("rotation", F.lit(0)), rotate="1:90", delete="2")
    assert rows(edited, "doc_id", "page") == sorted([(1, 0), (None, 0)], key=repr)
    plan = spark.createDataFrame([(None, 0, 1), (None, 1, 1), (7, 0, None)], "target_id bigint, ordinal int, doc_id bigint")
    merged = rows(pages.merge_documents(table, plan), "target_id", "page", "source_page")
    assert merged == sorted([(None, 0, 0), (None, 1, 1), (None, 2, 0), (None, 3, 1), (7, 0, 0), (7, 1, 1)], key=repr)
