"""Graphs, trees, aligned versions and the build of pages against brute force."""

import difflib
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows

from quirelake.operators import alignment, columns, outline, references, tables
from test_operators import word_table


# --- references ---------------------------------------------------------------

def brute_reach(roots, edges):
    seen, todo = set(roots), list(roots)
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    while todo:
        for b in after[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return seen


def test_reachability(spark):
    draw = random.Random(4)
    nodes = [(d, n) for d in (1, 2) for n in range(60)]
    edges = [(d, n, d, draw.randrange(60)) for d, n in nodes for _ in range(draw.choice([0, 0, 1, 2]))]
    edges += [(1, 100, 1, 101), (1, 101, 1, 100), (1, 7, None, 3), (None, 3, 1, 100), (2, 5, 1, 9)] * 3
    # A chain longer than the marked tables that stand side by side.
    edges += [(3, n, 3, n + 1) for n in range(20)]
    roots = [(1, 0), (2, 5), (3, 0), (None, 3), (9, 9)]
    df = spark.createDataFrame(edges, "doc_id bigint, object_id bigint, to_doc_id bigint, to_object_id bigint")
    start = spark.createDataFrame(roots, "doc_id bigint, object_id bigint")
    want = brute_reach([r for r in roots if None not in r], [(e[:2], e[2:]) for e in edges if None not in e])
    assert set(map(tuple, references.reachable(start, df).collect())) == want
    objects = [(*n, "x") for n in [*nodes, (1, 100), (1, 101), (None, 3), (1, None), (3, 20), (3, 21)]]
    left = references.unreachable(spark.createDataFrame(objects, "doc_id bigint, object_id bigint, name string"), start, df)
    assert left.columns == ["doc_id", "object_id", "name"]
    assert rows(left) == sorted([o for o in objects if o[:2] not in want], key=repr)


def test_nothing_to_reach(spark):
    none = spark.createDataFrame([], "object_id bigint")
    edges = spark.createDataFrame([(1, 2)], "object_id bigint, to_object_id bigint")
    assert references.reachable(none, edges, ["object_id"]).count() == 0
    assert rows(references.unreachable(spark.createDataFrame([(1,)], "object_id bigint"), none, edges, ["object_id"])) == [(1,)]


# --- trees --------------------------------------------------------------------

TREE = "doc_id bigint, node_id bigint, parent_id bigint, ordinal bigint"


def brute_order(data):
    out = []
    for doc in {d for d, *_ in data}:
        below = defaultdict(list)
        for d, n, p, o in set(data):
            if d == doc:
                below[p].append((-1 if o is None else o, n))
        place, todo = 0, [(n, 0) for _, n in sorted(below[None], reverse=True)]
        while todo:
            n, depth = todo.pop()
            out.append((doc, n, place, depth))
            place += 1
            todo += [(c, depth + 1) for _, c in sorted(below[n], reverse=True)]
    return sorted(out, key=repr)


def test_preorder_of_random_trees(spark):
    draw = random.Random(6)
    data = []
    for doc in (1, 2, None):
        for n in range(80):
            data.append((doc, n, None if n < 2 or draw.random() < 0.1 else draw.randrange(n), draw.choice([None, 0, 1, 2, 70_000, 200_000])))
    data += [(4, 1, None, 0), (4, 2, 99, 0), (4, 3, 2, 0), (4, 5, 6, 0), (4, 6, 5, 0), (4, 7, 1, 3)] + data[:3]
    got = rows(outline.preorder(spark.createDataFrame(data, TREE)), "doc_id", "node_id", "reading_order", "depth")
    assert got == brute_order(data)


def test_preorder_of_a_deep_chain_and_a_wide_node(spark):
    chain = spark.range(100_000).selectExpr("1L AS doc_id", "id AS node_id", "nullif(id, 0) - 1 AS parent_id", "0L AS ordinal")
    wide = spark.range(100_000).selectExpr("2L AS doc_id", "id AS node_id", "if(id = 0, null, 0) AS parent_id", "-id AS ordinal")
    found = outline.preorder(chain.unionByName(wide))
    wrong = found.where("doc_id = 1 AND (reading_order <> node_id OR depth <> node_id) OR doc_id = 2 AND node_id > 0 AND (reading_order <> 100000 - node_id OR depth <> 1)")
    assert found.count() == 200_000 and wrong.count() == 0


def test_empty_outline(spark):
    assert outline.preorder(spark.createDataFrame([], TREE)).count() == 0


def test_headings_find_their_parents(spark):
    draw = random.Random(2)
    data = [(d, n, draw.randrange(1, 7), f"t{n}") for d in range(5) for n in range(20)]
    got = rows(outline.heading_outline(spark.createDataFrame(data, "doc_id bigint, ordinal int, level int, title string")), "doc_id", "node_id", "parent_id")
    want = [(d, n, max((m for e, m, k, _ in data if e == d and m < n and k < level), default=None)) for d, n, level, _ in data]
    assert got == sorted(want, key=repr)


# --- aligned versions -----------------------------------------------------------

LINES = "doc_id bigint, line_no int, text string"


def lines_of(docs):
    return [(d, n, t) for d, lines in docs.items() for n, t in enumerate(lines)]


def aligned(spark, a, b):
    found = alignment.align_lines(spark.createDataFrame(lines_of(a), LINES), spark.createDataFrame(lines_of(b), LINES), same=True)
    out = defaultdict(list)
    for r in found.collect():
        out[r["doc_id"]].append((r["left_no"], r["right_no"], r["state"], r["left"], r["right"]))
    return out


def check(a, b, found):
    """Every line stands once, and the states say what they must."""
    assert Counter(x[0] for x in found if x[0] is not None) == Counter(range(len(a)))
    assert Counter(x[1] for x in found if x[1] is not None) == Counter(range(len(b)))
    for left, right, state, one, other in found:
        assert (left is None) == (state == "inserted") and (right is None) == (state == "deleted")
        assert (left is None or one == a[left]) and (right is None or other == b[right])
        assert ((one or "") == (other or "")) == (state in ("same", "moved")) or None in (left, right)
    kept = sorted(x[:2] for x in found if x[2] == "same")
    assert all(x[1] < y[1] for x, y in zip(kept, kept[1:]))
    lost = Counter(x[3] or "" for x in found if x[2] in ("deleted", "changed")), Counter(x[4] or "" for x in found if x[2] in ("inserted", "changed"))
    assert not lost[0] & lost[1], "a text left on both sides is moved"
    return len(kept)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_lines_that_stand_once_are_aligned_as_long_as_can_be(spark):
    draw = random.Random(8)
    a, b = {}, {}
    for doc in (1, 2, 3, None):
        one = [f"line {k}" for k in range(60)]
        other = [x for x in one if draw.random() < 0.8]
        for _ in range(4):
            at, size, to = draw.randrange(50), draw.randrange(12), draw.randrange(50)
            part = other[at : at + size]
            del other[at : at + size]
            other[to:to] = part
        for _ in range(8):
            other.insert(draw.randrange(len(other)), f"new {draw.random()}")
        a[doc], b[doc] = one, other
    a[7], b[8], a[9], b[9] = ["only here"], ["only there", ""], ["x"], ["x"]
    found = aligned(spark, a, b)
    for doc in {*a, *b}:
        assert check(a.get(doc, []), b.get(doc, []), found[doc]) == common(a.get(doc, []), b.get(doc, []))


def test_repeated_lines(spark):
    draw = random.Random(9)
    a, b = {}, {}
    for doc in range(12):
        one = [draw.choice(["", "}", "a", "b", None, f"u{k}"]) for k in range(40)]
        matcher = [x for x in one if draw.random() < 0.85]
        for _ in range(5):
            matcher.insert(draw.randrange(len(matcher) + 1), draw.choice(["", "}", "new"]))
        a[doc], b[doc] = one, matcher
    found = aligned(spark, a, b)
    for doc in a:
        kept = check(a[doc], b[doc], found[doc])
        plain = lambda lines: [x or "" for x in lines]
        most = common(plain(a[doc]), plain(b[doc]))
        blocks = difflib.SequenceMatcher(None, plain(a[doc]), plain(b[doc]), autojunk=False).get_matching_blocks()
        assert most >= kept >= 0.7 * sum(m.size for m in blocks)


def test_an_inserted_line_changes_nothing_else(spark):
    one = [f"line {k % 7} {k // 3}" for k in range(50)]
    a, b = {1: one, 2: one, 3: one}, {1: ["first", *one], 2: [*one[:20], "mid", *one[20:]], 3: one[10:] + one[:10]}
    found = aligned(spark, a, b)
    for doc in (1, 2):
        assert [x[2] for x in found[doc] if x[2] != "same"] == ["inserted"]
    assert Counter(x[2] for x in found[3]) == {"same": 40, "moved": 10}


def test_small_documents_are_aligned_where_their_lines_meet(spark, monkeypatch):
    draw = random.Random(12)
    a, b = {}, {}
    for doc in (*range(8), None):
        one = [draw.choice(["", "}", "a", None, f"u{k}", f"v{k}"]) for k in range(50)]
        other = [x for x in one if draw.random() < 0.8]
        part = other[5:12]
        del other[5:12]
        other[20:20] = part
        for _ in range(4):
            other.insert(draw.randrange(len(other)), draw.choice(["", "new", "a"]))
        a[doc], b[doc] = one, other
    a[20], b[21] = ["only here", ""], ["only there"]
    a, b = (spark.createDataFrame(lines_of(x), LINES) for x in (a, b))
    settled = []
    monkeypatch.setattr(alignment, "settle", lambda df, label, do=alignment.settle: settled.append(label) or do(df, label))
    want = rows(alignment.align_lines(a, b, same=True, walked=0))
    assert len(settled) > 5
    settled.clear()
    walked = alignment.align_lines(a, b, same=True)
    assert rows(walked) == want and settled == ["aligned-large"]
    assert rows(alignment.align_lines(a, b, same=True, walked=90)) == want
    # Rows of equal number are not lost.
    twice = alignment.align_lines(a.unionByName(a), b, same=True)
    assert twice.where("left_no IS NOT NULL").count() == 2 * a.count()


def test_heaviest_rise():
    draw = random.Random(1)
    for _ in range(200):
        starts = draw.sample(range(30), draw.randrange(9))
        weights = [draw.randrange(1, 5) for _ in starts]
        chain = alignment.heaviest_rise(starts, weights)
        assert all(x < y and starts[x] < starts[y] for x, y in zip(chain, chain[1:]))
        best = 0
        for mask in range(1 << len(starts)):
            some = [k for k in range(len(starts)) if mask >> k & 1]
            if all(starts[x] < starts[y] for x, y in zip(some, some[1:])):
                best = max(best, sum(weights[k] for k in some))
        assert sum(weights[k] for k in chain) == best


# --- columns --------------------------------------------------------------------

def setting(blocks):
    """Words of (page, x, y, lines) blocks: 10 points a letter, 20 between words, 15 a line."""
    out = []
    for page, x, y, lines in blocks:
        for n, line in enumerate(lines):
            at = x
            for word in line.split():
                out.append((1, page, len(out), word, at, y + 15.0 * n, 10.0 * len(word), 10.0))
                at += 10.0 * len(word) + 20
    random.Random(0).shuffle(out)
    return out


def test_columns_are_read_one_by_one(spark):
    text = [["the first column", "has some lines", "and ends"], ["a second one", "beside it"], ["third", "and last", "of all", "here"]]
    blocks = [(0, 0.0, 0.0, ["a heading over all of the columns of this page and more of it"])]
    blocks += [(0, 300.0 * k, 50.0, t) for k, t in enumerate(text)] + [(0, 0.0, 150.0, ["a foot line under all"])]
    blocks += [(1, 0.0, 0.0, text[0] + text[1])]
    # A block in two columns inside the right one of two columns.
    blocks += [(2, 0.0, 0.0, ["left " + "x" * 20, "more"]), (2, 400.0, 0.0, ["right top " + "y" * 20]), (2, 400.0, 60.0, ["aa", "bb"]), (2, 600.0, 60.0, ["cc", "dd"])]
    got = dict(rows(columns.column_text(word_table(spark, setting(blocks))), "page", "text"))
    assert got[0].split("\n") == ["a heading over all of the columns of this page and more of it", *text[0], *text[1], *text[2], "a foot line under all"]
    assert got[1].split("\n") == text[0] + text[1]
    assert got[2].split("\n") == ["left " + "x" * 20, "more", "right top " + "y" * 20, "aa", "bb", "cc", "dd"]


def test_no_words_no_regions(spark):
    assert columns.column_text(word_table(spark, [])).count() == 0


# --- ruled tables -----------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_ragged_columns_and_spanning_cells(spark, seed):
    draw = random.Random(seed)
    data, no = [], 0

    def put(page, line, x, words):
        nonlocal no
        for word in words:
            data.append((1, page, no, word, x, 20.0 * line, 8.0 * len(word), 10.0))
            x, no = x + 8.0 * len(word) + 5.0, no + 1

    put(0, 0, 0.0, ["one", "line", "of", "prose", "without", "any", "gap"])
    grid = [[f"r{r}c{c}" if draw.random() < 0.8 or r == 3 else "" for c in range(4)] for r in range(6)]
    for r, line in enumerate(grid):
        if sum(map(bool, line)) < 2:
            grid[r] = line = [f"r{r}c{c}" for c in range(4)]
        for c, cell in enumerate(line):
            if cell:
                # Ragged by up to 12 points on either side of a column 100 wide.
                put(0, r + 1, 100.0 * c + draw.random() * 12, [cell, "x"] if draw.random() < 0.5 else [cell])
    put(1, 0, 0.0, ["head"])
    put(1, 1, 0.0, ["a" * 14])
    put(1, 1, 200.0, ["b"])
    put(1, 2, 0.0, ["c"])
    put(1, 2, 100.0, ["d"])
    put(1, 2, 200.0, ["e"])
    found = tables.ruled_tables(word_table(spark, data)).collect()
    got = {(r["page"], r["row_no"], r["column"], r["last_column"]): r["text"].split()[0] for r in found}
    want = {(0, r, c, c): cell for r, line in enumerate(grid) for c, cell in enumerate(line) if cell}
    want |= {(1, 0, 0, 1): "a" * 14, (1, 0, 2, 2): "b", (1, 1, 0, 0): "c", (1, 1, 1, 1): "d", (1, 1, 2, 2): "e"}
    assert got == want and {r["table_no"] for r in found} == {0}


# --- markup ---------------------------------------------------------------------

def test_hidden_markup_and_unquoted_values(spark):
    from quirelake.operators import markup

    page = """<html lang=de><!-- <title>No</title> <a href="x"> --><script>var a = '<a href="y">'</script><title>Yes</title>
    <style>h1 {}</style><h1>One</h1> <a href=/plain> <a class=k href='it"s'> <a href="it's"> <h3>Deep <b>down</b></h3> <!-- open <h2>Gone</h2> <a href="z">"""
    html = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", "<!--" * 50_000), (4, "x", "<script>" * 50_000)], "doc_id bigint, url string, html string")
    assert rows(markup.markup_links(html), "doc_id", "url") == sorted([(1, "/plain"), (1, 'it"s'), (1, "it's")], key=repr)
    assert rows(markup.markup_headings(html), "ordinal", "level", "title") == [(0, 1, "One"), (1, 3, "Deep down")]
    assert rows(markup.markup_documents(html).where("doc_id = 1"), "title", "language") == [("Yes", "de")]


def test_preorder_walked_and_in_rounds(spark):
    """Documents above and below the bound, null ids and repeated rows give the same order both ways."""
    draw = random.Random(11)
    data = [(d, n, None if n == 0 or draw.random() < 0.1 else draw.randrange(n + (n % 9 == 0)), draw.choice([None, 0, 1, 2])) for d, size in ((1, 40), (2, 200), (None, 60)) for n in range(size)]
    data += [(1, 5, 2, 0), (1, None, None, 0), (2, 300, 999, 0), (2, 301, 302, 0), (2, 302, 301, 0)]
    table = spark.createDataFrame(data, TREE)
    names = ("doc_id", "node_id", "parent_id", "ordinal", "reading_order", "depth")
    rounds = rows(outline._toured(table), *names)
    for bound in (1 << 16, 100, 0):
        assert rows(outline.preorder(table, bound), *names) == rounds
    plan = outline._walked(table)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_a_page_is_cut_where_its_words_meet(spark, monkeypatch):
    data = [(d, 0, n, f"w{n}", x, y, 30.0, 12.0) for d in (1, 2, None) for n, (x, y) in enumerate([(50.0, 28.0), (50.0, 100.0), (300.0, 28.0), (300.0, 40.0)])]
    data += [(9, 0, 0, "a", None, 28.0, 30.0, 12.0), (9, 0, 1, "b", 50.0, 28.0, 30.0, 12.0)]
    words = spark.createDataFrame(data, "doc_id bigint, page int, word_no int, text string, x double, y double, width double, height double")
    settled = []
    monkeypatch.setattr(columns, "settle", lambda df, label, do=columns.settle: settled.append(df) or do(df, label))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = rows(columns.reading_regions(words), "doc_id", "word_no", "region")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted([(d, n, r) for d in (1, 2, None) for n, r in enumerate((0, 1, 2, 2))] + [(9, 0, 0), (9, 1, 0)], key=repr)
    # One sort holds a task's words, not one for each window over them.
    assert len(settled) == 1 and settled[0]._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
