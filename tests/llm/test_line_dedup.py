import random

import samples
from quirelake.llm.line_dedup import without_repeats

SPACE = " \t\n\r\x0b\x0c"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars=10, docs=2):
    last = float("inf")
    key = lambda line: line.strip(SPACE).translate(FOLD)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < chars or len(holders[key(x)]) < docs or min(holders[key(x)]) == (last if i is None else i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def got(df, **how):
    found = without_repeats(df, **how)
    assert found.columns == [*df.columns, "n_lines", "n_dropped"]
    return sorted(((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in found.collect()), key=repr)


def corpus():
    draw = random.Random(3)
    common = [f"common line number {k}" for k in range(6)] + ["Ünïcödé 漢字 line", "short", "exactly 10", "only nine", "", "   \t "]
    rows = []
    for k in range(120):
        lines = [draw.choice(common) if draw.random() < 0.6 else f"own line {k} {draw.random()}" for _ in range(draw.randrange(9))]
        lines = [draw.choice(["", " ", "\t\x0b"]) + (x.upper() if draw.random() < 0.3 else x) + draw.choice(["", "\r", "  "]) for x in lines]
        rows.append((None if k % 40 == 7 else k % 100, "\n".join(lines) if k % 30 else None))
    return rows + [(500, "trailing line feeds here\n\n\n"), (501, "trailing line feeds here\n")]


def test_against_brute_force(spark):
    rows = corpus()
    df = samples.documents(spark, rows)
    assert got(df) == brute(rows)
    assert got(df, least_docs=5) == brute(rows, docs=5)
    assert got(df, least_chars=1, least_docs=3) == brute(rows, 1, 3)


def test_odd_rows(spark):
    rows = samples.odd_rows() + [(4, samples.sentence(1, 60)), (None, samples.sentence(3, 20)), (11, "same line in a null document"), (None, "same line in a null document")]
    assert got(samples.documents(spark, rows)) == brute(rows)
    assert without_repeats(samples.documents(spark, [])).count() == 0


def test_one_line_everywhere_and_a_giant(spark):
    giant = "\n".join(f"line {k} of a giant text" for k in range(60_000))
    rows = [(k, f"Terms and conditions apply\nown {k} text\nTERMS AND CONDITIONS APPLY") for k in range(900)] + [(1000, giant), (1001, giant + "\nlast line of all")]
    found = {r[0]: r for r in got(samples.documents(spark, rows))}
    assert found[0][3] == 0 and all(found[k][1] == f"own {k} text" for k in range(1, 900))
    assert found[1000][1] == giant and found[1001] == (1001, "last line of all", 60_001, 60_000)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a line that repeats", 7, "k"), (2, "a line that repeats", 8, "k")], "doc_id long, text string, n_lines int, `_gone` string")
    found = without_repeats(df)
    assert found.columns == [*df.columns, "n_lines_", "n_dropped"]
    assert sorted(map(tuple, found.collect())) == [(1, "a line that repeats", 7, "k", 1, 0), (2, "", 8, "k", 1, 1)]
