"""Readers, writers and snapshots."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirelake.operators import tables
from quirelake.operators.pages import page_counts
from quirelake.session import shared_folder, work_folder
from quirelake.sources import corpus, sinks, snapshot


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")


def test_work_folder_follows_the_cluster_setting(spark):
    assert work_folder(spark, "x").startswith(shared_folder(spark))
    assert work_folder(spark, "x") != work_folder(spark, "x")


def test_paginate(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(25)))), (2, ""), (3, None)], "doc_id bigint, text string")
    pages = corpus.paginate(docs, 10)
    assert rows(pages, "doc_id", "page", "height") == [(1, 0, 792.0), (1, 1, 792.0), (1, 2, 792.0), (2, 0, 792.0), (3, 0, 0.0)]
    assert pages.filter("doc_id = 1 AND page = 2").first().text == "20\n21\n22\n23\n24"


def test_read_binary_reports_errors(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(b"a|b")
    (tmp_path / "bad.bin").write_bytes(b"!")
    (tmp_path / "locked.bin").write_bytes(b"?")
    (tmp_path / "large.bin").write_bytes(b"a" * 100)

    def extractor(content):
        if content == b"?":
            raise corpus.ExtractError("PasswordRequired")
        for i, part in enumerate(content.decode().split("|")):
            yield i, part
            if part == "!":
                raise ValueError("broken")

    got = corpus.read_binary(spark, str(tmp_path / "*.bin"), extractor, max_bytes=50)
    names = got.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    assert rows(names, "name", "page", "text", "error") == [
        ("bad.bin", None, None, "OpenFailed"), ("good.bin", 0, "a", None), ("good.bin", 1, "b", None),
        ("large.bin", None, None, "TooLarge"), ("locked.bin", None, None, "PasswordRequired"),
    ]


def test_state_json(spark):
    states = ['{"theme":"Dark","zoom":2.0}', '{"theme":"Dark","zoom":"big"}', "broken", "{}", None]
    df = spark.createDataFrame(list(enumerate(states)), "id int, state string")
    out = corpus.read_state_json(df, "state", "theme STRING, zoom DOUBLE", {"theme": "System", "zoom": 1.0})
    assert rows(out) == [(0, "Dark", 2.0), (1, "Dark", 1.0), (2, "System", 1.0), (3, "System", 1.0), (4, "System", 1.0)]


def test_snapshot_replaces_and_survives_a_broken_write(spark, folder):
    with pytest.raises(FileNotFoundError):
        snapshot.read_snapshot(spark, folder)
    snapshot.write_snapshot(spark.range(3), folder)
    old = snapshot.read_snapshot(spark, folder)
    with pytest.raises(Exception):
        snapshot.write_snapshot(spark.range(5).select(F.raise_error(F.lit("lost")).alias("id")), folder)
    assert snapshot.read_snapshot(spark, folder).count() == 3
    snapshot.write_snapshot(old.union(spark.range(10, 11)), folder)
    assert rows(snapshot.read_snapshot(spark, folder)) == [(0,), (1,), (10,), (2,)]


def test_a_broken_store_is_no_empty_one(spark, folder, tmp_path):
    snapshot.write_snapshot(spark.range(3), folder)
    with pytest.raises(Exception):
        snapshot.read_snapshot(spark, "nosuch://" + str(tmp_path))


def test_pages_are_cut_in_linear_time(spark):
    import time

    def seconds(lines):
        df = spark.createDataFrame([(1, "line of text\n" * lines)], "doc_id bigint, text string")
        start = time.perf_counter()
        assert corpus.paginate(df).count() == lines // 10 + 1
        return time.perf_counter() - start

    seconds(100)
    assert seconds(80_000) < 5


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "\n" * 9, "\n" * 10, "\n" * 11, "\n".join("abcdefghij"), "\n".join("abcdefghijk") + "\n"])
def test_pages_are_ten_lines_each(spark, text):
    lines = text.split("\n")
    want = ["\n".join(lines[k : k + 10]) for k in range(0, len(lines), 10)]
    got = corpus.paginate(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("page").collect()
    assert [r.text for r in got] == want


def pages(spark, n):
    return spark.range(n).select(
        F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("int").alias("page"), F.concat(F.lit("p<"), "id").alias("text"), F.lit("/d/book.pdf").alias("path")
    )


def test_export_parts_join_to_the_whole(spark):
    whole = sinks.export_text(pages(spark, 7), "html").first().text
    parts = [r.text for r in sinks.export_text(pages(spark, 7), "html", pages_per_part=3).orderBy("part").collect()]
    assert len(parts) == 3 and "".join(parts) == whole
    assert whole.startswith("<!DOCTYPE html>\n") and whole.endswith("</section>\n</body>\n</html>\n")
    assert "<h2>Page 7</h2><pre>p&lt;6</pre>" in whole


def test_written_export(spark, folder):
    sinks.write_export(sinks.export_text(pages(spark, 3), "md"), folder, folders=True)
    lines = [r.value for r in spark.read.text(f"{folder}/doc_id=1").collect()]
    assert lines[:3] == ["## Page 1", "", "p<0"]


@pytest.mark.parametrize("folders", [False, True])
def test_split_then_merge_is_identity(spark, folder, folders):
    source = pages(spark, 4)
    sinks.write_split(sinks.split_pages(source).withColumn("n", F.col("page")), folder, folders)
    back = spark.read.parquet(folder)
    assert rows(back, "n", "text") == rows(source, "page", "text")
    assert rows(back, "out_name")[0] == ("book_page_1",)
    assert sinks.split_pages(source, []).count() == 0
    assert rows(sinks.split_pages(source, [1, 9]), "page") == [(1,)]


def test_organised_pages_are_stored_in_order(spark, folder):
    source = pages(spark, 5)
    order = page_counts(source).select("doc_id", F.expr("array(4, 0, 2)").alias("order"))
    sinks.write_organised(source, order, folder)
    assert rows(spark.read.parquet(folder), "position", "source_page") == [(0, 4), (1, 0), (2, 2)]


def test_written_tables(spark, folder):
    words = spark.sql(
        "SELECT 1L doc_id, 0 page, CAST(id AS INT) word_no, concat('a,', id) text, 50D + 45 * (id % 2) x, 28D + 18 * floor(id / 2) y, 8D width, 12D height FROM range(4)"
    )
    sinks.write_tables(tables.detect_tables(words), folder, folders=True)
    assert rows(spark.read.text(f"{folder}/doc_id=1")) == [('"a,0","a,1"',), ('"a,2","a,3"',)]
    sinks.write_tables(tables.detect_tables(words), f"{folder}-sorted")
    assert rows(spark.read.parquet(f"{folder}-sorted"), "doc_id", "row_no", "line") == [(1, 0, '"a,0","a,1"'), (1, 1, '"a,2","a,3"')]


def test_an_export_is_stored_sorted_without_a_folder_per_document(spark, folder):
    exported = sinks.export_text(pages(spark, 7), "html", pages_per_part=3)
    sinks.write_export(exported, folder)
    assert rows(spark.read.parquet(folder), "doc_id", "part", "text") == rows(exported, "doc_id", "part", "text")


def test_only_changed_files_are_read_again(spark, tmp_path):
    import os

    from quirelake.sources.changes import refresh

    folder, store = tmp_path / "in", str(tmp_path / "manifest")
    folder.mkdir()

    def put(name, text, at):
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    def run():
        out = refresh(spark, str(folder), store, lambda content: enumerate(content.decode().split("|")))
        name = lambda path: path.rpartition("/")[2]
        return {name(r["path"]): r["state"] for r in out.changes.collect()}, sorted((name(r["path"]), r["page"], r["text"]) for r in out.pages.collect())

    for k, name in enumerate("abcd"):
        put(name, f"{name}|two", 1_000_000 + k)
    assert run() == ({n: "added" for n in "abcd"}, sorted((n, p, t) for n in "abcd" for p, t in enumerate((n, "two"))))
    # Content that changes behind an unchanged listing shows that no file is opened.
    put("a", "X|two", 1_000_000)
    assert run() == ({}, [])
    put("b", "new|pages|here", 2_000_000)
    put("c", "c|two", 2_000_000)
    put("e", "e", 1_500_000)
    (folder / "d").unlink()
    assert run() == ({"b": "changed", "c": "touched", "d": "gone", "e": "added"}, [("b", 0, "new"), ("b", 1, "pages"), ("b", 2, "here"), ("e", 0, "e")])
    assert run() == ({}, [])
    (folder / "e").unlink()
    assert run() == ({"e": "gone"}, []) and run() == ({}, [])


def test_small_files_share_a_frame(spark, monkeypatch):
    """Rows of small files leave together, those of a large one some at a time, and a bad one keeps its error."""
    monkeypatch.setattr(corpus, "ROWS_AT_ONCE", 10)

    def lines(content):
        if content == b"bad":
            raise ValueError
        yield from enumerate(content.decode().split(" "))

    texts = ["a b", "bad", " ".join(map(str, range(25))), "", "c"]
    files = spark.createDataFrame([(str(k), bytearray(t.encode())) for k, t in enumerate(texts)], "path string, content binary").coalesce(1)
    got = rows(corpus.extract(files, lines), "path", "page", "text", "error")
    wanted = [(str(k), n, w, None) for k, t in enumerate(texts) if t != "bad" for n, w in enumerate(t.split(" "))] + [("1", None, None, "OpenFailed")]
    assert got == sorted(wanted, key=repr)


def test_listing_takes_few_tasks(spark):
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 100
