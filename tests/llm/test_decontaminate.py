import hashlib
import re

import samples
from pyspark.sql import functions as F
from quirelake.llm import decontaminate as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, window=10):
    owners = {}
    for item, text in items:
        found = plain_words(text)
        width = min(window, len(found))
        for k in range(len(found) - width + 1 if width else 0):
            owners.setdefault(tuple(found[k : k + width]), set()).add("" if item is None else str(item))
    out = []
    for key, text in docs:
        found, hit, held = plain_words(text), set(), set()
        for width in {len(o) for o in owners}:
            for k in range(len(found) - width + 1):
                if owner := owners.get(tuple(found[k : k + width])):
                    hit |= set(range(k, k + width))
                    held |= owner
        out.append((key, len(found), len(hit), sorted(held)))
    return sorted(out, key=repr)


ITEMS = [(11, samples.sentence(1, 30)), (2, samples.sentence(1, 12).upper()), (3, "ünïcödé, 漢字!"), (4, None), (5, "..."), (6, "a"), (None, samples.sentence(2, 40)), (2, samples.sentence(4, 15))]
DOCS = [*samples.odd_rows(), (20, samples.sentence(9, 500) + ". " + samples.sentence(1, 30) + "!\n" + samples.sentence(8, 99) + " " + samples.sentence(4, 15))]


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    df, items = samples.documents(spark, DOCS), benchmark(spark, ITEMS)
    want = brute(DOCS, ITEMS)
    for set_words in (D.SET_WORDS, 40):  # one set of whole items, and several of pieces
        got = D.contamination(df, items, set_words=set_words).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == want


def test_query_digest(spark, data):
    from quirelake.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(k, n, hit, len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), hit > 0) for k, n, hit, held in brute(docs, items)]
    got = QUERIES["op6_window_decontamination"](spark, data).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_dropped_and_cut(spark):
    df, items = samples.documents(spark, DOCS), benchmark(spark, ITEMS)
    clean = {k for k, _, hit, _ in brute(DOCS, ITEMS) if not hit}
    kept = D.drop_contaminated(df, items)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == clean
    cut = D.cut_contaminated(df, items)
    assert cut.columns == df.columns and cut.count() == df.count()
    text = cut.where(F.col("doc_id") == 20).first()["text"]
    assert text == samples.sentence(9, 500) + ". !\n" + samples.sentence(8, 99) + " "


def test_empty_tables(spark):
    df, none = samples.documents(spark, DOCS), benchmark(spark, [])
    assert {r["n_hit"] for r in D.contamination(df, none).collect()} == {0}
    assert D.contamination(samples.documents(spark, []), benchmark(spark, ITEMS)).count() == 0


def test_built_set_is_bounded():
    """0.7 MB of new words take less than 210 bytes a word, as what is sent and unpacked."""
    import pickle
    import sys

    text = " ".join(f"w{k:05d}" for k in range(100_000)).encode()
    built = D.TestSet([("a", text)])
    held = sum(x.nbytes for table in built.tables.values() for x in table[:3]) + built.marks.nbytes
    held += sys.getsizeof(built.vocabulary) + sum(sys.getsizeof(w) + 32 for w in built.vocabulary)
    assert held < 210 * 100_000 and len(pickle.dumps(built)) < 100 * 100_000 + (1 << D.FILTER_BITS)
    assert built.scan(b"x " + text + b" y") == (100_002, [(1, 100_001)], ["a"])
