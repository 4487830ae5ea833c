import random
from collections import defaultdict

import samples
from quirelake.llm.suffix_dedup import cut_repeats, repeated_passages


def brute(rows, passage):
    owners, texts = defaultdict(set), []
    for key, text in rows:
        words = (text or "").encode().lower().split()
        texts.append((key, words))
        for k in range(len(words) - passage + 1):
            owners[tuple(words[k : k + passage])].add(-1 if key is None else key)
    covered = defaultdict(set)
    for key, words in texts:
        mine = -1 if key is None else key
        for k in range(len(words) - passage + 1):
            held = owners[tuple(words[k : k + passage])]
            if len(held) > 1:
                covered[mine, min(held) == mine] |= set(range(k, k + passage))
    return dict(covered)


def found(df, **how):
    covered = defaultdict(set)
    for r in repeated_passages(df, **how).collect():
        assert r["n_words"] == r["end"] - r["start"] and r["other_id"] != r["doc_id"]
        covered[-1 if r["doc_id"] is None else r["doc_id"], r["first"]] |= set(range(r["start"], r["end"]))
    return dict(covered)


def corpus():
    """Few words, passages cut short at either end, and loops within a text."""
    draw = random.Random(7)
    shared = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(30)) for _ in range(90)) for _ in range(4)]
    rows = []
    for k in range(80):
        words = [draw.choice("abcdefgh") + str(draw.randrange(30)) for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(3)):
            part = draw.choice(shared).split()
            a, b = sorted((draw.randrange(91), draw.randrange(91)))
            at = draw.randrange(len(words) + 1)
            words[at:at] = part[a:b]
        rows.append((k, " ".join(words + ["loop it"] * draw.choice([0, 0, 40]))))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = samples.documents(spark, rows)
    for passage, prefix in ((20, 6), (50, 16), (12, 12)):
        want = brute(rows, passage)
        assert found(df, passage=passage, prefix=prefix) == want
        # Runs too long for a task go window by window over the cluster.
        assert found(df, passage=passage, prefix=prefix, run=3) == want


def test_odd_rows(spark):
    rows = samples.odd_rows()
    assert found(samples.documents(spark, rows)) == brute(rows, 50)
    rows = [(None, samples.sentence(1, 80)), (3, samples.sentence(1, 80)), (3, samples.sentence(1, 80))]
    assert found(samples.documents(spark, rows)) == brute(rows, 50)
    assert repeated_passages(samples.documents(spark, [])).count() == 0


def test_common_passage_and_cut(spark):
    shared = samples.sentence(77, 60)
    rows = [(k, f"own{k} {samples.sentence(k, 20)} {shared} tail{k}") for k in range(200)]
    df = samples.documents(spark, rows)
    assert found(df, run=16) == brute(rows, 50)
    cut = cut_repeats(df)
    assert cut.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert shared in texts[0] and not any(shared in texts[k] or f"tail{k}" not in texts[k] for k in range(1, 200))


def test_neighbours_share_words_not_hashes():
    import numpy as np
    import pyarrow as pa
    from quirelake.llm import suffix_dedup as sd

    # Suffixes in sorted order; the third agrees with its neighbours for two words only.
    suffix = pa.array([b"a b c d ", b"a b c d ", b"a b x d "], pa.binary())
    before = pa.array([b"p ", b"q ", b"p "], pa.binary())
    heads, docs, starts = np.full(3, 7), np.array([1, 2, 3]), np.array([10, 20, 30])
    got = {(d, s, e) for d, s, e in zip(*sd._compare(heads, docs, starts, before, suffix, 4, 2)[:3])}
    assert got == {(1, 11, 15), (2, 21, 25)}
    # The last window of a suffix starts at its position, so shorter windows end sooner.
    suffix = pa.array([b"a b c ", b"a b c ", b"a b x "], pa.binary())
    got = {(d, s, e) for d, s, e in zip(*sd._compare(heads, docs, starts, before, suffix, 3, 2)[:3])}
    assert got == {(1, 10, 13), (1, 11, 14), (2, 21, 24), (3, 30, 33)}


def test_loops_of_a_crowded_prefix_are_ranges_not_places(spark):
    from quirelake.llm import suffix_dedup as sd
    from quirelake.llm.bitmaps import bitmap

    rows = [(k, f"own{k} " + "to and fro " * 300 + f"{samples.sentence(k, 20)} " + "to and fro " * 200) for k in range(12)]
    df = samples.documents(spark, rows)
    assert found(df, run=16) == brute(rows, 50)
    texts = df.select("doc_id", "text")
    counts = sd.prefix_counts(texts, 50, 16).where("least <> most").selectExpr("prefix AS h", "n")
    send = spark.sparkContext.broadcast
    few = sd.sparse_suffixes(texts, send(bitmap(counts)), send(bitmap(counts.where("n > 16"))), sd.BITS, 50, 16)
    ranges = sd._crowds(few.where("window IS NOT NULL"))
    # Some 1,400 places of three windows a document; each window has two ranges.
    assert 0 < ranges.count() <= 12 * 3 * 3
