import random

import numpy as np
import samples
import xxhash
from quirelake.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    marks = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(m >> b & 1 for m in marks) * 2 > len(marks)) if marks else 0


def brute(rows):
    prints = [(k, plain_fingerprint(t)) for k, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, f"{p:016x}", least.get(find(i))) for i, (k, p) in enumerate(prints)), key=repr)


def test_odd_rows(spark):
    rows = samples.odd_rows()
    assert sorted(map(tuple, simhash.near_groups(samples.documents(spark, rows)).collect()), key=repr) == brute(rows)


def test_near_copies_and_tiny_buckets(spark):
    draw = random.Random(3)
    rows = []
    for i in range(120):
        words = samples.sentence(i % 10, 300).split()
        for _ in range(draw.randrange(3)):
            words[draw.randrange(300)] = f"other{draw.randrange(99)}"
        rows.append((i, " ".join(words)))
    want = brute(rows)
    df = samples.documents(spark, rows)
    assert sorted(map(tuple, simhash.near_groups(df).collect()), key=repr) == want
    # Every bucket is cut finer, several times over.
    assert sorted(map(tuple, simhash.near_groups(df, limit=2).collect()), key=repr) == want
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})


def test_no_signature_is_lost_when_parts_differ_in_width(spark):
    """All fingerprints in one ball: every bucket is hot down to the last cut."""
    prints = [0] + [1 << a for a in range(64)] + [(1 << a) | (1 << b) for a in range(0, 64, 5) for b in range(a)]
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    for parts in ([(list(range(20)), 0), (list(range(20, 41)), 0), (list(range(41, 64)), 0)], [(list(range(30)), 1), (list(range(30, 64)), 0)]):
        rows = simhash.buckets(simhash.signatures(df, parts), limit=2)
        linked = {0}
        edges = [(r["a"], r["b"]) for r in simhash.bucket_links(rows).collect()]
        for _ in range(6):
            linked |= {x for e in edges if linked & set(e) for x in e}
        assert linked == {simhash._signed(p) for p in prints}


def test_thresholds_miss_no_link():
    draw = np.random.default_rng(1)
    rates = draw.uniform(0.05, 0.95, 64)
    together = np.outer(rates, rates) * 1000
    np.fill_diagonal(together, rates * 1000)
    for rows in (100, 10**6, 10**11):
        for groups in (1, 2, 3, 4):
            parts = simhash.correlated_groups(1000, together, groups)
            assert sorted(b for p in parts for b in p) == list(range(64))
            _, chosen = simhash.allocate(rows, rates, parts)
            assert sum(t + 1 for t in chosen) == 3
    many = simhash.allocate(10**11, rates, simhash.correlated_groups(1000, together, 2))[1]
    assert sorted(many) == [0, 1]


def test_empty(spark):
    assert simhash.near_groups(samples.documents(spark, [])).count() == 0


def test_shared_and_null_ids_stay_apart(spark):
    """Different texts under one id, or none, are not linked by it."""
    rows = [(key, samples.sentence(seed, 80)) for key, seed in ((None, 1), (None, 2), (None, 3), (7, 4), (7, 5), (8, 4), (None, 5), (8, 6))]
    got = simhash.drop_near_copies(samples.documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted((r for r in rows if r not in (rows[5], rows[6])), key=repr)
