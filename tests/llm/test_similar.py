import random

import corpus_pipeline
import samples
from quirelake.llm import similar, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} if words else {b""}


def brute(rows):
    """The rows that stay: the smallest id of each component of pairs of Jaccard 0.8."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (k is None, k or 0))
    return sorted((None if none else k for none, k in least.values()), key=repr)


def kept(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


def edited():
    """Copies of ten texts with up to nine words changed, so that similarities lie on both sides of 0.8."""
    draw = random.Random(5)
    rows = []
    for i in range(150):
        words = samples.sentence(i % 10, 200).split()
        for _ in range(draw.randrange(10)):
            words[draw.randrange(200)] = f"other{draw.randrange(99)}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_stage_links_all_similar_texts(spark, data):
    rows = edited()
    want = brute(rows)
    df = samples.documents(spark, rows)
    out = corpus_pipeline.near(spark, df, data)
    assert out.columns == df.columns and kept(out) == want
    assert simhash.drop_near_copies(df).count() > len(want)  # what 2 bits leave


def test_a_chain_of_edits_is_one_group(spark):
    """Neighbours are similar, the ends are not, and few texts are held at a time."""
    words = samples.sentence(3, 120).split()
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[(7 * k) % 120] = f"new{k}"
    rows += edited()[:40]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = samples.documents(spark, rows)
    for held in (1, 3, 1024):
        found = similar.similar_groups(df, held=held).collect()
        least = {}
        for r in found:
            least[r["root"]] = min(least.get(r["root"], r["doc_id"]), r["doc_id"])
        assert sorted(least.values()) == brute(rows)


def test_odd_rows(spark):
    rows = samples.odd_rows()
    assert kept(similar.drop_similar(samples.documents(spark, rows))) == brute(rows)
    assert similar.drop_similar(samples.documents(spark, [])).count() == 0


def test_bands_find_pairs_at_the_limit():
    draw = random.Random(6)
    for _ in range(300):
        a = [draw.randrange(1 << 63) for _ in range(90)]
        b = a[:80] + [draw.randrange(1 << 63) for _ in range(10)]  # 80 of 100 shared
        one, two = (similar.np.unique(similar.np.array(x, similar.np.uint64)) for x in (a, b))
        assert (similar.bands(one) == similar.bands(two)).any()


def test_simhash_proposes_pairs(spark):
    """Operator 7's search proposes texts within its bits, and its links count if exact Jaccard holds."""
    texts = [t for _, t in edited()] + [None, "", "a b c"]
    marks = similar._marks(spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "doc_id long, mark long, text string")).cache()
    node = {r["doc_id"]: (r["node"], r["n"]) for r in marks.collect()}
    prints = {node[k]: simhash.fingerprint((t or "").encode()) for k, t in enumerate(texts)}
    got = {(r["a"], r["b"]) for r in similar.simhash_pairs(marks, 0.0).collect()}
    parent = {k[0]: k[0] for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    close = {(a[0], b[0]) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2}
    for a, b in got:
        parent[find(a)] = find(b)
    assert close and all(find(a) == find(b) for a, b in close)
    links = {k: k for k in parent}
    parent = links
    for a, b in close:
        parent[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in got) and len(got) <= 2 * len(prints)
