import zlib

import numpy as np
import samples
from quirelake.llm import quality


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=400):
    rows, labels = [], []
    for k in range(n):
        good = k % 3 != 0
        text = samples.sentence(k, 40 + k % 50)
        rows.append((k, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((k, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = quality.quality_scores(samples.documents(spark, rows), labelled(spark, labels)).collect()
    right = [(r["predicted"] == labels[r["doc_id"]][1]) for r in got if r["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(150)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q, t) for k, q, t in labels]
    df = samples.documents(spark, rows)
    one, two = (sorted((r["doc_id"], r["score"]) for r in quality.quality_scores(df, labelled(spark, x)).collect()) for x in (labels, flipped))
    assert one == two


def test_odd_rows_and_no_labels(spark):
    df = samples.documents(spark, samples.odd_rows())
    got = quality.quality_scores(df, labelled(spark, [])).collect()
    assert len(got) == len(samples.odd_rows()) and {r["score"] for r in got} == {0.5}
    rows, labels = corpus(90)
    scored = quality.quality_scores(samples.documents(spark, rows + samples.odd_rows()), labelled(spark, [*labels, (None, 1, 0), (1, None, 0), (3, 0, 0)])).collect()
    assert len(scored) == 90 + len(samples.odd_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    empty = [r["score"] for r in scored if r["doc_id"] is None]
    assert len(empty) == 2
    assert quality.quality_scores(samples.documents(spark, []), labelled(spark, labels)).count() == 0


def test_keep_good_keeps_columns(spark):
    rows, labels = corpus()
    df = samples.documents(spark, rows)
    kept = quality.keep_good(df, labelled(spark, labels))
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids ^ {k for k, q, _ in labels if q}) < 12


def test_temperature_softens_overconfidence():
    draw = np.random.default_rng(0)
    truth = draw.normal(size=4000)
    y = (draw.uniform(size=4000) < 1 / (1 + np.exp(-truth))).astype(float)
    assert 2.5 < quality.temperature(3 * truth, y) < 3.6


def test_context_sums_match_plain_loops():
    places, signs = quality.index_vectors()
    texts = ["the cat sat on the mat", "", "a", samples.sentence(1, 50)]
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for text in texts:
        ids = quality.tokens(text)
        for k in range(len(ids)):
            for j in range(max(0, k - quality.REACH), min(len(ids), k + quality.REACH + 1)):
                if j != k:
                    for p in range(quality.PLACES):
                        want[ids[k], places[p][ids[j]]] += signs[p][ids[j]]
    assert (quality.context_sums(iter(texts)) == want).all()


def test_many_rows_of_one_labelled_id(spark):
    """The driver learns from one text of an id, whatever the order of its rows."""
    rows, labels = corpus(150)
    hot = next(k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2)
    more = rows + [(hot, samples.sentence(k, 30)) for k in range(1000, 1200)]
    one, two = (sorted((r["doc_id"], r["score"]) for r in quality.quality_scores(samples.documents(spark, x), labelled(spark, labels)).collect()) for x in (more, more[::-1]))
    assert np.allclose([r[1] for r in one], [r[1] for r in two], atol=1e-6) and len(one) == len(more)
