"""The pipeline against a brute-force version of every stage but the classifier's scores."""

from collections import defaultdict

import corpus_pipeline
import pytest
import samples
import test_decontaminate
import test_packing
import test_similar
from quirelake.llm.quality import quality_scores
from quirelake.session import settle


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], data), f"test-{name}"))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(spark, data, stages):
    scores = quality_scores(stages[0], spark.read.parquet(f"{data}/labels.parquet")).collect()
    assert sorted(k for k, _ in pairs(stages[1])) == sorted(r["doc_id"] for r in scores if r["predicted"] == 1)


def test_exact(stages):
    last = defaultdict(int)
    for key, text in pairs(stages[1]):
        last[text] = max(last[text], key)
    assert sorted(pairs(stages[2])) == sorted((k, t) for t, k in last.items())


def test_near(stages):
    """Of texts that 5-word similarities of 0.8 connect, the one of smallest id stays."""
    assert sorted((k for k, _ in pairs(stages[3])), key=repr) == test_similar.brute(pairs(stages[2]))


def test_decontaminate_stage(spark, data, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {k for k, _, hit, _ in test_decontaminate.brute(pairs(stages[3]), items) if not hit}
    assert {k for k, _ in pairs(stages[4])} == clean


def test_packing_stage(stages):
    packed = stages[5].collect()
    test_packing.check(packed, 4096)
    total = defaultdict(int)
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert dict(total) == {k: len(test_packing.plain_ids(t)) for k, t in pairs(stages[4])}


def test_run(spark, data, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, stages[5].select("doc_id", "piece", "ids_crc32").collect()))


def test_odd_and_empty_tables(spark, data):
    for rows in (samples.odd_rows(), []):
        docs = samples.documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = settle(stage(spark, docs, data), f"test-odd-{name}")
            assert name == "packing" or docs.columns == before
        assert docs.count() >= (1 if rows else 0)
