import zlib
from collections import Counter, defaultdict

import samples
from pyspark.sql import functions as F
from quirelake.llm.numbering import gapless
from quirelake.llm.sharding import assign_shards, descend, grown, tree


def test_contract_columns(spark):
    rows = samples.odd_rows()
    got = assign_shards(samples.documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows if k is not None)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert assign_shards(samples.documents(spark, [])).count() == 0


def test_balance_and_growth(spark):
    ids = spark.range(20000)
    nodes = tree(16)
    placed = descend(descend(ids, F.col("id"), nodes, "old"), F.col("id"), grown(nodes), "new").collect()
    counts = Counter(r["old"] for r in placed)
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.15 * 20000 / 16
    moved = [r for r in placed if r["old"] != r["new"]]
    assert {r["new"] for r in moved} == {16} and 0.8 < len(moved) / (20000 / 17) < 1.2


def test_weight_change_stays_in_its_subtree(spark):
    nodes = tree(16)
    name, weight, racks = nodes[0]
    rack, rack_weight, shards = racks[1]
    heavier = [(name, weight, [racks[0], (rack, rack_weight, [(shards[0][0], 3.0, shards[0][2]), *shards[1:]])]), nodes[1]]
    placed = descend(descend(spark.range(5000), F.col("id"), nodes, "old"), F.col("id"), heavier, "new").collect()
    moved = [(r["old"], r["new"]) for r in placed if r["old"] != r["new"]]
    assert moved and all(old in (5, 6, 7) and new == 4 for old, new in moved)


def test_longer_trees_contain_shorter_ones():
    assert tree(17)[:2] == tree(16) and tree(3) == grown([], 3)
    assert all(grown(tree(n)) == tree(n + 1) for n in range(1, 40) if n != 15)


def test_one_more_shard_is_the_tree_of_the_next_count(spark):
    df = samples.documents(spark, [(k, f"text {k}") for k in range(2000)])
    for n in (16, 19, 20):
        promised, placed = ({r["doc_id"]: r[c] for r in assign_shards(df, m).collect()} for m, c in ((n, "grown_shard"), (n + 1, "shard")))
        assert promised == placed


def test_gapless_with_ties_and_few_blocks(spark):
    df = spark.createDataFrame([(g, k % 5) for g in (1, 2, None) for k in range(40)], "g int, k int")
    got = gapless(df, "g", ["k"], [], "n", blocks=3).collect()
    for g in (1, 2, None):
        assert sorted(r["n"] for r in got if r["g"] == g) == list(range(40))
