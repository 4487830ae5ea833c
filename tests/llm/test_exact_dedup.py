import hashlib

import samples
from quirelake.llm.exact_dedup import drop_copies, exact_groups, merge_runs, digests


def brute(rows, keep):
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for key, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        out.append((key, best, len(groups[text or ""]), key == best, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows_both_ways(spark):
    for keep in ("largest", "smallest"):
        got = exact_groups(samples.documents(spark, samples.odd_rows()), keep).collect()
        assert sorted(map(tuple, got), key=repr) == brute(samples.odd_rows(), keep)


def test_any_fan_in_and_many_runs(spark):
    rows = [(i, f"text {i % 37}") for i in range(500)]
    df = samples.documents(spark, rows).repartition(23)
    for fan_in in (2, 3, 16):
        found = {r["digest"]: (r["keep_id"], r["group_size"]) for r in merge_runs(digests(df), "smallest", fan_in, leaves=23).collect()}
        assert sorted(found.values()) == sorted((k, sum(1 for i in range(500) if i % 37 == k)) for k in range(37))


def test_every_round_exchanges_sorts_and_merges(spark):
    rows = [(i, f"text {i % 37}") for i in range(100)]
    merged = merge_runs(digests(samples.documents(spark, rows)), "smallest", 3, leaves=20)
    merged.collect()
    plan = merged._sc._jvm.PythonSQLUtils.explainString(merged._jdf.queryExecution(), "simple")
    plan = plan.split("== Initial Plan ==")[0]
    rounds = 3  # 20 runs, 7, 3, 1
    assert plan.count("Window [lag(") == plan.count("Exchange hashpartitioning(run#") == rounds
    assert sum("Sort [run#" in line and "digest#" in line for line in plan.splitlines()) == rounds


def test_one_text_holds_a_third(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_groups(samples.documents(spark, rows), "largest").where("group_size > 1").collect()
    assert len(got) == 1000 and {r["keep_id"] for r in got} == {2997} and {r["group_size"] for r in got} == {1000}


def test_drop_copies_keeps_columns_and_one_row(spark):
    df = samples.documents(spark, samples.odd_rows())
    left = drop_copies(df, "largest")
    assert left.columns == df.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in samples.odd_rows()})


def test_empty(spark):
    df = samples.documents(spark, [])
    assert exact_groups(df).count() == 0 and drop_copies(df).count() == 0
