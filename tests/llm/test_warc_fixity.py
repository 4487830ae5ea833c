import hashlib

from pyspark.sql import functions as F
from quirelake.llm.warc_fixity import audit, records, tree


def pages(spark, n=60):
    rows = [(k * 37, f"http://h/{k}", "<p>" + "x" * (k * 53 % 700)) for k in range(n)]
    return spark.createDataFrame([*((*r, 1) for r in rows), (None, "u", "p", 1), (None, None, None, 1)], "page_id long, url string, html string, archive int")


def differences(left, right):
    ours, theirs = ({(r["archive"], r["offset"]): (r["length"], r["sha256"]) for r in side.collect()} for side in (left, right))
    return sorted((*k, "missing" if k not in theirs else "extra" if k not in ours else "changed") for k in ours.keys() | theirs.keys() if ours.get(k) != theirs.get(k))


def test_index(spark):
    index = [r for r in records(pages(spark)).collect() if r["record_id"] is not None]
    by = {}
    for r in sorted(index, key=lambda r: r["record_id"]):
        assert r["offset"] == by.get(r["archive"], 0) and r["archive"] == r["record_id"] // 1000
        by[r["archive"]] = r["offset"] + r["length"]
    one = next(r for r in index if r["record_id"] == 37)
    body = b"<p>" + b"x" * 53
    whole = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:37>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: http://h/1\r\nContent-Type: text/html\r\nContent-Length: 56\r\n\r\n" + body + b"\r\n\r\n"
    assert one["sha256"] == hashlib.sha256(whole).hexdigest() and one["length"] == len(whole)
    assert records(pages(spark)).count() == 62


def test_locates_every_difference(spark):
    left = records(pages(spark))
    right = left.where("record_id IS NULL OR record_id % 11 <> 3").withColumn("sha256", F.when(F.col("record_id") % 7 == 2, F.lit("bad")).otherwise(F.col("sha256")))
    extra = spark.createDataFrame([(99, 0, 5, 1, "new"), (0, 1, 5, 2, "new")], right.schema)
    right = right.unionByName(extra)
    for range_bytes, fan_out, levels in ((256, 2, 3), (1 << 16, 16, 2), (1, 3, 0)):
        got = [(r["archive"], r["offset"], r["state"]) for r in audit(left, right, range_bytes, fan_out, levels).collect()]
        assert sorted(got) == differences(left, right) and got


def test_equal_empty_and_repeated(spark):
    left = records(pages(spark))
    assert audit(left, left.unionByName(left)).count() == 0
    none = left.limit(0)
    assert audit(none, none).count() == 0
    assert audit(left, none).count() == left.distinct().count()


def test_roots_and_leaves_chain(spark):
    index = records(pages(spark))
    levels = tree(index, 512, 4, 2)
    assert [r["node"] for r in levels[-1].select("node").distinct().collect()] == [0]
    assert levels[-1].count() == index.select("archive").distinct().count()


def test_moved_records_are_intact(spark):
    """A lost record and a longer one shift all that stands behind them in a real replica."""
    left = pages(spark).where("page_id IS NOT NULL")
    right = left.where("page_id <> 37").withColumn("html", F.when(F.col("page_id") == 370, F.concat("html", F.lit("longer"))).otherwise(F.col("html")))
    for range_bytes, fan_out, levels in ((256, 2, 3), (1 << 16, 16, 2)):
        got = audit(records(left), records(right), range_bytes, fan_out, levels).collect()
        assert sorted((r["record_id"], r["state"]) for r in got) == [(37, "missing"), (370, "changed")]
