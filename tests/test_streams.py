"""Stream jobs over several batches, compared with the batch operators."""

import hashlib
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirelake.streaming import jobs


def feed(spark, tmp_path, batches, schema):
    """Write each batch as a file and read them back one file per trigger."""
    source = str(tmp_path / "source")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    return jobs.read_stream(spark, source, schema, files_per_trigger=1)


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)


DATA_JOBS = {
    "queries": (jobs.debounce_queries("10 minutes"), lambda e: e.select("user_id", F.concat("event_type", "k").alias("query"), "ts")),
    "changes": (jobs.debounce_changes("10 minutes"), lambda e: e.select(F.col("k").alias("path"), "ts")),
    "throttle": (jobs.throttle_snapshots("6 hours"), lambda e: e.select("user_id", F.col("k").alias("state"), "ts")),
    "requests": (jobs.dedupe_requests(), lambda e: e.select(F.col("user_id").alias("doc_id"), (F.col("k").cast("int") % 8).alias("page"), "ts")),
    "results": (jobs.latest_results(), lambda e: e.select(F.col("user_id").alias("doc_id"), F.col("k").alias("page"), F.col("event_type").alias("result"), "ts")),
    "recents": (jobs.upsert_recents(), lambda e: e.select("user_id", F.col("k").alias("path"), "ts")),
    "edits": (jobs.edit_state(), lambda e: e.select(F.col("user_id").alias("doc_id"), F.col("k").alias("ann_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "delete").otherwise("add").alias("action"))),
}
EVENTS = "event_id bigint, user_id bigint, event_type string, k string, ts timestamp"


@pytest.fixture(scope="module")
def cuts(spark, data, tmp_path_factory):
    """The events table as 1, 4 and 40 files of rows in no order."""
    events = spark.read.parquet(f"{data}/events.parquet").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("ts").cast("timestamp").alias("ts")
    )
    out = {}
    for n in (1, 4, 40):
        out[n] = str(tmp_path_factory.mktemp(f"cut{n}"))
        events.repartition(n, F.xxhash64("event_id")).write.mode("overwrite").parquet(out[n])
    return out


@pytest.mark.parametrize("n", [1, 4, 40])
@pytest.mark.parametrize("name", sorted(DATA_JOBS))
def test_any_cut_equals_the_whole_table(spark, cuts, tmp_path, name, n):
    job, shape = DATA_JOBS[name]
    stream = shape(jobs.read_stream(spark, cuts[n], EVENTS, files_per_trigger=max(1, n // 8)))
    done = jobs.run_available(stream, job, str(tmp_path / "store"))
    want = job.merge(job.part(shape(spark.read.parquet(cuts[1]))))
    assert rows(done, *want.columns) == rows(want)


def test_bursts_equal_a_plain_loop(spark, tmp_path):
    draw = random.Random(5)
    times = [(u, round(draw.random() * 300, 1)) for u in (1, 2) for _ in range(200)]
    typed = [(u, f"q{t}", at(t)) for u, t in times]
    draw.shuffle(typed)
    stream = feed(spark, tmp_path, [typed[k::7] for k in range(7)], "user_id bigint, query string, ts timestamp")
    done = jobs.run_available(stream, jobs.debounce_queries("1 second"), str(tmp_path / "sink"))
    want = []
    for user in (1, 2):
        burst = []
        for t in sorted(t for u, t in times if u == user) + [1e9]:
            if burst and t - burst[-1] > 1.0 + 1e-9:
                want.append((user, f"q{burst[-1]}", len(burst)))
                burst = []
            burst.append(t)
    assert rows(done, "user_id", "query", "typed") == sorted(want, key=repr)


def test_parts_of_a_job_condense(spark, tmp_path):
    opens = [(u, f"f{i % 41}", at(i)) for i in range(120) for u in (1, 2)]
    schema = "user_id bigint, path string, ts timestamp"
    job = jobs.upsert_recents()
    stream = feed(spark, tmp_path, [opens[:100], opens[100:130], opens[130:]], schema)
    done = rows(jobs.run_available(stream, job, str(tmp_path / "store")))
    parts = job.part(spark.createDataFrame([], schema)).schema
    jobs.compact(spark, job, str(tmp_path / "store"), parts, str(tmp_path / "small"))
    assert rows(job.merge(spark.read.parquet(str(tmp_path / "small" / "parts" / "batch-0")))) == done and len(done) == 40


def test_changed_documents_are_read_again(spark, tmp_path):
    schema = "path string, content binary, ts timestamp"
    first = [("a", bytearray(b"1|2|3"), at(0)), ("b", bytearray(b"x"), at(0)), ("c", bytearray(b"gone"), at(0))]
    second = [("a", bytearray(b"old"), at(1)), ("a", bytearray(b"new"), at(2)), ("c", bytearray(b""), at(2))]
    for k, batches in enumerate(([first, second], [second, first], [first + second])):
        stream = feed(spark, tmp_path / str(k), batches, schema)
        job = jobs.reload_on_change(lambda c: enumerate(c.decode().split("|") if c else []))
        done = jobs.run_available(stream, job, str(tmp_path / str(k) / "store"))
        assert rows(done, "path", "page", "text") == [("a", 0, "new"), ("b", 0, "x")]


@pytest.mark.parametrize("n", [1, 4, 40])
def test_repeated_and_tied_changes_give_each_page_once(spark, tmp_path, n):
    """The same row in many files, and contents of equal time, however the rows are cut."""
    draw = random.Random(3)
    rows_ = [(f"p{k % 9}", bytearray(f"{k % 4}|x|{k % 4}".encode()), at(k % 3)) for k in range(60)] * 3 + [("empty", bytearray(b""), at(0)), (None, bytearray(b"a"), at(0)), ("none", None, at(0))]
    draw.shuffle(rows_)
    job = jobs.reload_on_change(lambda c: enumerate(c.decode().split("|") if c else []))
    stream = feed(spark, tmp_path, [rows_[k::n] for k in range(n)], "path string, content binary, ts timestamp")
    done = jobs.run_available(stream, job, str(tmp_path / "store"))
    last = {}
    for path, content, ts in rows_:
        mark = hashlib.sha256(content).hexdigest() if content is not None else ""
        last[path] = max(last.get(path, (at(-1), "", b"")), (ts, mark, bytes(content or b"")))
    want = [(path, page, text) for path, (_, _, content) in last.items() for page, text in enumerate(content.decode().split("|") if content else [])]
    assert rows(done.where("error IS NULL"), "path", "page", "text") == sorted(want, key=repr)
    assert rows(done.where("error IS NOT NULL"), "path") == [("none",)]


def test_stale_replies_are_dropped(spark, tmp_path):
    asked = feed(spark, tmp_path / "q", [[(1, 8, at(5))], [(1, 7, at(0))]], "user_id bigint, query_id bigint, ts timestamp")
    told = feed(
        spark, tmp_path / "r", [[(1, 7, "in time", at(60)), (1, 8, "too late", at(4000))], [(1, 9, "unasked", at(9)), (2, 7, "other user", at(9)), (1, 8, "early", at(4))]],
        "user_id bigint, query_id bigint, result string, ts timestamp",
    )
    logs = [jobs.run_available(s, jobs.as_they_are(), str(tmp_path / n)) for s, n in ((asked, "a"), (told, "t"))]
    assert rows(jobs.current_replies(*logs), "result") == [("in time",)]


@pytest.mark.parametrize("n", [1, 4, 40])
def test_reply_stream_with_late_rows_is_the_batch_join(spark, tmp_path, n):
    draw = random.Random(8)
    asked = [(draw.randrange(5), draw.randrange(4), at(draw.random() * 40_000)) for _ in range(240)]
    told = [(draw.randrange(5), draw.randrange(4), f"r{k}", at(draw.random() * 40_000)) for k in range(240)] + [(None, 1, "none", at(5)), (1, None, "none", at(5)), (1, 1, "untimed", None)]
    schemas = "user_id bigint, query_id bigint, ts timestamp", "user_id bigint, query_id bigint, result string, ts timestamp"

    def cut(log):
        """Files by time, but each row may come up to a few files later."""
        log = sorted(log, key=lambda r: (r[-1] or at(0)).timestamp() / 40_000 * n + draw.random() * n / 12 if r[-1] else 0)
        return [log[len(log) * k // n : len(log) * (k + 1) // n] for k in range(n)]

    logs = []
    for name, log, schema in (("q", asked, schemas[0]), ("r", told, schemas[1])):
        feed(spark, tmp_path / name, cut(log), schema)
        logs.append(jobs.read_stream(spark, str(tmp_path / name / "source"), schema, files_per_trigger=max(1, n // 8)))
    found = jobs.stream_replies(*logs, str(tmp_path / "store"), within="20 minutes", late="20 minutes", files_per_trigger=max(1, n // 8))
    want = jobs.current_replies(spark.createDataFrame(asked, schemas[0]), spark.createDataFrame(told, schemas[1]), "20 minutes").select(*found.replies.columns)
    assert rows(found.replies.unionByName(found.late_pairs)) == rows(want) and rows(want)
    late = found.late_queries.count() + found.late_replies.count()
    assert (late == 0) == (n == 1)
    if n == 40:  # the state is that of a stretch of time, not of the logs
        assert max(found.state_rows) < 0.5 * (len(asked) + len(told)) and found.replies.count() > found.late_pairs.count() > 0


def test_an_empty_stream_gives_an_empty_result(spark, tmp_path):
    stream = feed(spark, tmp_path, [[]], "user_id bigint, path string, ts timestamp")
    assert jobs.run_available(stream, jobs.upsert_recents(), str(tmp_path / "store")).count() == 0
