"""Registered queries running the stream jobs over the tables as streams.

Each reads its table as a file stream, processes what is available into a new
folder of the shared work space, and returns the written result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.plans.corpus_queries import LIVE_MARKS, edit_log
from quirelake.plans.inputs import table, with_inputs
from quirelake.plans.registry import query
from quirelake.session import work_folder
from quirelake.streaming import jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
PAGES = "page_id bigint, url string, html string"


def table_glob(folder: str, name: str) -> str:
    """A pattern matching only the table, be it one file or a folder of files;
    a file stream takes a single file only by pattern."""
    return f"{folder}/{name}.parque[t]"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.read_stream(spark, table_glob(folder, "events"), EVENTS).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


_BURSTS = """
    SELECT *, SUM(fresh) OVER (PARTITION BY grp ORDER BY ts) AS burst
    FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY grp ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh
          FROM (SELECT *, {key} AS grp FROM clicks))"""


@query("R2_debounce_queries", with_inputs("clicks") + f"""
    SELECT grp AS user_id, epoch_us(MIN(ts)) AS start, max_by(event_type || k, ts) AS query, COUNT(*) AS typed
    FROM ({_BURSTS.format(key='user_id')}) GROUP BY grp, burst""")
def _(spark, folder):
    typed = event_stream(spark, folder).select(
        "user_id", F.concat("event_type", F.col("k").cast("string")).alias("query"), "ts"
    )
    done = jobs.run_available(typed, jobs.debounce_queries("10 minutes"), work_folder(spark, "debounce"))
    return done.select("user_id", F.unix_micros("start").alias("start"), "query", "typed")


@query("R3_debounce_changes", with_inputs("clicks") + f"""
    SELECT 'doc_' || grp AS path, epoch_us(MIN(ts)) AS start, epoch_us(MAX(ts)) AS last_change, COUNT(*) AS notices
    FROM ({_BURSTS.format(key='k')}) GROUP BY grp, burst""")
def _(spark, folder):
    changes = event_stream(spark, folder).select(F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("path"), "ts")
    done = jobs.run_available(changes, jobs.debounce_changes("10 minutes"), work_folder(spark, "changes"))
    return done.select(
        "path", F.unix_micros("start").alias("start"), F.unix_micros("last_change").alias("last_change"), "notices"
    )


@query("R4_throttle_snapshots", with_inputs("clicks") + """
    SELECT user_id, epoch_us(slot) AS start, max_by(k, ts) AS state
    FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS slot FROM clicks)
    GROUP BY user_id, slot""")
def _(spark, folder):
    states = event_stream(spark, folder).select("user_id", F.col("k").alias("state"), "ts")
    done = jobs.run_available(states, jobs.throttle_snapshots("6 hours"), work_folder(spark, "throttle"))
    return done.select("user_id", F.unix_micros("start").alias("start"), "state")


@query("R5_dedupe_requests", with_inputs("clicks") + """
    SELECT user_id AS doc_id, CAST(k % 8 AS INTEGER) AS page, epoch_us(MIN(ts)) AS first_asked FROM clicks GROUP BY 1, 2""")
def _(spark, folder):
    requests = event_stream(spark, folder).select(F.col("user_id").alias("doc_id"), (F.col("k") % 8).alias("page"), "ts")
    done = jobs.run_available(requests, jobs.dedupe_requests(), work_folder(spark, "dedupe"))
    return done.select("doc_id", "page", F.unix_micros("ts").alias("first_asked"))


@query("R6_drop_stale_replies", with_inputs("clicks") + """
    SELECT r.user_id, r.k AS query_id, r.event_id AS result, epoch_us(q.ts) AS asked_at
    FROM clicks q JOIN clicks r ON q.user_id = r.user_id AND q.k = r.k AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 20 DAY
    WHERE q.event_type = 'click' AND r.event_type = 'view'""")
def _(spark, folder):
    events = event_stream(spark, folder).withColumnRenamed("k", "query_id")
    asked = jobs.run_available(
        events.filter("event_type = 'click'").select("user_id", "query_id", "ts"), jobs.as_they_are(), work_folder(spark, "asked"))
    told = jobs.run_available(
        events.filter("event_type = 'view'").select("user_id", "query_id", F.col("event_id").alias("result"), "ts"), jobs.as_they_are(), work_folder(spark, "told"))
    done = jobs.current_replies(asked, told, "20 days")
    return done.select("user_id", "query_id", "result", F.unix_micros("asked_at").alias("asked_at"))


@query("R6_reply_stream", with_inputs("clicks") + """
    SELECT r.user_id, r.k AS query_id, r.event_id AS result, epoch_us(q.ts) AS asked_at
    FROM clicks q JOIN clicks r ON q.user_id = r.user_id AND q.k = r.k AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 2 DAY
    WHERE q.event_type = 'error' AND r.event_type = 'purchase'""")
def _(spark, folder):
    """Replies of the running join, with those that late rows belong to."""
    events = event_stream(spark, folder).withColumnRenamed("k", "query_id")
    found = jobs.stream_replies(
        events.filter("event_type = 'error'").select("user_id", "query_id", "ts"),
        events.filter("event_type = 'purchase'").select("user_id", "query_id", F.col("event_id").alias("result"), "ts"),
        work_folder(spark, "replies"), within="2 days", late="1 day")
    return found.replies.unionByName(found.late_pairs).select("user_id", "query_id", "result", F.unix_micros("asked_at").alias("asked_at"))


@query("R8_latest_results", with_inputs("clicks") + """
    SELECT user_id AS doc_id, k AS page, max_by(event_type, ts) AS result FROM clicks GROUP BY 1, 2""")
def _(spark, folder):
    results = event_stream(spark, folder).select(
        F.col("user_id").alias("doc_id"), F.col("k").alias("page"), F.col("event_type").alias("result"), "ts"
    )
    return jobs.run_available(results, jobs.latest_results(), work_folder(spark, "results")).drop("ts")


@query("R9_layer_toggle_state", with_inputs("clicks") + """
    SELECT n_nationkey::BIGINT AS object_id, n_name AS name, max_by(event_type = 'view', ts) AS visible
    FROM clicks JOIN nation ON k % 40 = n_nationkey GROUP BY 1, 2""")
def _(spark, folder):
    toggles = event_stream(spark, folder).select(
        F.lit(0).alias("doc_id"), (F.col("k") % 40).cast("bigint").alias("object_id"), (F.col("event_type") == "view").alias("visible"), "ts"
    )
    layers = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("object_id"), F.col("n_name").alias("name"))
    state = jobs.run_available(toggles, jobs.layer_toggles(), work_folder(spark, "layers"))
    return state.join(layers, "object_id").select("object_id", "name", "visible")


@query("R1_edit_log_state", LIVE_MARKS)
def _(spark, folder):
    log = edit_log(event_stream(spark, folder))
    return jobs.run_available(log, jobs.edit_state(), work_folder(spark, "edits")).drop("action")


@query("R7_upsert_recents", with_inputs("clicks") + """
    SELECT user_id, path, epoch_us(last) AS last_opened
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, path) AS place
          FROM (SELECT user_id, 'doc_' || k AS path, MAX(ts) AS last FROM clicks GROUP BY 1, 2)) WHERE place <= 20""")
def _(spark, folder):
    opens = event_stream(spark, folder).select("user_id", F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("path"), "ts")
    kept = jobs.run_available(opens, jobs.upsert_recents(), work_folder(spark, "recents"))
    return kept.select("user_id", "path", F.unix_micros("ts").alias("last_opened"))


def _paragraphs(content: bytes):
    """Extractor: one page per paragraph end."""
    yield from enumerate(content.decode("utf-8").split("</p>"))


@query("R10_reload_on_change", """
    SELECT path, CAST(i - 1 AS INTEGER) AS page, text
    FROM (SELECT url AS path, unnest(parts) AS text, generate_subscripts(parts, 1) AS i
          FROM (SELECT url, string_split(max_by(html, page_id), '</p>') AS parts FROM pages GROUP BY url))""")
def _(spark, folder):
    changes = jobs.read_stream(spark, table_glob(folder, "pages"), PAGES).select(
        F.col("url").alias("path"), F.col("html").cast("binary").alias("content"), F.timestamp_seconds("page_id").alias("ts")
    )
    return jobs.run_available(changes, jobs.reload_on_change(_paragraphs), work_folder(spark, "reload")).select("path", "page", "text")
