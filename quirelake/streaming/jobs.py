"""Stream jobs: bursts, throttling, de-duplication, late replies, newest rows.

A job is a pair of batch operators. ``part`` condenses one micro-batch; what it
returns is appended to the job's store under the batch's number, so a repeated
batch replaces itself. ``merge`` turns all parts into the result. Merging the parts
of any cut of the input gives the same result, so it does not matter how rows were
spread over files or in what order they arrived: there is no lateness cut, no row is
dropped and windows that are still open are in the result. Nothing is kept between
batches but the parts, and :func:`compact` condenses those.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.operators.documents import recent_files
from quirelake.sources.corpus import PAGE_FIELDS, Extractor, extract

QUERY_GAP = "300 milliseconds"
CHANGE_GAP = "1 second"
SNAPSHOT_WINDOW = "5 seconds"


class Job(NamedTuple):
    """``part`` takes a micro-batch, ``merge`` the parts of all batches."""

    part: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``; ties go by the other columns."""
    others = [c for c in rows.columns if c not in (*keys, *order)]
    last = F.max(F.struct(*order, *others)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col("_last")[c].alias(c) for c in (*order, *others)]).select(*rows.columns)


def newest_job(keys: Sequence[str], order: Sequence[str]) -> Job:
    """Newest row per key; condensing it twice changes nothing."""
    step = partial(newest, keys=keys, order=order)
    return Job(step, step)


def _bursts(parts: DataFrame, key: str, gap: str, *found) -> DataFrame:
    """Join bursts (key, first, last) that lie at most ``gap`` apart."""
    each = Window.partitionBy(key).orderBy("first", "last")
    reached = F.max("last").over(each.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reached.isNull() | (F.col("first") > reached + F.expr(f"INTERVAL {gap}"))).cast("int")
    numbered = parts.withColumn("_fresh", fresh).withColumn("_burst", F.sum("_fresh").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_burst").agg(F.min("first").alias("first"), F.max("last").alias("last"), *found).drop("_burst")


def debounce_queries(gap: str = QUERY_GAP) -> Job:
    """The last query of each burst of typing per user, from (user_id, query, ts).

    The result has user_id, start, end (``gap`` after the last key), query, typed. A
    part holds the bursts of its batch, which is what the merge has to look at.
    """

    def latest() -> Column:
        return F.max(F.struct("last", "query"))["query"].alias("query")

    def part(batch: DataFrame) -> DataFrame:
        asked = batch.select("user_id", F.col("ts").alias("last"), "query", F.col("ts").alias("ts"))
        return asked.groupBy("user_id", F.session_window("ts", gap).alias("burst")).agg(
            F.min("last").alias("first"), latest(), F.count("*").alias("typed"), F.max("last").alias("last")
        ).select("user_id", "first", "last", "query", "typed")

    def merge(parts: DataFrame) -> DataFrame:
        whole = _bursts(parts, "user_id", gap, latest(), F.sum("typed").alias("typed"))
        return whole.select("user_id", F.col("first").alias("start"), (F.col("last") + F.expr(f"INTERVAL {gap}")).alias("end"), "query", "typed")

    return Job(part, merge)


def debounce_changes(gap: str = CHANGE_GAP) -> Job:
    """One notice per burst of changes of a watched file, from (path, ts)."""

    def part(batch: DataFrame) -> DataFrame:
        return batch.groupBy("path", F.session_window("ts", gap).alias("burst")).agg(
            F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("notices")
        ).drop("burst")

    def merge(parts: DataFrame) -> DataFrame:
        whole = _bursts(parts, "path", gap, F.sum("notices").alias("notices"))
        return whole.select("path", F.col("first").alias("start"), F.col("last").alias("last_change"), "notices")

    return Job(part, merge)


def throttle_snapshots(every: str = SNAPSHOT_WINDOW) -> Job:
    """The latest state per user and window, from (user_id, state, ts)."""
    step = newest_job(["user_id", "start"], ["ts", "state"])

    def part(batch: DataFrame) -> DataFrame:
        return step.part(batch.select("user_id", F.window("ts", every)["start"].alias("start"), "state", "ts"))

    return Job(part, lambda parts: step.merge(parts).drop("ts"))


def dedupe_requests() -> Job:
    """Each page once that was asked for, from (doc_id, page, ts), with the first time."""

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id", "page").agg(F.min("ts").alias("ts"))

    return Job(first, first)


def as_they_are() -> Job:
    """Rows kept as they come."""
    return Job(lambda batch: batch, lambda parts: parts)


def current_replies(queries: DataFrame, replies: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Replies whose query is still current: at most ``within`` old.

    ``queries`` has user_id, query_id, ts; ``replies`` user_id, query_id, result, ts.
    """
    asked = queries.select("user_id", "query_id", F.col("ts").alias("asked_at"))
    told = replies.withColumnRenamed("ts", "replied_at")
    in_time = F.col("replied_at").between(F.col("asked_at"), F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    return told.join(asked, ["user_id", "query_id"]).where(in_time)


class LogParts(NamedTuple):
    """Folders of :func:`split_late`, with the schema of their rows."""

    on_time: str
    late: str
    schema: T.StructType

    def table(self, spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(folder)


def split_late(stream: DataFrame, store: str, late: str, ts: str = "ts") -> LogParts:
    """Part a log into rows on time and late ones, as tables in ``store``; everything available is processed.

    A row is late if it is more than ``late`` older than the newest row of an earlier
    batch. Each batch writes its rows and its newest time under its own number, so a
    repeated batch replaces itself. Late rows are kept, not dropped: count or replay them.
    """
    paths = LogParts(f"{store}/on-time", f"{store}/late", stream.schema)

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("batch long, newest timestamp").option("recursiveFileLookup", "true")
        past = marks.parquet(f"{store}/marks").where(F.col("batch") < batch_id).agg(F.max("newest").alias("t")) if batch_id else None
        limit = past.select((F.col("t") - F.expr(f"INTERVAL {late}")).alias("limit")) if past is not None else spark.range(1).select(F.lit(None).cast("timestamp").alias("limit"))
        # One row, by its aggregate.
        marked = batch.join(F.broadcast(limit)).withColumn("_late", F.coalesce(F.col(ts) < F.col("limit"), F.lit(False))).drop("limit")
        marked.where("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{paths.on_time}/batch-{batch_id}")
        marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{paths.late}/batch-{batch_id}")
        batch.agg(F.max(ts).alias("newest")).select(F.lit(batch_id).cast("long").alias("batch"), "newest").write.mode("overwrite").parquet(f"{store}/marks/batch-{batch_id}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return paths


class ReplyStream(NamedTuple):
    """What :func:`stream_replies` leaves: replies in time, late rows of both logs, and the pairs these would make."""

    replies: DataFrame
    late_queries: DataFrame
    late_replies: DataFrame
    late_pairs: DataFrame
    state_rows: list[int]


def stream_replies(queries: DataFrame, replies: DataFrame, store: str, within: str = "10 minutes", late: str = "1 hour", files_per_trigger: int = 1000) -> ReplyStream:
    """Replies whose query is still current, found while both logs run; see :func:`current_replies`.

    A stream-stream join on user and query, bounded in time on both sides: a query is
    held until no reply on time can still be ``within`` it, a reply until no query on time
    can still be before it, so the state does not grow with the logs. Rows too late for that
    are parted off before the join and returned; ``late_pairs`` are the replies they
    belong to. ``replies`` and ``late_pairs`` together are the batch join, whatever the
    cut of the logs. ``state_rows`` has the rows held after each batch.
    """
    spark = queries.sparkSession
    asked, told = split_late(queries, f"{store}/queries", late), split_late(replies, f"{store}/replies", late)

    def again(paths: LogParts) -> DataFrame:
        return spark.readStream.schema(paths.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(paths.on_time)

    one = again(asked).select(F.col("user_id").alias("_user"), F.col("query_id").alias("_query"), F.col("ts").alias("asked_at")).withWatermark("asked_at", late)
    two = again(told).withColumnRenamed("ts", "replied_at").withWatermark("replied_at", late)
    bound = F.expr(f"_user = user_id AND _query = query_id AND replied_at >= asked_at AND replied_at <= asked_at + INTERVAL {within}")
    joined = two.join(one, bound).drop("_user", "_query")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/found/batch-{batch_id}")

    run = joined.writeStream.foreachBatch(keep).option("checkpointLocation", f"{store}/join").trigger(availableNow=True).start()
    run.awaitTermination()
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in run.recentProgress]
    found = spark.read.schema(joined.schema).option("recursiveFileLookup", "true").parquet(f"{store}/found")
    late_asked, late_told = asked.table(spark, asked.late), told.table(spark, told.late)
    missed = current_replies(late_asked, told.table(spark, told.on_time).unionByName(late_told), within).unionByName(
        current_replies(asked.table(spark, asked.on_time), late_told, within))
    return ReplyStream(found, late_asked, late_told, missed.select(*found.columns), held)


def latest_results() -> Job:
    """The newest result per page, from (doc_id, page, result, ts)."""
    return newest_job(["doc_id", "page"], ["ts", "result"])


def layer_toggles() -> Job:
    """The newest visibility per layer, from (doc_id, object_id, visible, ts)."""
    return newest_job(["doc_id", "object_id"], ["ts", "visible"])


def edit_state() -> Job:
    """Marks that are live after all edits, from (doc_id, ann_id, seq, action).

    The last edit of a mark decides, the largest ``seq``; a mark whose last edit is
    ``delete`` is gone.
    """
    step = newest_job(["doc_id", "ann_id"], ["seq", "action"])
    return Job(step.part, lambda parts: step.merge(parts).where("action <> 'delete'"))


def upsert_recents() -> Job:
    """Each user's newest files, from (user_id, path, ts).

    A path among a user's newest is among the newest of the part that holds its last
    opening, so a part needs no more rows per user than the result.
    """

    def step(rows: DataFrame) -> DataFrame:
        return recent_files(rows).select("user_id", "path", F.col("last_opened").alias("ts"))

    return Job(step, step)


def reload_on_change(extractor: Extractor) -> Job:
    """Pages of changed documents, read again, from (path, content, ts).

    The content of greatest ``ts``, and of equal ``ts`` the one of greatest digest, is a
    document's last. A part holds the pages of the last content of each document in
    its batch, and one row with ``changed`` per document, also where no page is left.
    Parts that hold the same content give its pages once; rows of one content that are equal in
    all columns are one. Content that can't be read, a null one too, gives a row with its error.
    """

    def part(batch: DataFrame) -> DataFrame:
        marked = batch.select("path", "content", "ts", F.sha2("content", 256).alias("digest"))
        content = newest(marked, ["path"], ["ts", "digest"])
        found = extract(content, extractor, keep=["path", "ts", "digest"]).withColumn("changed", F.lit(False))
        empty = {f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(f"{PAGE_FIELDS}, error string").fields}
        return found.unionByName(content.select("path", "ts", "digest").withColumns({**empty, "changed": F.lit(True)}))

    def merge(parts: DataFrame) -> DataFrame:
        last = parts.where("changed").groupBy("path").agg(F.max(F.struct("ts", "digest")).alias("last")).select("path", "last.ts", "last.digest")
        # The same content in two parts has the same pages; null paths and digests are values too.
        keys = ["path", "ts", "digest"]
        named = last.withColumnsRenamed({k: f"_{k}" for k in keys})
        met = parts.where("NOT changed").join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
        return met.dropDuplicates().drop("ts", "digest", "changed")

    return Job(part, merge)


# Running jobs


def _parts(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{store}/parts")


def run_available(stream: DataFrame, job: Job, store: str) -> DataFrame:
    """Process everything available and return the job's result so far.

    A service starts the same stream with a trigger of its own and merges when
    somebody asks.
    """
    spark = stream.sparkSession
    schema = job.part(spark.createDataFrame([], stream.schema)).schema

    def keep(batch: DataFrame, batch_id: int) -> None:
        job.part(batch).write.mode("overwrite").parquet(f"{store}/parts/batch-{batch_id}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return job.merge(_parts(spark, store, schema))


def compact(spark: SparkSession, job: Job, store: str, schema: T.StructType, to: str) -> None:
    """Write the parts of a stopped stream as one, for jobs whose part is its own merge."""
    job.part(_parts(spark, store, schema)).write.parquet(f"{to}/parts/batch-0")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A parquet folder as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
