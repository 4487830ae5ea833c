"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.names import fresh, id_key

#: Runs merged into one in each round.
FAN_IN = 8
#: Hexadecimal digits that name a stretch of the digests' range: 4,096 stretches.
STRETCHES = 3


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, n_bytes`` of every row; a null text counts as empty.

    Two texts are held equal when SHA-256 and length both agree.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("n_bytes"))


def merge_runs(rows: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN, leaves: int | None = None) -> DataFrame:
    """Merge the partitions' digest runs in rounds: ``digest, n_bytes, keep_id, group_size``.

    Each input partition collapses to a run of distinct digests, with the id that
    stays and the number of rows, before anything is shuffled. In every round
    ``fan_in`` neighbouring runs are exchanged and merged into one sorted run: an entry whose
    neighbour before it has the same digest and length is merged with it, and the id that stays and
    the number of rows of all of them are kept. A run lies in stretches of the digests'
    range, each merged by itself, so no task holds a whole run. A digest that a third of
    all rows share is one entry a run from the first round on.
    """
    best = F.min if keep == "smallest" else F.max
    leaves = leaves or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.pmod(F.spark_partition_id(), F.lit(leaves)).alias("run")
    runs = rows.groupBy(run, F.substring("digest", 1, STRETCHES).alias("stretch"), "digest", "n_bytes").agg(
        best("doc_id").alias("keep_id"), F.count("*").alias("copies"))
    place = ["run", "stretch", "digest", "n_bytes"]
    sorted_run = Window.partitionBy("run", "stretch").orderBy("digest", "n_bytes")
    same = Window.partitionBy(*place)
    for _ in range(max(1, math.ceil(round(math.log(leaves, fan_in), 9)))):
        met = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("run", "stretch").sortWithinPartitions(*place)
        merged = met.withColumns({
            "before": F.lag(F.struct("digest", "n_bytes")).over(sorted_run),
            "keep_id": best("keep_id").over(same), "copies": F.sum("copies").over(same),
        })
        runs = merged.where(~F.col("before").eqNullSafe(F.struct("digest", "n_bytes"))).drop("before")
    return runs.select("digest", "n_bytes", "keep_id", F.col("copies").alias("group_size"))


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null and empty texts are one group. A null id gives way to any other id and
    stays only where a group has no other. Repeated rows share id and text, hence
    also ``keep_id`` and ``kept``. An empty table gives no rows; other columns of
    ``docs`` are not read, whatever their names.
    """
    rows = digests(docs, id_col, text_col)
    merged = merge_runs(rows, keep, fan_in).where("group_size > 1").withColumnsRenamed({"digest": "_digest", "n_bytes": "_bytes"})
    return rows.join(merged, (F.col("digest") == F.col("_digest")) & (F.col("n_bytes") == F.col("_bytes")), "left").select(
        "doc_id",
        F.when(F.col("_digest").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_digest").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all their columns.

    Where repeated rows share the id that stays, one of them is kept.
    """
    key, sha = fresh(docs, "_key", "_sha")
    marks = exact_groups(docs, keep, id_col, text_col).where("kept")
    stay = marks.select(id_key(F.col("doc_id")).alias(key), F.col("text_sha256").alias(sha)).distinct()
    named = docs.withColumns({key: id_key(F.col(id_col)), sha: F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
    return named.join(stay, [key, sha]).dropDuplicates([key, sha]).drop(key, sha).select(docs.columns)
