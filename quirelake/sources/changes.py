"""What changed in a folder since it was last read, and only that read again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.session import settle
from quirelake.sources.corpus import PAGE_FIELDS, Extractor, extract
from quirelake.sources.snapshot import read_snapshot, write_snapshot

MANIFEST = "path string, length long, modified timestamp, digest string"


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """``path, length, modified`` of all files: from the listing, no file is opened."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.col("modificationTime").alias("modified"))


def differences(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, state, length, modified``: files ``added``, ``changed`` or ``gone`` since the manifest.

    A file counts as changed if its length or time differs. Those as they were are left out.
    """
    known = manifest.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    met = files.join(known, F.col("path") == F.col("_path"), "full_outer")
    differs = ~F.col("length").eqNullSafe(F.col("_length")) | ~F.col("modified").eqNullSafe(F.col("_modified"))
    state = F.when(F.col("_path").isNull(), "added").when(F.col("path").isNull(), "gone").when(differs, "changed")
    return met.select(F.coalesce("path", "_path").alias("path"), state.alias("state"), "length", "modified").where("state IS NOT NULL")


class Refresh(NamedTuple):
    """``changes``: path and state; ``pages``: what the files that are new or have new content hold."""

    changes: DataFrame
    pages: DataFrame


def refresh(spark: SparkSession, glob: str, store: str, extractor: Extractor, fields: str = PAGE_FIELDS) -> Refresh:
    """Extract the files of a folder that were added or changed since the last call.

    The manifest in ``store`` has length, time and digest of every file seen; it is replaced at the end,
    so a run that fails is repeated as a whole. Two listings are compared first. If nothing was added or
    changed, no file is opened. Otherwise the times and lengths of what was bound the scan, which
    skips files outside these bounds unopened, and only listed files are extracted. A file
    whose new digest is the old one was ``touched``: it is not extracted again.
    """
    try:
        manifest = read_snapshot(spark, store)
    except FileNotFoundError:
        manifest = spark.createDataFrame([], MANIFEST)
    found = settle(differences(list_files(spark, glob), manifest), "folder-changes")
    open_ = found.where("state <> 'gone'")
    bound = open_.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("length", "modified") for name, f in (("least", F.min), ("most", F.max))]).first()
    if bound["n"]:
        scan = spark.read.format("binaryFile").load(glob).where(
            F.col("length").between(bound["least_length"], bound["most_length"]) & F.col("modificationTime").between(F.lit(bound["least_modified"]), F.lit(bound["most_modified"])))
        read = scan.join(open_.select("path", "state"), "path")
        old = manifest.select("path", F.col("digest").alias("_old"))
        marked = read.select("path", F.sha2("content", 256).alias("digest"), "length", F.col("modificationTime").alias("modified"), "state")
        seen = settle(marked.join(old, "path", "left").withColumn("touched", F.col("digest").eqNullSafe(F.col("_old"))).drop("_old"), "folder-digests")
        fresh = scan.join(seen.where("NOT touched").select("path"), "path")
        pages = settle(extract(fresh, extractor, fields), "folder-pages")
    else:
        seen = spark.createDataFrame([], f"{MANIFEST}, state string, touched boolean")
        pages = spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), *T.StructType.fromDDL(fields).fields, T.StructField("error", T.StringType())]))
    changes = found.join(seen.select("path", "touched"), "path", "left").select("path", F.when(F.col("touched"), "touched").otherwise(F.col("state")).alias("state"))
    if not found.isEmpty():
        names = T.StructType.fromDDL(MANIFEST).names
        write_snapshot(manifest.join(found.select("path"), "path", "left_anti").select(*names).unionByName(seen.select(*names)), store)
    return Refresh(changes, pages)
