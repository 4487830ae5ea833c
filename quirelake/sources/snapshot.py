"""Tables that are replaced as a whole.

Each version is a folder written by Spark; a version counts once the list of
versions, a small append-only table, names it. A reader sees the old version until
then, and an interrupted write leaves only an unlisted folder behind. One writer
at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _current(spark: SparkSession, path: str) -> int | None:
    """The newest listed version; none where no list was ever written."""
    try:
        listed = spark.read.schema("version bigint").parquet(f"{path}/versions")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return listed.agg(F.max("version")).first()[0]


def write_snapshot(df: DataFrame, path: str) -> int:
    """Replace a stored table as a whole; returns the new version."""
    spark = df.sparkSession
    last = _current(spark, path)
    version = 0 if last is None else last + 1
    df.write.mode("overwrite").parquet(f"{path}/data/version={version}")
    spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by :func:`write_snapshot`."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/data/version={version}")
