"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; what it returns is written as Parquet and read again as the next one's
``docs``. Null and empty texts pass through the stages as texts without words: they
score as such, are copies of each other, have no test windows, and one that stays is
packed as a lone end id. An empty table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm.decontaminate import drop_contaminated
from quirelake.llm.exact_dedup import drop_copies
from quirelake.llm.packing import pack
from quirelake.llm.quality import keep_good
from quirelake.llm.similar import drop_similar
from quirelake.session import configure, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that are not held out, does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word similarity of 0.8, found by SimHash and MinHash, the one with the smallest id."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in their sequences."""
    return pack(docs, with_ids=False)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("packing", packing)]

#: Scores and token ids are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
