"""All registered queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.text import WHITESPACE
from quirelake.operators.layout import span_offsets
from quirelake.operators.search import hit_to_span, search
from quirelake.plans import corpus_queries, page_queries, scalar_queries, stream_queries, structure_queries  # noqa: F401
from quirelake.plans.inputs import turn_words, turns
from quirelake.plans.registry import CHECKS, QUERIES
from quirelake.session import configure


def flagship(spark: SparkSession, folder: str, word: str = "en") -> DataFrame:
    """Hits of a word per document, with the pages they are on and the highest
    box: pages, words, offsets, search, interval join, aggregate."""
    configure(spark)
    joined = turns(spark, folder).withColumn("text", F.regexp_replace("text", f"{WHITESPACE}+", ""))
    located = hit_to_span(search(joined, word), span_offsets(turn_words(spark, folder)))
    return located.groupBy("doc_id").agg(
        F.count("*").alias("hits"), F.count_distinct("page").alias("pages"), F.min("y").alias("top")
    )


__all__ = ["CHECKS", "QUERIES", "flagship"]
