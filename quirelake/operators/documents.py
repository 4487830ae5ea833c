"""Per-document tables: inventory, signatures, layers, attachments, outline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

OUTLINE_DEPTH = 100
RECENT_LIMIT = 20


def document_inventory(documents: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of each named table per document, zero where it has none.

    All tables are stacked as ``(doc_id, name)`` and counted in one aggregate,
    so there is one shuffle of partial counts however many tables there are.
    """
    marked = [documents.select("doc_id", F.lit("document").alias("_table"))]
    marked += [t.select("doc_id", F.lit(name).alias("_table")) for name, t in tables.items()]
    stacked = reduce(DataFrame.unionByName, marked)

    def tally(name: str) -> Column:
        return F.count(F.when(F.col("_table") == name, 1))

    return (
        stacked.groupBy("doc_id")
        .agg(tally("document").alias("_known"), *[tally(name).alias(name) for name in tables])
        .filter("_known > 0")
        .drop("_known")
    )


def signature_status(documents: DataFrame, signatures: DataFrame) -> DataFrame:
    """``Signed`` when every signature checks out, ``Warning`` when one does
    not, NULL without signatures."""
    checked = signatures.groupBy("doc_id").agg(
        F.bool_and(F.col("digest_verified") & F.col("crypto_valid")).alias("_good")
    )
    status = F.when(F.col("_good"), F.lit("Signed")).when(~F.col("_good"), F.lit("Warning"))
    return documents.select("doc_id").join(checked, "doc_id", "left").select("doc_id", status.alias("status"))


def drop_missing_layers(layers: DataFrame) -> DataFrame:
    return layers.filter(F.col("name").isNotNull())


def effective_layers(layers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Layers with the user's last toggle in force over the document's setting.

    ``overrides`` has doc_id, object_id, visible, ts.
    """
    keys = ["doc_id", "object_id"]
    last = overrides.groupBy(*keys).agg(F.max(F.struct("ts", "visible"))["visible"].alias("_override"))
    joined = layers.join(last, keys, "left")
    return joined.withColumn("visible", F.coalesce("_override", "visible")).drop("_override")


def find_attachment(requests: DataFrame, attachments: DataFrame) -> DataFrame:
    """Look attachments up by object id; ``error`` tells what is missing."""
    keys = ["doc_id", "object_id"]
    found = requests.join(attachments.withColumn("_there", F.lit(True)), keys, "left")
    error = F.when(F.col("_there").isNull(), F.lit("Attachment not found"))
    return found.withColumn("error", error).drop("_there")


def outline_targets(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Page of each outline entry; a missing destination goes to page 0.

    ``outline`` has doc_id and dest_page.
    """
    there = pages.select("doc_id", "page")
    joined = outline.join(there, (outline.doc_id == there.doc_id) & (outline.dest_page == there.page), "left")
    return joined.select(*[outline[c] for c in outline.columns], F.coalesce(there.page, F.lit(0)).alias("page"))


def outline_flatten(outline: DataFrame, max_depth: int = OUTLINE_DEPTH) -> DataFrame:
    """Outline entries with their preorder path and depth (top level 0).

    ``outline`` has doc_id, node_id, parent_id (NULL at the top), ordinal, title,
    page. Entries deeper than ``max_depth`` are dropped. Sorting by
    ``(doc_id, path)`` gives reading order; the level and row limits of recursive
    queries are set by ``session.configure``.
    """
    spark = outline.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE walk(doc_id, node_id, title, page, depth, path) AS (
          SELECT doc_id, node_id, title, page, 0, array(ordinal)
          FROM {outline} WHERE parent_id IS NULL
          UNION ALL
          SELECT c.doc_id, c.node_id, c.title, c.page, w.depth + 1, concat(w.path, array(c.ordinal))
          FROM walk w JOIN {outline} c ON c.doc_id = w.doc_id AND c.parent_id = w.node_id
          WHERE w.depth < {max_depth}
        )
        SELECT * FROM walk
        """,
        outline=outline,
        max_depth=max_depth,
    )


def set_meta(
    docs: DataFrame, updates: DataFrame, fields: tuple[str, ...] = ("title", "author", "subject", "keywords"), order: str | None = None
) -> DataFrame:
    """Overwrite metadata fields where an update gives a value.

    Of several updates of a document the last by ``order`` that gives a field counts for it;
    of equal ones, and without an order, the greatest value. Updates collapse to one row a document first.
    """

    def last(f: str) -> Column:
        return F.max(F.when(F.col(f).isNotNull(), F.struct(*([order] if order else []), F.col(f).alias("_f"))))["_f"].alias(f"_{f}")

    new = updates.groupBy("doc_id").agg(*[last(f) for f in fields])
    joined = docs.join(new, "doc_id", "left")
    return joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def recent_files(opens: DataFrame, n: int = RECENT_LIMIT) -> DataFrame:
    """The last ``n`` files each user opened, newest first, one row per path.

    The newest open per path is a partial aggregate, and the rank filter cuts
    each partition to ``n`` rows per user before the shuffle.
    """
    newest = opens.groupBy("user_id", "path").agg(F.max("ts").alias("last_opened"))
    order = Window.partitionBy("user_id").orderBy(F.col("last_opened").desc(), "path")
    return newest.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
