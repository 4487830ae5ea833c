"""Lines that repeat across documents, dropped from all documents but the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.names import fresh

#: Code points a line's key must have to be looked for.
LEAST_CHARS = 10
#: Documents that make a key a repeated one.
LEAST_DOCS = 2

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _marks(value: Column) -> tuple[Column, Column]:
    """128 bits of hash: the second has a seed of its own."""
    return F.xxhash64(value), F.xxhash64(F.lit("line"), value)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dropped_lines(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``id, t1, t2, dropped``: places of the lines that go, per text of ``rows (id, text)``.

    Lines are exploded, stripped, folded and hashed; only hashes are shuffled. A hash
    collapses to its smallest id and number of documents in each task before it is
    exchanged, so a line that all documents hold is one row a task; its single places
    meet that row in a join, whose skew can be split.
    """
    # Hashed before lines are exploded, or every line would have its whole text hashed.
    whole = rows.select("id", *(m.alias(n) for m, n in zip(_marks(F.col("text")), ("t1", "t2"))), F.translate("text", _UPPER, _LOWER).alias("text"))
    exploded = whole.select("id", "t1", "t2", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    keyed = exploded.withColumn("line", F.btrim("line", F.lit(_SPACE))).where(F.char_length("line") >= least_chars)
    marked = keyed.select("id", "t1", "t2", "place", *(m.alias(n) for m, n in zip(_marks(F.col("line")), ("h1", "h2"))))
    # Null ids are one document, the last of all.
    if least_docs == 2:
        found = marked.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("odd"))
        shared = found.where("first <> last OR (first IS NOT NULL AND odd)")
    else:
        # One row per line and document is enough to count documents.
        found = marked.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("docs"))
        shared = found.where(F.col("docs") >= least_docs)
    shared = shared.select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "first")
    later = marked.join(shared, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))).where(~F.col("id").eqNullSafe(F.col("first")))
    return later.groupBy("id", "t1", "t2").agg(F.collect_set("place").alias("dropped"))


def without_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text",
                    n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """All rows of ``docs``, repeated lines gone from the text, with ``n_lines`` (before) and ``n_dropped``.

    Text splits at line feeds; a null or empty one is one empty line. A line's key is
    the line without white space (space, tab to carriage return) at both ends and with
    A-Z in lower case. Keys of at least ``least_chars`` code points that at least
    ``least_docs`` documents hold stay in the document of smallest id alone, with all their lines there;
    other lines stay as they are, joined by a line feed. A text that loses all its lines is empty.

    Rows of equal id are one document: a line they share does not count as repeated
    for that, and is dropped from all or none of them. Null ids are one document too,
    after all others. Keys are held equal when 128 bits of hash are. An
    empty table gives no rows; columns of ``docs`` keep their names and values, and
    ``n_lines`` and ``n_dropped`` get underscores where ``docs`` has such columns.
    """
    n_lines, n_dropped, key, one, two, gone, lines = fresh(docs, n_lines, n_dropped, "_of", "_t1", "_t2", "_gone", "_lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    cuts = dropped_lines(picked, least_chars, least_docs).withColumnsRenamed({"id": key, "t1": one, "t2": two, "dropped": gone})
    marks = _marks(text)
    joined = docs.join(cuts, F.col(id_col).eqNullSafe(F.col(key)) & (marks[0] == F.col(one)) & (marks[1] == F.col(two)), "left")
    # A column of its own: the text is split once, not at every place looked up.
    joined = joined.withColumn(lines, _lines(text))
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(F.transform(F.array_except(places, F.col(gone)), lambda i: F.get(F.col(lines), i)), "\n")
    return joined.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias(n_dropped),
    )
