"""Fixity audit of web archives: Merkle trees over records and ordered offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.session import settle

#: Page ids that share an archive file.
ARCHIVE_IDS = 1000
#: Bytes of an archive under one leaf, and children under one node.
RANGE_BYTES = 1 << 16
FAN_OUT = 16
#: Levels between the leaves and an archive's root; the root takes whatever is left.
LEVELS = 2
#: Archive files for pages without an id.
NO_ID_ARCHIVES = 4096


def record_bytes(record_id: Column, url: Column, payload: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """A resource record as it stands in the file; a null payload has no bytes."""
    body = F.coalesce(payload, F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``archive, offset, length, record_id, sha256``: the index of the archives of ``pages``.

    Ids of one thousand share a file, in order. Pages without an id are spread over
    files of negative number by a hash of their url. Contents are hashed before
    anything is shuffled.
    """
    key, whole = F.col(id_col), record_bytes(F.col(id_col), F.col(url_col), F.col(html_col))
    apart = -1 - F.pmod(F.xxhash64(F.col(url_col), F.col(html_col)), F.lit(NO_ID_ARCHIVES))
    hashed = pages.select(
        F.coalesce(F.floor(key / ARCHIVE_IDS), apart).cast("long").alias("archive"), key.alias("record_id"),
        F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("sha256"),
    )
    before = Window.partitionBy("archive").orderBy("record_id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select("archive", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "record_id", "sha256")


def _digest(order: Column, value: Column) -> Column:
    """Hash of the children in order; a node has as many as its range or fan-out admits."""
    held = F.array_sort(F.collect_list(F.struct(order.alias("at"), value.alias("hash"))))
    return F.sha2(F.array_join(F.transform(held, lambda c: F.concat_ws(":", c["at"], c["hash"])), ","), 256)


def tree(index: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT, levels: int = LEVELS) -> list[DataFrame]:
    """``archive, node, hash`` per level: leaves, ``levels`` levels above, the root.

    A leaf covers the records that start in one range of offsets. A record that is
    lost or grown moves those behind it, so it changes the later ranges of its archive.
    """
    entry = F.concat_ws(":", "length", "sha256")
    leaf = index.groupBy("archive", F.floor(F.col("offset") / range_bytes).alias("node")).agg(_digest(F.col("offset"), entry).alias("hash"))
    out = [leaf]
    for level in range(levels + 1):
        node = F.floor(F.col("node") / fan_out) if level < levels else F.lit(0).cast("long")
        out.append(out[-1].groupBy("archive", node.alias("parent")).agg(_digest(F.col("node"), F.col("hash")).alias("hash")).withColumnRenamed("parent", "node"))
    return out


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """Records in which two replicas differ: ``archive, offset, length, record_id, state, sha256, replica_sha256``.

    Both sides are indexes as of :func:`records`. Roots are compared first; below a
    root, node or range only those under a mismatch are looked at, down to the
    records. There records are aligned by content first, wherever they stand, so that
    moved ones are intact, and what is left by id, or place if it has none. ``offset``
    is the left one where there is one. ``state`` is ``changed``, ``missing`` (from the right) or ``extra``. Records
    repeated at one place count once. Equal replicas, empty ones among them, give no
    rows; an archive that one side lacks is listed whole.
    """
    left, right = settle(left.distinct(), "fixity-left"), settle(right.distinct(), "fixity-right")
    ours, theirs = (tree(side, range_bytes, fan_out, levels) for side in (left, right))
    bad: DataFrame | None = None
    for level in range(levels + 1, -1, -1):
        mine, other = (t[level].withColumnRenamed("hash", name) for t, name in ((ours, "mine"), (theirs, "other")))
        if bad is not None:
            parent = (F.floor(F.col("node") / fan_out) if level < levels else F.lit(0).cast("long")).alias("parent")
            above = bad.select("archive", F.col("node").alias("parent"))
            mine, other = (t.select("*", parent).join(above, ["archive", "parent"], "left_semi").drop("parent") for t in (mine, other))
        differ = ~F.col("mine").eqNullSafe(F.col("other"))
        bad = settle(mine.join(other, ["archive", "node"], "full").where(differ).select("archive", "node"), f"fixity-{level}")
        if bad.isEmpty():
            break
    placed = [side.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, ["archive", "node"], "left_semi").drop("node") for side in (left, right)]

    def aligned(sides: list[DataFrame], *by: Column) -> DataFrame:
        """Both sides met by ``by``, repeats in the order of their offsets."""
        turn = F.row_number().over(Window.partitionBy("archive", *by).orderBy("offset", "sha256", "length"))
        mine, other = (
            side.select("archive", F.struct(*by, turn).alias("as"), *[F.col(c).alias(f"{name}_{c}") for c in ("offset", "length", "record_id", "sha256")])
            for side, name in zip(sides, ("mine", "other"))
        )
        return mine.withColumnRenamed("archive", "_archive").join(other, (F.col("_archive") == F.col("archive")) & mine["as"].eqNullSafe(other["as"]), "full").select(
            F.coalesce("_archive", "archive").alias("archive"), *[c for c in (*mine.columns, *other.columns) if c not in ("archive", "as")])

    moved = settle(aligned(placed, F.col("record_id"), F.col("length"), F.col("sha256")).where("mine_sha256 IS NULL OR other_sha256 IS NULL"), "fixity-apart")
    rest = [
        moved.where(f"{name}_sha256 IS NOT NULL").select("archive", *[F.col(f"{name}_{c}").alias(c) for c in ("offset", "length", "record_id", "sha256")])
        for name in ("mine", "other")
    ]
    met = aligned(rest, F.coalesce(F.concat(F.lit("="), F.col("record_id").cast("string")), F.concat(F.lit("@"), F.col("offset").cast("string"))))
    state = F.when(F.col("other_sha256").isNull(), "missing").when(F.col("mine_sha256").isNull(), "extra").otherwise("changed")
    return met.select(
        "archive", *[F.coalesce(f"mine_{c}", f"other_{c}").alias(c) for c in ("offset", "length", "record_id")],
        state.alias("state"), F.col("mine_sha256").alias("sha256"), F.col("other_sha256").alias("replica_sha256"))
