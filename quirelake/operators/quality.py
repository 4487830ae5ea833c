"""Rules, duplicates, comparison and manifests over document tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.operators.layout import PAGE, layout_lines, page_text


@dataclass(frozen=True)
class Rule:
    """A named check: ``broken`` is a Column that is true on a violation."""

    name: str
    broken: Column
    message: str


@dataclass
class RuleBook:
    """Validation profiles by name; the first one registered is the fallback."""

    profiles: dict[str, list[Rule]] = field(default_factory=dict)

    def register(self, profile: str, rules: Sequence[Rule]) -> None:
        self.profiles[profile.lower()] = list(rules)

    def resolve(self, profile: str) -> tuple[str, list[Rule]]:
        name = profile.lower()
        if name not in self.profiles:
            name = next(iter(self.profiles))
        return name, self.profiles[name]


def register_rules(rules: Sequence[Rule], profile: str = "default", book: RuleBook | None = None) -> RuleBook:
    """Add user rules as a profile; plain Columns, so no Python in the plan."""
    book = book or RuleBook()
    book.register(profile, rules)
    return book


def validate(docs: DataFrame, book: RuleBook, profile: str) -> DataFrame:
    """Add ``profile``, ``violations`` (rule, message) and ``conforms``.

    One pass over the documents checks every rule."""
    name, rules = book.resolve(profile)
    found = F.array(*[
        F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.message).alias("message")))
        for r in rules
    ])
    return docs.withColumns({
        "profile": F.lit(name),
        "violations": F.filter(found, lambda v: v.isNotNull()),
    }).withColumn("conforms", F.size("violations") == 0)


def violations(validated: DataFrame) -> DataFrame:
    return validated.select("doc_id", F.inline("violations"))


def violation_counts(validated: DataFrame) -> DataFrame:
    return violations(validated).groupBy("rule").agg(F.count("*").alias("documents"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """Groups of identical text: digest, kept (lowest) id, number of copies.

    Copies collapse before the shuffle: only digests and counts move."""
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )


def unreferenced(rows: DataFrame, *references: tuple[DataFrame, str], key: str = "doc_id") -> DataFrame:
    """Rows whose key no given (table, column) refers to.

    References are cut to distinct keys first: a key referred to by a third of a
    table would otherwise send all those rows to one task."""
    for table, column in references:
        rows = rows.join(table.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return rows


def read_page_results(pages: DataFrame) -> DataFrame:
    """Read every page into a result ``(doc_id, page, part, text)``; pages
    without text fail and are left out."""
    return page_text(layout_lines(pages.filter("text IS NOT NULL AND height > 0")))


def latest_results(results: DataFrame) -> DataFrame:
    """The newest result per page: later runs replace earlier ones, the greater result of one moment counts."""
    return results.groupBy(*PAGE).agg(F.max(F.struct("ts", "result"))["result"].alias("result"))


def tag_untagged(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """One ``Part`` element with the page text for each page of an untagged
    document; tagged documents give nothing."""
    untagged = pages.join(tags.select("doc_id").distinct(), "doc_id", "left_anti")
    return untagged.select(*PAGE, F.lit("Part").alias("element"), F.col("text").alias("alt"))


def compare_pixels(a: DataFrame, b: DataFrame, threshold: int = 10) -> DataFrame:
    """Pixels differing by more than the threshold in a channel, or on one side
    only."""
    keys = ["page_id", "px", "py"]
    left = a.select(*keys, F.struct("r", "g", "b").alias("left"))
    right = b.select(*keys, F.struct("r", "g", "b").alias("right"))
    joined = left.join(right, keys, "full_outer")
    far = F.lit(False)
    for c in ("r", "g", "b"):
        far = far | (F.abs(F.col(f"left.{c}") - F.col(f"right.{c}")) > threshold)
    state = _side(F.col("left"), F.col("right")).otherwise(F.when(far, F.lit("changed")))
    return joined.select(*keys, state.alias("state")).filter("state IS NOT NULL")


def compare_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Line by line differences of two versions of the same pages."""
    keys = [*PAGE, "line_no"]
    joined = a.select(*keys, F.col("text").alias("left")).join(
        b.select(*keys, F.col("text").alias("right")), keys, "full_outer"
    )
    state = _side(F.col("left"), F.col("right")).otherwise(
        F.when(F.col("left") != F.col("right"), F.lit("changed"))
    )
    return joined.withColumn("state", state).filter("state IS NOT NULL")


def _side(left: Column, right: Column) -> Column:
    return F.when(right.isNull(), F.lit("left only")).when(left.isNull(), F.lit("right only"))


def verify_digests(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Check text against a manifest of digests: verified, changed or unsigned.

    Texts are hashed where they are read; only digests are shuffled. A document that
    the manifest lists several times is verified if one of its digests agrees.
    """
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    signed = manifest.where("digest IS NOT NULL").select("doc_id", "digest").distinct()
    listed = signed.select("doc_id").distinct().withColumn("_listed", F.lit(True))
    joined = hashed.join(signed.withColumn("_agrees", F.lit(True)), ["doc_id", "digest"], "left").join(listed, "doc_id", "left")
    status = F.when(F.col("_agrees"), F.lit("verified")).when(F.col("_listed"), F.lit("changed")).otherwise(F.lit("unsigned"))
    return joined.select("doc_id", status.alias("status"))


def changed_lines(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("text",)) -> DataFrame:
    """Rows more frequent in one version than in the other, with the surplus.

    The multiset difference both ways in one aggregate: equal lines cancel in the
    partial counts, however often they repeat."""
    stacked = a.select(*keys, F.lit(1).alias("_n")).unionByName(b.select(*keys, F.lit(-1).alias("_n")))
    surplus = stacked.groupBy(*keys).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return surplus.select(
        *keys,
        F.when(F.col("_n") > 0, F.lit("left only")).otherwise(F.lit("right only")).alias("side"),
        F.abs("_n").alias("copies"),
    )
