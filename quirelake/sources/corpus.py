"""Reading a corpus: page tables, binary files, saved state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Page size.
PAGE_WIDTH = 612.0
PAGE_HEIGHT = 792.0

PAGE_FIELDS = "page int, text string"
EXTRACT_SCHEMA = f"path string, {PAGE_FIELDS}, error string"
# Error codes of extraction.
ERROR_CODES = (
    "OpenFailed", "PasswordRequired", "PageNotFound", "RenderFailed", "SearchError", "IoError", "EngineError",
)
TOO_LARGE = "TooLarge"


class ExtractError(Exception):
    """Raised by an extractor to report a typed failure."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message)
        self.code = code if code in ERROR_CODES else "EngineError"


def paginate(documents: DataFrame, lines_per_page: int = 10) -> DataFrame:
    """Cut each document's text into pages of a number of lines.

    A document without text is one page of height 0. Cutting happens inside the
    row, in one pass of a pattern that takes ``lines_per_page`` lines at a time: no
    shuffle, and time in proportion to the text.
    """
    # Every line ends in a line end here, so a page is its lines but the last end.
    taken = F.regexp_extract_all(F.concat("text", F.lit("\n")), F.lit(rf"(?:[^\n]*+\n){{1,{lines_per_page}}}+"), F.lit(0))
    cut = F.transform(taken, lambda page: F.left(page, F.length(page) - 1))
    texts = F.when(F.col("text").isNull(), F.array(F.lit(None).cast("string"))).otherwise(cut)
    return documents.select("doc_id", F.posexplode(texts).alias("page", "text")).select(
        "doc_id", "page",
        F.lit(PAGE_WIDTH).alias("width"),
        F.when(F.col("text").isNull(), F.lit(0.0)).otherwise(F.lit(PAGE_HEIGHT)).alias("height"),
        F.lit(0).alias("rotation"),
        (F.col("page") + 1).cast("string").alias("label"),
        "text",
    )


def read_corpus(spark: SparkSession, folder: str, lines_per_page: int = 10) -> DataFrame:
    """The page table of a folder's ``documents`` table."""
    return paginate(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), lines_per_page)


Extractor = Callable[[bytes], Iterable[tuple]]

#: Rows that are handed on at once.
ROWS_AT_ONCE = 4096
#: Bytes of files whose rows wait for each other.
BYTES_AT_ONCE = 1 << 20


def extract(binary: DataFrame, extractor: Extractor, fields: str = PAGE_FIELDS, keep: Sequence[str] = ("path",)) -> DataFrame:
    """Run a user's extractor over files with ``content``; ``keep`` names columns to carry along.

    ``extractor(content)`` yields tuples of ``fields``, which may hold whatever one
    reading of a file finds: pages, their links, headings, marks. Whatever it raises
    becomes one row with an error code; the job goes on.
    """
    schema = T.StructType.fromDDL(fields)
    whole = [f.name for f in schema.fields if isinstance(f.dataType, T.IntegralType)]

    def rows_of(content: bytes) -> Iterator[tuple]:
        """Rows one by one; one with an error in place of what a failing extractor gave."""
        try:
            found = [(*row, None) for row in extractor(bytes(content))]
        except ExtractError as problem:
            found = [(*[None] * len(schema), problem.code)]
        except Exception:
            found = [(*[None] * len(schema), "OpenFailed")]
        return iter(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = batch[list(keep)]
            held: list[tuple] = []
            of: list[int] = []
            read = 0

            def packed() -> pd.DataFrame:
                out = pd.DataFrame(held, columns=[*schema.names, "error"]).astype({name: "Int64" for name in whole})
                return pd.concat([names.iloc[of].reset_index(drop=True), out], axis=1)

            for k, content in enumerate(batch["content"]):
                # Small files share a frame, as a frame costs more than their rows; a large file's rows leave some at a time.
                rows = rows_of(content)
                while some := list(islice(rows, ROWS_AT_ONCE - len(held))):
                    held += some
                    of += [k] * len(some)
                    if len(held) == ROWS_AT_ONCE:
                        yield packed()
                        held, of, read = [], [], 0
                read += len(content or b"")
                if held and read >= BYTES_AT_ONCE:
                    yield packed()
                    held, of, read = [], [], 0
            if held:
                yield packed()

    kept = binary.select(*keep).schema.fields
    return binary.select(*keep, "content").mapInPandas(run, T.StructType([*kept, *schema.fields, T.StructField("error", T.StringType())]))


def read_binary(spark: SparkSession, glob: str, extractor: Extractor, max_bytes: int | None = None, fields: str = PAGE_FIELDS) -> DataFrame:
    """Read files and extract what ``fields`` names; ``path`` comes along.

    With ``max_bytes``, larger files become error rows of code ``TooLarge``. The
    size test reaches the source, so such a file is never loaded.
    """
    files = spark.read.format("binaryFile").load(glob)
    if max_bytes is None:
        return extract(files, extractor, fields)
    found = extract(files.filter(F.col("length") <= max_bytes), extractor, fields)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(fields).fields]
    return found.unionByName(files.filter(F.col("length") > max_bytes).select("path", *nothing, F.lit(TOO_LARGE).alias("error")))


def read_state_json(df: DataFrame, column: str, ddl: str, defaults: dict[str, object]) -> DataFrame:
    """Fields of a saved JSON state, tolerantly.

    Fields that parse are kept one by one; a missing or ill-typed field, or a
    text that is no JSON at all, falls back to its default.
    """
    schema = T.StructType.fromDDL(ddl)
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})

    def value(field: T.StructField) -> Column:
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        return F.coalesce(parsed[field.name], default).alias(field.name)

    return df.select(*[F.col(c) for c in df.columns if c != column], *[value(f) for f in schema.fields])
