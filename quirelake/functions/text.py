"""Text expressions: escaping, page blocks, names, snippets, delimited cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters with the Unicode White_Space property.
WHITESPACE = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def fold(text: Column) -> Column:
    """Lower case without changing length.

    U+0130 is the one letter whose lower case is two characters; it becomes a
    plain ``i`` so that positions in folded text are positions in the original.
    """
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def fold_ascii(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trimmed(text: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def words_of(text: Column) -> Column:
    """The white-space separated words of a text as an array."""
    return F.filter(F.split(text, f"{WHITESPACE}+"), lambda word: word != "")


def html_escape(text: Column) -> Column:
    """Escape ``&``, ``<`` and ``>``; the ampersand first."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def export_format(fmt: str) -> str:
    """``md``, ``html`` or ``txt``; anything unknown is plain text."""
    name = fmt.lower()
    if name in ("md", "markdown"):
        return "md"
    return "html" if name == "html" else "txt"


def page_block(text: Column, page: Column, fmt: str) -> Column:
    """One page of an export with its heading; ``page`` counts from zero."""
    number = (page + 1).cast("string")
    kind = export_format(fmt)
    if kind == "md":
        return F.concat(F.lit("## Page "), number, F.lit("\n\n"), text, F.lit("\n\n"))
    if kind == "html":
        return F.concat(
            F.lit("<section><h2>Page "), number, F.lit("</h2><pre>"),
            html_escape(text), F.lit("</pre></section>\n"),
        )
    return F.concat(F.lit("--- Page "), number, F.lit(" ---\n\n"), text, F.lit("\n\n"))


def export_frame(fmt: str) -> tuple[str, str]:
    """Text before the first and after the last page of an export."""
    if export_format(fmt) == "html":
        # The page skeleton of the export format.
        head = (
            '<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n'
            "<title>Converted PDF</title>\n</head>\n<body>\n"
        )
        return head, "</body>\n</html>\n"
    return "", ""


def fill_placeholders(fmt: Column, page: Column, pages: Column) -> Column:
    """Replace ``{page}``, then ``{pages}``."""
    out = F.replace(fmt, F.lit("{page}"), page.cast("string"))
    return F.replace(out, F.lit("{pages}"), pages.cast("string"))


def file_name(path: Column) -> Column:
    """Last part of a path, ``Unknown`` when there is none."""
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(last.isin("", ".."), F.lit("Unknown")).otherwise(F.coalesce(last, F.lit("Unknown")))


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    name = file_name(path)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def suffix_name(path: Column, tag: str, ext: str = ".pdf") -> Column:
    """``dir/report.pdf`` with tag ``signed`` becomes ``dir/report_signed.pdf``."""
    folder = F.regexp_extract(path, r"^(.*/)[^/]+/*$", 1)
    return F.concat(folder, file_stem(path), F.lit(f"_{tag}{ext}"))


def dehyphenate(text: Column) -> Column:
    """Join words broken over a line end: ``coopera-\\ntion``."""
    return F.regexp_replace(text, r"(?<=[a-z])-\n(?=[a-z])", "")


def page_label(label: Column, page: Column) -> Column:
    """The printed label, or the one-based page number."""
    return F.coalesce(label, (page + 1).cast("string"))


def context_snippet(text: Column, pos: Column, length: Column, n: int) -> Column:
    """``n`` characters on both sides of a match, with ellipses where cut.

    ``pos`` counts from zero.
    """
    start = F.greatest(pos - n, F.lit(0))
    stop = pos + length + n
    body = F.substring(text, start + 1, stop - start)
    return F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
        body,
        F.when(stop < F.length(text), F.lit("...")).otherwise(F.lit("")),
    )


def _delimited_field(cell: Column, sep: str) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike(f'[{sep}"\r\n]'), quoted).otherwise(cell)


def delimited_row(cells: Column, sep: str) -> Column:
    """One line of delimited text; fields holding the separator, a quote or a
    line end are quoted, quotes doubled."""
    return F.array_join(F.transform(cells, lambda c: _delimited_field(c, sep)), sep)


def cells_to_csv(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda row: delimited_row(row, ",")), "\n")


def cells_to_tsv(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda row: delimited_row(row, "\t")), "\n")
