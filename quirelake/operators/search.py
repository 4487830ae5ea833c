"""Full-text search with positions, hit numbering and title lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import context_snippet, fold
from quirelake.operators.layout import PAGE
from quirelake.operators.matching import join_same
from quirelake.operators.prefix import running_total
from quirelake.session import settle

# Texts are searched in pieces of this many characters, overlapping by the query
# length, so the work per piece is bounded and grows linearly with the text.
PIECE = 256
# Offsets per block in the hit-to-span join.
SPAN_BLOCK = 1024
# Queries are looked up by a gram of at most this many characters, which stands in their head.
GRAM, HEAD = 3, 64
# Numbers that grams are hashed to before they leave a row.
SLOTS = 1 << 16


def _quoted(needle: Column) -> Column:
    inner = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def _piece_pattern(overlap: Column) -> Column:
    return F.concat(F.lit("(?s)(?=(.{1,"), (overlap + PIECE).cast("string"), F.lit(f"}})).{{1,{PIECE}}}"))


def _pieces(rows: DataFrame, keep: list[str], overlap: Column, same_case: bool) -> DataFrame:
    """Texts cut into pieces that share ``overlap`` characters with the next one.

    A look-ahead captures a piece with its overlap while the pattern itself
    advances by the piece alone, so one linear pass cuts the whole text.
    """
    cut = rows.select(*keep, F.posexplode(F.regexp_extract_all("text", _piece_pattern(overlap), F.lit(1))).alias("_piece_no", "_piece"))
    return cut.withColumn("_seen", F.col("_piece") if same_case else fold(F.col("_piece")))


def _matches(pieces: DataFrame, keep: list[str], needle: Column) -> DataFrame:
    """Every start of ``needle`` in the pieces, overlapping ones included.

    A look-ahead matches without consuming, and its capture runs from the match
    to the end of the piece: the capture's length tells the position. A start in
    the overlap belongs to the next piece.
    """
    rest = F.regexp_extract_all("_seen", F.concat(F.lit("(?s)(?=("), _quoted(needle), F.lit(".*))")), F.lit(1))
    found = (
        pieces.filter(F.col("_seen").contains(needle))
        .select(*keep, "_piece_no", "_piece", needle.alias("_needle"), F.explode(rest).alias("_rest"))
        .withColumn("_at", F.length("_piece") - F.length("_rest"))
    )
    return found.filter(F.col("_at") < PIECE).select(
        *keep,
        (F.col("_piece_no") * PIECE + F.col("_at")).alias("pos"),
        F.substring("_piece", F.col("_at") + 1, F.length("_needle")).alias("text"),
    )


def _needle(query: str, same_case: bool) -> str:
    return query if same_case else query.replace("İ", "i").lower()


def search(pages: DataFrame, query: str, case_sensitive: bool = False, page: int | None = None) -> DataFrame:
    """Hits ``(doc_id, page, pos, text)`` of a substring in every page.

    ``pos`` counts characters from zero, matches may overlap, ``text`` keeps the
    page's own case. An empty query has no hits. Scan, filter and generate only:
    no shuffle.
    """
    needle = _needle(query, case_sensitive)
    look = F.col("text") if case_sensitive else fold(F.col("text"))
    rows = pages.filter(look.contains(needle) if needle else F.lit(False))
    if page is not None:
        rows = rows.filter(F.col("page") == page)
    pieces = _pieces(rows, list(PAGE), F.lit(max(len(needle) - 1, 0)), case_sensitive)
    return _matches(pieces, list(PAGE), F.lit(needle))


def search_snippets(pages: DataFrame, query: str, case_sensitive: bool = False, around: int = 20) -> DataFrame:
    """Hits ``(doc_id, page, pos, text, snippet)``: as :func:`search`, with the text around each.

    The snippet is cut where the hit is found, out of its piece and the end of what
    is before it: no shuffle.
    """
    needle = _needle(query, case_sensitive)
    look = F.col("text") if case_sensitive else fold(F.col("text"))
    rows = pages.filter(look.contains(needle) if needle else F.lit(False))
    # One character more than a snippet shows on either side, which tells whether the text goes on.
    cut = rows.select(*PAGE, F.regexp_extract_all("text", _piece_pattern(F.lit(len(needle) + around)), F.lit(1)).alias("_cuts"))

    def before(i: Column) -> Column:
        behind = [F.coalesce(F.left(F.get("_cuts", i - k), F.lit(PIECE)), F.lit("")) for k in range(around // PIECE + 1, 0, -1)]
        return F.right(F.concat(*behind), F.lit(around + 1))

    pieces = cut.select(*PAGE, F.inline(F.transform("_cuts", lambda piece, i: F.struct(i.alias("_piece_no"), piece.alias("_piece"), before(i).alias("_left")))))
    seen = pieces.withColumns({"_seen": F.col("_piece") if case_sensitive else fold(F.col("_piece")), "_held": F.concat("_left", "_piece")})
    found = _matches(seen, [*PAGE, "_left", "_held"], F.lit(needle))
    at = F.pmod("pos", F.lit(PIECE)) + F.length("_left")
    return found.select(*PAGE, "pos", "text", context_snippet(F.col("_held"), at, F.length("text"), around).alias("snippet"))


def snippets(pages: DataFrame, hits: DataFrame, around: int = 20) -> DataFrame:
    """Every hit with the text around it: ``(doc_id, page, pos, snippet)``."""
    # A page's hits come out of one row and go back to it, so its text moves once.
    places = hits.groupBy(*PAGE).agg(F.collect_list(F.struct("pos", F.length("text").alias("n"))).alias("_hits"))
    met = pages.select(*PAGE, "text").join(places, list(PAGE))
    cut = F.transform("_hits", lambda h: F.struct(h["pos"].alias("pos"), context_snippet(F.col("text"), h["pos"], h["n"], around).alias("snippet")))
    return met.select(*PAGE, F.inline(cut))


def search_counts(hits: DataFrame, by_page: bool = False) -> DataFrame:
    """Number of hits per document (or page)."""
    keys = PAGE if by_page else PAGE[:1]
    return hits.groupBy(*keys).agg(F.count("*").alias("hits"))


def search_many(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits ``(query_id, doc_id, page, pos, text)`` of every query.

    ``queries`` has query_id and query; blank queries have no hits. Every query is
    looked up by one gram of its first ``HEAD`` characters, the one that fewest queries have. Page
    texts are cut into pieces, and only places whose gram a query may have leave their
    row: a filter of at most ``SLOTS`` numbers tells, however many queries there are. A place
    takes along as much text as a head is long, so that heads are compared where they meet; the
    adaptive join splits grams that many places hold. The rest of a longer query is compared with its page's text,
    to which only places that hold the whole head go.
    """
    wanted = queries.select("query_id", fold(F.col("query")).alias("needle")).filter("needle != ''")
    # Settled, so that its size is known before the places are found: few queries go to the places.
    asked = settle(_anchors(wanted.withColumn("head", F.substring("needle", 1, HEAD))), "search-queries")
    most = asked.agg(F.max(F.length("head")).alias("length"), F.max("_shift").alias("shift"), F.collect_set(F.length("gram")).alias("sizes")).first()
    length, shift, sizes = most["length"] or 1, most["shift"] or 0, most["sizes"] or [1]
    slots = [r["slot"] for r in asked.select(_slot(F.col("gram")).alias("slot")).distinct().collect()]
    pieces = _pieces(pages, list(PAGE), F.lit(length - 1), False)
    # The look-ahead stops at every character, so the place in the list is the position.
    at = [
        F.transform(F.regexp_extract_all("_seen", F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), lambda gram, k: F.struct(gram.alias("gram"), k.alias("_from")))
        for n in sorted(sizes)
    ]
    some = F.filter(F.concat(*at), lambda place: _slot(place["gram"]).isin(slots))
    begin = F.greatest(F.col("_from") - shift, F.lit(0))
    held = pieces.select(*PAGE, "_piece_no", "_piece", F.inline(some)).select(
        *PAGE, (F.col("_piece_no") * PIECE).alias("_base"), "gram", "_from", begin.alias("_begin"), F.substring("_piece", begin + 1, shift + length).alias("_slice"))
    start = F.col("_from") - F.col("_shift")
    found = held.join(asked, "gram").where((start >= 0) & (start < PIECE)).withColumn("_text", F.substring("_slice", start - F.col("_begin") + 1, F.length("head")))
    met = found.where(fold(F.col("_text")) == F.col("head")).select("query_id", *PAGE, (F.col("_base") + start).alias("pos"), F.col("_text").alias("text"), "needle")
    short = met.where(F.length("needle") <= HEAD).drop("needle")
    long = join_same(met.where(F.length("needle") > HEAD).drop("text"), pages.select(*PAGE, F.col("text").alias("_whole")), PAGE)
    whole = long.withColumn("text", F.substring("_whole", F.col("pos") + 1, F.length("needle"))).where(fold(F.col("text")) == F.col("needle"))
    return short.unionByName(whole.select(*short.columns))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def _grams(text: Column, size: int) -> Column:
    """Distinct grams of one size. Look-ahead keeps it one linear pass."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))
    return F.array_distinct(F.filter(found, lambda g: F.length(g) == size))


def _anchors(wanted: DataFrame) -> DataFrame:
    """``query_id, needle, head, gram, _shift``: each query with the gram of its head that
    fewest queries have, and where in the head that gram first stands.

    So no gram gathers more queries than it must.
    """
    size = F.least(F.length("head"), F.lit(GRAM))
    own = F.when(size == 1, _grams(F.col("head"), 1)).when(size == 2, _grams(F.col("head"), 2)).otherwise(
        _grams(F.col("head"), GRAM)
    )
    query_grams = wanted.select("query_id", "needle", "head", F.explode(own).alias("gram"))
    shared = query_grams.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = query_grams.join(shared, "gram").groupBy("query_id", "needle", "head").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return chosen.withColumn("_shift", F.instr("head", F.col("gram")) - 1)


def hit_to_span(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Give each hit the box of the span its start falls in, at least 12 by 12.

    ``spans`` carries start and end (see ``span_offsets``). Both sides meet on
    blocks of ``SPAN_BLOCK`` characters, so a key never gathers more than that
    many spans; a start lies in one block only, so no pair comes twice.
    """
    first, last = F.floor(F.col("start") / SPAN_BLOCK), F.floor((F.col("end") - 1) / SPAN_BLOCK)
    placed = (
        spans.filter(F.col("end") > F.col("start"))
        .select(*PAGE, "word_no", "start", "end", "x", "y", "width", "height", F.explode(F.sequence(first, last)).alias("_block"))
    )
    located = hits.withColumn("_block", F.floor(F.col("pos") / SPAN_BLOCK)).join(placed, [*PAGE, "_block"])
    return located.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).select(
        *[F.col(c) for c in hits.columns],
        "word_no", "x", "y",
        F.greatest("width", F.lit(12.0)).alias("width"),
        F.greatest("height", F.lit(12.0)).alias("height"),
    )


def number_hits(hits: DataFrame) -> DataFrame:
    """Add ``hit_no``: place of a hit in its document, from zero, by page and position.

    A page's hits come out of one row, so they may meet in one window; a document's
    are counted by page first. Nothing runs until the result is asked for, and then
    the counting passes read the hits again: settle hits that are costly to find.
    """
    inside = hits.withColumn("_inside", F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos")) - 1)
    per_page = hits.groupBy(*PAGE).agg(F.count("*").alias("_n"))
    earlier = running_total(per_page, PAGE[:1], "page", F.col("_n"), "_earlier").select(*PAGE, "_earlier")
    return (
        join_same(inside, earlier, PAGE)
        .withColumn("hit_no", F.col("_inside") + F.col("_earlier"))
        .drop("_inside", "_earlier")
    )


def next_prev_hit(numbered: DataFrame) -> DataFrame:
    """Page and position of the next and previous hit, going round at the ends.

    Each hit tells its two neighbours where it is; one shuffle brings the three
    messages for a place together.
    """
    total = numbered.groupBy("doc_id").agg(F.count("*").alias("_n"))
    place = F.struct("page", "pos")
    told = (
        join_same(numbered, total, ["doc_id"])
        .select(
            "doc_id",
            F.explode(
                F.array(
                    F.struct(F.lit("self").alias("role"), F.col("hit_no").alias("to")),
                    F.struct(F.lit("next").alias("role"), F.pmod(F.col("hit_no") - 1, F.col("_n")).alias("to")),
                    F.struct(F.lit("prev").alias("role"), F.pmod(F.col("hit_no") + 1, F.col("_n")).alias("to")),
                )
            ).alias("m"),
            place.alias("place"),
        )
        .groupBy("doc_id", F.col("m.to").alias("hit_no"))
        .agg(*[F.max(F.when(F.col("m.role") == r, F.col("place"))).alias(r) for r in ("self", "next", "prev")])
    )
    return told.select(
        "doc_id", "hit_no", "self.page", "self.pos",
        F.col("next.page").alias("next_page"), F.col("next.pos").alias("next_pos"),
        F.col("prev.page").alias("prev_page"), F.col("prev.pos").alias("prev_pos"),
    )


def paged_hits(numbered: DataFrame, offset: int, n: int) -> DataFrame:
    """Hits ``offset`` to ``offset + n - 1`` of every document: a filter on the
    hit number, not a sort."""
    return numbered.filter((F.col("hit_no") >= offset) & (F.col("hit_no") < offset + n))


def fuzzy_find(titles: DataFrame, query: str, k: int) -> DataFrame:
    """The ``k`` best titles holding the query's characters in order.

    ``titles`` has id, title, category, subtitle. The score is minus the length
    of the shortest stretch holding the characters; ties keep id order. A blank
    query keeps everything in id order.
    """
    wanted = _needle(query.strip(), False)
    if not wanted:
        return titles.withColumn("score", F.lit(0)).orderBy("id")
    text = fold(F.concat_ws(" ", "title", "category", F.coalesce("subtitle", F.lit(""))))
    return (
        titles.withColumn("score", -_shortest_stretch(text, wanted))
        .filter("score IS NOT NULL")
        .orderBy(F.col("score").desc(), "id")
        .limit(k)
    )


def _shortest_stretch(text: Column, wanted: str) -> Column:
    """Length of the shortest stretch of ``text`` with the characters of ``wanted`` in order.

    One pass over the characters keeps, for each beginning of ``wanted``, the latest
    place from which it has been met; NULL where there is no stretch.
    """
    nowhere = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.array(*[nowhere] * len(wanted)).alias("begun"), nowhere.alias("best"))

    def step(acc: Column, char: Column) -> Column:
        begun = [
            F.when(char == c, acc["at"] if k == 0 else acc["begun"][k - 1]).otherwise(acc["begun"][k]) for k, c in enumerate(wanted)
        ]
        ended = F.when(char == wanted[-1], acc["at"] - begun[-1] + 1)
        return F.struct((acc["at"] + 1).alias("at"), F.array(*begun).alias("begun"), F.least(acc["best"], ended).alias("best"))

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["best"])
