"""Personal data, and the terms that reveal it: information-theoretic sanitisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.session import settle

#: Kinds in the order of a result, with patterns for the leftmost greedy matches. A
#: match starts where a run of its characters starts (or where the match before it
#: ended), and repeats never give back, so long runs cost one pass.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A part of an address that is at most 255.
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Distinct texts that must show a term beside an entity.
SUPPORT = 3
#: Shares of an entity's information at which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Letters a term has at least.
TERM_LETTERS = 3
_NOT_WORD = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}]+"


def _luhn(match: Column) -> Column:
    """Whether the digits pass the check: every second one from the right is doubled."""
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, k: F.when(k % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda n, d: n + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.char_length(F.regexp_replace(match, "[^0-9]", ""))
    return (
        F.when(kind == "ip", F.regexp_like(match, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")))
        .when(kind == "card", _luhn(match))
        .when(kind == "phone", digits.between(8, 15))
        .otherwise(True)
    )


def _parts(text: Column, pattern: str) -> Column:
    """What stands before each match, with the match; after the last, a null one."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))


def _located(parts: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Matches with ``start`` and ``end`` in code points, end exclusive, from exploded ``no, part``.

    What stands between matches and the matches themselves add up to the text, so
    places are running sums of their lengths.
    """
    parts = parts.where("part.match IS NOT NULL").select(*keys, *more, "no", F.char_length("part.gap").alias("gap"), F.col("part.match").alias("match"))
    seen = Window.partitionBy(*keys).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("match")).over(seen)
    return parts.withColumn("end", end).select(*keys, *more, "match", (F.col("end") - F.char_length("match")).alias("start"), "end")


class Personal:
    """Base spans of a table of documents, and what the terms around them reveal.

    All is found per distinct text: rows of one text share their results. ``text_id`` stands
    for a text and ``copies`` is the number of ids it has, a null one included. A null text is an empty one.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        any_kind = reduce(lambda a, b: a | b, [F.regexp_like("text", F.lit(p)) for p in KINDS.values()])
        copies = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
        texts = self.docs.where(any_kind).groupBy(F.sha2("text", 256).alias("sha")).agg(F.any_value("text").alias("text"), copies.alias("copies"))
        #: Texts with personal data, once each.
        self.held = settle(texts.withColumn("text_id", F.monotonically_increasing_id()), "pii-held")
        self.base = settle(self._base(), "pii-base")

    def _base(self) -> DataFrame:
        kinds = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"), _parts(F.col("text"), p).alias("parts")) for k, (kind, p) in enumerate(KINDS.items())])
        each = self.held.select("text_id", F.explode(kinds).alias("of")).where(F.size("of.parts") > 1)
        parts = each.select("text_id", F.col("of.rank").alias("rank"), F.col("of.kind").alias("kind"), F.posexplode("of.parts").alias("no", "part"))
        return _located(parts, ["text_id", "rank"], "kind").where(_valid(F.col("kind"), F.col("match")))

    def _terms(self, text: Column) -> Column:
        words = F.array_distinct(F.split(F.lower(text), _NOT_WORD))
        return F.filter(words, lambda w: (F.char_length(w) >= TERM_LETTERS) & F.regexp_like(w, F.lit(r"\p{L}")))

    def _entities(self) -> DataFrame:
        """Values with their classes per text: any value of the kind, an email's domain, the first
        two parts of an ip, the first four digits of a phone or six of a card. No value reads like a class."""
        value, digits = F.lower("match"), F.regexp_replace("match", "[^0-9]", "")
        part = (
            F.when(F.col("kind") == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))
            .when(F.col("kind") == "ip", F.concat(F.lit("prefix:"), F.substring_index(value, ".", 2)))
            .otherwise(F.concat(F.lit("prefix:"), F.substring(digits, 1, F.when(F.col("kind") == "card", 6).otherwise(4))))
        )
        return self.base.select("text_id", "kind", F.explode(F.array(value, part, F.lit("kind:"))).alias("entity")).distinct()

    def revealing(self, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame | None:
        """``kind, entity, term, share, action``: terms that disclose an entity; None if no entity has support.

        Entities are exact values and the classes of :meth:`_entities`. An entity ``c`` has information ``-log2 p(c)``; a term ``t`` discloses their
        pointwise mutual information ``log2 p(c, t) / (p(c) p(t))`` of it. Chances
        are shares of all documents; a pair needs ``support`` distinct texts. A term
        is removed or generalised by the share of the information it discloses.

        Pairs that can't get there are left out before they are counted, none else: terms
        in fewer than ``support`` of the texts held, and, as a pair stands in no more
        documents than its entity, terms in more than ``n_c^g N^(1-g)`` documents for the share ``g``.
        """
        values = self._entities().join(self.held.select(F.col("text_id").alias("_text"), "copies"), F.col("text_id") == F.col("_text")).drop("_text")
        known = values.groupBy("kind", "entity").agg(F.sum("copies").alias("n_c"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
        known = settle(known, "pii-entities")
        most = known.agg(F.max("n_c").alias("n")).first()["n"]
        if most is None:
            return None
        n = float(max(self.docs.count(), 1))
        outside = reduce(lambda t, p: F.regexp_replace(t, p, " "), KINDS.values(), F.col("text"))
        words = settle(self.held.select("text_id", F.explode(self._terms(outside)).alias("term")), "pii-words")
        often = words.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= support).select("term")
        every = self.docs.select(F.explode(self._terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
        # A little room, so that rounding drops no pair here.
        least = generalise - 1e-9
        terms = settle(every.where(F.col("n_t") <= float(most) ** least * n ** (1 - least)).join(often, "term"), "pii-terms")
        seen = words.join(terms, "term").join(values.join(known, ["kind", "entity"]), "text_id")
        pairs = (
            seen.where(F.col("n_t") <= F.pow("n_c", F.lit(least)) * n ** (1 - least)).groupBy("kind", "entity", "n_c", "term", "n_t")
            .agg(F.sum("copies").alias("n_ct"), F.count("*").alias("texts")).where(F.col("texts") >= support)
        )
        total = F.lit(n)
        share = F.log2(F.col("n_ct") * total / (F.col("n_c") * F.col("n_t"))) / F.log2(total / F.col("n_c"))
        found = pairs.where(F.col("n_c") < total).withColumn("share", share).where(F.col("share") >= generalise)
        return settle(found.select("kind", "entity", "term", "share", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action")), "pii-revealing")

    def added(self, **thresholds: float) -> DataFrame | None:
        """Spans of revealing terms in the texts that hold their entity, outside base spans."""
        terms = self.revealing(**thresholds)
        if terms is None or terms.isEmpty():
            return None
        words = self.held.select("text_id", F.explode(self._terms(F.col("text"))).alias("term"))
        flagged = settle(
            words.join(terms, "term").join(self._entities(), ["text_id", "kind", "entity"]).groupBy("text_id", "term").agg(F.max("action").alias("action")), "pii-flagged")
        concerned = self.held.join(flagged.select("text_id").distinct().hint("merge"), "text_id", "left_semi")
        located = _located(concerned.select("text_id", F.posexplode(_parts(F.col("text"), _WORD)).alias("no", "part")), ["text_id"])
        # Written small, but many rows: never broadcast by the size of its files.
        hit = located.withColumn("term", F.lower("match")).join(flagged.hint("merge"), ["text_id", "term"])
        spans = hit.select("text_id", F.col("action").alias("kind"), "match", "start", "end", F.when(F.col("action") == "generalise", len(KINDS)).otherwise(len(KINDS) + 1).alias("rank"))
        covered = self.base.select(F.col("text_id").alias("_text"), F.col("start").alias("_from"), F.col("end").alias("_to"))
        return spans.join(covered, (F.col("text_id") == F.col("_text")) & (F.col("start") < F.col("_to")) & (F.col("_from") < F.col("end")), "left_anti")

    def spans(self, **thresholds: float) -> DataFrame:
        """``text_id, rank, kind, match, start, end``: base spans and added ones."""
        added = self.added(**thresholds)
        return self.base if added is None else self.base.unionByName(added)


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.collect_list(spans))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts per kind, ``base_spans``, ``spans`` and ``n_revealing``.

    Spans read ``kind:start:end``, in the order of kinds (email, ip, card, phone,
    generalise, remove) and of starts, joined by commas. Texts without personal data,
    null and empty ones among them, have none. Repeated rows get equal results; an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    found = Personal(docs, id_col, text_col)
    span = F.struct("rank", "start", "end", "kind")
    base = F.col("rank") < len(KINDS)
    per_text = found.spans(support=support, generalise=generalise, remove=remove).groupBy("text_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in KINDS],
        _joined(F.when(base, span)).alias("base_spans"), _joined(span).alias("spans"), F.count_if(~base).alias("n_revealing"),
    )
    named = found.docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    joined = named.join(found.held.select("text_id", "sha").join(per_text, "text_id"), "sha", "left")
    return joined.select(
        "doc_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in (*(f"n_{k}" for k in KINDS),)],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")], F.coalesce("n_revealing", F.lit(0)).cast("long").alias("n_revealing"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> DataFrame:
    """``doc_id, text`` of every row: base spans read ``[EMAIL]`` and so on, generalised
    terms ``[TERM]``, removed terms are gone. Of overlapping spans the first counts. Rows
    without personal data keep their text, a null one reads empty; repeated rows read alike."""
    found = Personal(docs, id_col, text_col)
    before = Window.partitionBy("text_id").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.spans(**thresholds).withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0))).where("start >= past")
    per_text = spans.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "past", "kind"))).alias("cuts"))
    tag = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    kept = F.transform("cuts", lambda s: F.concat(F.col("text").substr(s["past"] + 1, s["start"] - s["past"]), tag(s)))
    tail = F.substring("text", F.element_at("cuts", -1)["end"] + 1, F.char_length("text"))
    clean = found.held.join(per_text, "text_id").select("sha", F.concat(F.array_join(kept, ""), tail).alias("clean"))
    named = found.docs.withColumn("sha", F.sha2("text", 256))
    return named.join(clean, "sha", "left").select("doc_id", F.coalesce("clean", "text").alias("text"))
