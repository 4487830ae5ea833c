"""Registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.collocations import collocations
from quirelake.llm.decontaminate import contamination
from quirelake.llm.exact_dedup import exact_groups
from quirelake.llm.html_extract import extract_pages
from quirelake.llm.line_dedup import without_repeats
from quirelake.llm.packing import pack
from quirelake.llm.pii import KINDS, find_personal
from quirelake.llm.quality import quality_scores
from quirelake.llm.sharding import assign_shards
from quirelake.llm.simhash import near_groups
from quirelake.llm.spelling import spelling_groups
from quirelake.llm.suffix_dedup import repeated_passages
from quirelake.llm.warc_fixity import audit, records
from quirelake.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's number and name."""

    def register(run: Query) -> Query:
        @wraps(run)
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return run(configure(spark), folder)

        QUERIES[name] = configured
        if sql is not None:
            CHECKS[name] = sql
        return configured

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_disclosure_pii")
def disclosure_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data and the terms that reveal it."""
    found = find_personal(table(spark, folder, "documents"))
    return found.select("doc_id", *[f"n_{kind}" for kind in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_revealing")


@query("op2_dominance_packing")
def dominance_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in its sequence of at most 4,096 tokens."""
    return pack(table(spark, folder, "documents"), with_ids=False)


_HEAD = """
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
"""


@query("op3_merkle_fixity_audit", f"""
    WITH whole AS (
        SELECT page_id, page_id // 1000 AS archive, page_id % 97 = 13 AS rotten, page_id % 101 = 7 AS lost,
            {_HEAD} || html || chr(13) || chr(10) || chr(13) || chr(10) AS record,
            {_HEAD} || replace(html, 'e', 'f') || chr(13) || chr(10) || chr(13) || chr(10) AS decayed
        FROM pages
    ),
    placed AS (SELECT *, sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(record) AS "offset" FROM whole)
    SELECT archive, CAST("offset" AS BIGINT) AS "offset", strlen(record) AS length, page_id AS record_id,
        CASE WHEN lost THEN 'missing' ELSE 'changed' END AS state, sha256(record) AS sha256,
        CASE WHEN NOT lost THEN sha256(decayed) END AS replica_sha256
    FROM placed WHERE lost OR (rotten AND record <> decayed)
""")
def merkle_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives of ``pages`` in which a decayed replica differs.

    The replica is that of a store in which letters of every 97th page rotted away and
    every 101st record was lost. Its own pages are read, hashed and indexed in full.
    """
    pages = table(spark, folder, "pages")
    html = F.when(F.col("page_id") % 97 == 13, F.replace("html", F.lit("e"), F.lit("f"))).otherwise(F.col("html"))
    replica = pages.where("page_id IS NULL OR page_id % 101 <> 7").select("page_id", "url", html.alias("html"))
    return audit(records(pages), records(replica))


@query("op4_min_cut_extraction")
def min_cut_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, folder, "pages"))


@query("op5_weighted_tree_shards")
def weighted_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards 0 to 15 of a balanced tree: two regions of two racks of four shards."""
    return assign_shards(table(spark, folder, "documents"), shards=16)


#: A-Z in lower case, other letters as they are.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op6_window_decontamination", rf"""
    WITH doc AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    test AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS width, list_slice(w, i, i + least(len(w), 10) - 1) AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
    ),
    held AS (
        SELECT doc_id, i, width, item_id
        FROM (SELECT doc_id, width, i, list_slice(w, i, i + width - 1) AS words
              FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
                    FROM doc JOIN (SELECT DISTINCT width FROM test) ON len(w) >= width))
        JOIN test USING (width, words)
    ),
    hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM held) GROUP BY doc_id),
    named AS (
        SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM held) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def window_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the words and test items that shared windows hit."""
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_simhash_pigeonhole")
def simhash_pigeonhole(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its SimHash and the smallest document it links to."""
    return near_groups(table(spark, folder, "documents"))


@query("op8_sparse_suffix_passages", rf"""
    WITH doc AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLDED}, '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
    windows AS (
        SELECT doc_id, i - 1 AS start, hash(list_slice(w, i, i + 49)) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)
    ),
    shared AS (SELECT h, MIN(doc_id) AS least, MAX(doc_id) AS most FROM windows GROUP BY h HAVING MIN(doc_id) <> MAX(doc_id)),
    met AS (
        SELECT doc_id, start, CASE WHEN doc_id = least THEN most ELSE least END AS other_id, doc_id = least AS first
        FROM windows JOIN shared USING (h)
    ),
    marked AS (SELECT *, CASE WHEN start - lag(start) OVER one <= 50 THEN 0 ELSE 1 END AS fresh FROM met WINDOW one AS (PARTITION BY doc_id, first ORDER BY start)),
    islands AS (SELECT *, SUM(fresh) OVER (PARTITION BY doc_id, first ORDER BY start) AS island FROM marked)
    SELECT doc_id, MIN(start) AS start, MAX(start) + 50 AS "end", MAX(start) + 50 - MIN(start) AS n_words, MIN(other_id) AS other_id, first
    FROM islands GROUP BY doc_id, first, island
""")
def sparse_suffix_passages(spark: SparkSession, folder: str) -> DataFrame:
    """All passages of 50 words or more that documents share with others."""
    return repeated_passages(table(spark, folder, "documents"))


@query("op9_random_indexing_quality")
def random_indexing_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its calibrated quality score."""
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_tree_merge_dedup", """
    WITH named AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    best AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM named GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM named JOIN best USING (text_sha256)
""")
def tree_merge_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row of its text that stays, the one of the largest id."""
    return exact_groups(table(spark, folder, "documents"), keep="largest")


@query("op11_phrase_collocations", rf"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]') AS p FROM documents),
    listed AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM piece),
    total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
    gram AS (
        SELECT lang, d, list_slice(w, i, i + d - 1) AS words
        FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM listed, range(1, 6) depth(d) WHERE len(w) >= d)
    ),
    f AS (SELECT lang, d, words, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= 100),
    inside AS (
        SELECT DISTINCT lang, list_slice(words, i, i + e - 1) AS words, a
        FROM (SELECT lang, words, a, d, e, unnest(range(1, d - e + 2)) AS i FROM f, range(2, 5) shorter(e) WHERE e < d)
    ),
    cut AS (
        SELECT lang, words, f.a, k, n, CAST(l.a AS BIGINT) AS l, CAST(r.a AS BIGINT) AS r,
            CAST((CAST(1000 AS HUGEINT) * f.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
        FROM (SELECT lang, words, a, unnest(range(1, d)) AS k FROM f WHERE d > 1) f
        JOIN (SELECT lang, words AS first, a FROM f) l USING (lang) JOIN (SELECT lang, words AS rest, a FROM f) r USING (lang) JOIN total USING (lang)
        WHERE l.first = list_slice(f.words, 1, k) AND r.rest = list_slice(f.words, k + 1, len(f.words))
    ),
    lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
    ranked AS (
        SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score
        FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = lowest.lang AND inside.words = lowest.words AND inside.a >= lowest.a)
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""")
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of each language by how much their words go together."""
    return collocations(table(spark, folder, "documents"))


@query("op12_spelling_variants", rf"""
    WITH RECURSIVE bits AS (
        SELECT i AS slot, 0 AS round, CAST(i AS UBIGINT) AS v FROM range(256) t(i)
        UNION ALL
        SELECT slot, round + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END FROM bits WHERE round < 8
    ),
    crc_table AS (SELECT list(v ORDER BY slot) AS crc_of FROM bits WHERE round = 8),
    run AS (
        SELECT doc_id, run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
    ),
    coded AS (
        SELECT run, n, flatten(list_transform(range(1, length(named) + 1), lambda i: CASE WHEN unicode(substr(named, i, 1)) < 128 THEN [unicode(substr(named, i, 1))]
            ELSE [192 + (unicode(substr(named, i, 1)) >> 6), 128 + (unicode(substr(named, i, 1)) & 63)] END)) AS bytes
        FROM (SELECT run, n, doc_id || ':' || run AS named FROM run)
    ),
    summed AS (
        SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(bytes, lambda b: CAST(b AS UBIGINT))),
            lambda crc, b: xor(crc >> 8, crc_of[CAST(xor(crc, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) AS h
        FROM coded, crc_table
    ),
    word AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM summed)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ),
    cut AS (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM word)
    ),
    pair AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT cut.word, word.word, word.n FROM cut JOIN word ON cut.rest = word.word
        UNION SELECT word.word, cut.word, cut.n FROM cut JOIN word ON cut.rest = word.word
    ),
    best AS (
        SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pair GROUP BY word
    ),
    formed AS (
        SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
        FROM word LEFT JOIN best USING (word)
    ),
    walk AS (
        SELECT word, word AS at, form AS next FROM formed
        UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON formed.word = walk.next
    )
    SELECT formed.word, form, walk.at AS root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.next IS NULL
""")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the corpus with its form, the last of its forms and its near words."""
    return spelling_groups(table(spark, folder, "documents"))


@query("op13_line_dedup", f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l, string_split({_FOLDED}, chr(10)) AS k FROM documents),
    line AS (SELECT r, doc_id, unnest(l) AS line, trim(unnest(k), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key, unnest(range(len(l))) AS i FROM doc),
    shared AS (SELECT key, min(doc_id) AS first FROM line WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    marked AS (SELECT line.*, shared.key IS NOT NULL AND doc_id <> first AS gone FROM line LEFT JOIN shared USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY r, doc_id
""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what is left of it once lines of other documents are gone."""
    left = without_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
