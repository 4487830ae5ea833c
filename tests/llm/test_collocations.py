import random
import re
from collections import Counter

import samples
from quirelake.llm.collocations import collocations, frequent_phrases, split_words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, depth=5):
    counts, totals = {}, Counter()
    for lang, text in rows:
        mine = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(len(words)):
                for d in range(1, min(depth, len(words) - k) + 1):
                    mine[tuple(words[k : k + d])] += 1
    return counts, totals


def brute(rows, top=2000, depth=5, support=100):
    counts, totals = counted(rows, depth)
    out = []
    for lang, f in counts.items():
        n = totals[lang]
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        inside = set()
        for q, b in some.items():
            for d in range(2, len(q)):
                inside |= {(q[k : k + d], b) for k in range(len(q) - d + 1)}
        found = []
        for p, a in some.items():
            if not any((p, b) in inside for b in [a]):
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "h") for r in rows], "lang string, text string, n long, phrase string, a long, h string")


def corpus(seed=1, size=300):
    draw = random.Random(seed)
    words = ["The", "of", "and", "straße", "漢字", "x\x00y", "x", "x\x01", "\x01", "a\x02", "É", "é", "it's", "new", "york"]
    rows = []
    for k in range(size):
        text = ""
        for _ in range(draw.randrange(80)):
            text += draw.choice(["new york city hall of", "x x\x00y x", draw.choice(words), draw.choice(words), f"own{draw.randrange(400)}"])
            text += draw.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\r\n", " "])
        rows.append((draw.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, None), ("fr", " . , \t!")]


def test_against_brute_force(spark):
    rows = corpus()
    df = table(spark, rows)
    for how in ({"support": 20}, {"support": 5, "depth": 3}, {"support": 40, "top": 7}):
        got = sorted(map(tuple, collocations(df, **how).collect()))
        assert got == brute(rows, **how) and got


def test_small_budget_and_crowded_filters(spark):
    rows = corpus(2, 150)
    counts, _ = counted(rows)
    want = sorted((lang, " ".join(p), len(p), a) for lang, f in counts.items() for p, a in f.items() if len(p) > 1 and a >= 15)
    df = table(spark, rows).repartition(5)
    # Groups of a few suffixes: prefixes are extended to their full depth. 32,768 bits and 64 bits of filter.
    for budget, bits in ((3, 1 << 15), (60, 1 << 15), (10**6, 1 << 6)):
        phrases = frequent_phrases(df, support=15, budget=budget, bits=bits)[1]
        assert sorted(map(tuple, phrases.collect())) == want


def test_long_text_in_parts():
    text = " ".join(f"w{k % 7}{'.' if k % 11 == 0 else ''}" for k in range(500))
    whole = next(split_words(text))[0]
    grams = lambda words, own: Counter(tuple(words[k : k + 4]) for k in range(own))
    for part in (1, 5, 40, 333):
        found = Counter()
        for words, own in split_words(text, 4, part):
            found += grams(words, own)
        assert found == grams(whole, len(whole))


def test_products_over_64_bits(spark):
    from quirelake.llm.collocations import scored

    words = spark.createDataFrame([("en", "a", 10**12), ("en", "b", 10**12 + 7), ("en", "c", 10**13)], "lang string, word string, n long")
    phrases = spark.createDataFrame([("en", "a b", 2, 10**12 - 1)], "lang string, phrase string, words int, n long")
    (row,) = scored(words, phrases).collect()
    n = 10**12 + 10**12 + 7 + 10**13
    assert row["score"] == 1000 * (10**12 - 1) * n // (10**12 * (10**12 + 7))


def test_odd_rows(spark):
    rows = [("en", t) for _, t in samples.odd_rows()] * 3 + [("en", "y " * 50_000)]
    assert sorted(map(tuple, collocations(table(spark, rows), support=3).collect())) == brute(rows, support=3)
    assert collocations(table(spark, [])).count() == 0


def test_leaves_of_frequent_prefixes_only(spark, monkeypatch):
    from quirelake.llm import collocations as module

    draw = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    # Every pair is frequent and hardly a triple; one passage is.
    rows = [("en", " ".join(draw.choice(words) for _ in range(60))) for _ in range(300)] + [("en", "one passage that comes again")] * 50
    made = []

    def kept(*args, f=module.leaf_totals):
        made.append(f(*args))
        return made[-1]

    monkeypatch.setattr(module, "leaf_totals", kept)
    phrases = frequent_phrases(table(spark, rows).repartition(4), support=40)[1]
    counts, _ = counted(rows)
    want = sorted(("en", " ".join(p), len(p), a) for p, a in counts["en"].items() if len(p) > 1 and a >= 40)
    assert sorted(map(tuple, phrases.collect())) == want and sum(r[2] == 2 for r in want) > 140
    leaves = [r["leaf"].split("\0") for r in made[0].collect()]
    assert leaves and all(len(leaf) > 2 and counts["en"][tuple(leaf)] >= 40 for leaf in leaves)


def test_counters_shared_by_many_prefixes(spark):
    rows = corpus(3, 120)
    counts, _ = counted(rows)
    df = table(spark, rows).repartition(3)
    for support in (15, 300):
        want = sorted((lang, " ".join(p), len(p), a) for lang, f in counts.items() for p, a in f.items() if len(p) > 1 and a >= support)
        for slots in (1 << 3, 1 << 17):
            assert sorted(map(tuple, frequent_phrases(df, support=support, slots=slots)[1].collect())) == want


def test_words_of_equal_hash(spark):
    from quirelake.llm.collocations import hashed

    rows = corpus(4, 120)
    counts, _ = counted(rows)
    want = sorted((lang, " ".join(p), len(p), a) for lang, f in counts.items() for p, a in f.items() if len(p) > 1 and a >= 15)
    phrases = frequent_phrases(table(spark, rows), support=15, digest=lambda data, seed: hashed(data, seed) if seed else len(data))[1]
    assert sorted(map(tuple, phrases.collect())) == want
