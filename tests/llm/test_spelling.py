import random
import zlib
from collections import Counter
import re

import samples
from quirelake.llm.spelling import near_in_list, spelling_groups, variants

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :] or a[at + 1 :] == b[at + 1 :]


def brute_variants(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    return out


def brute(rows, typo=97, chars=5, least=3):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    found = brute_variants({w: n for w, n in counts.items() if len(w) >= chars and n >= least})
    out = {}
    for w, (n, near, form, form_n) in found.items():
        root = w
        while found[root][2]:
            root = found[root][2]
        out[w] = (form, root, n, near, form_n)
    return out


def test_scan_against_brute_force():
    draw = random.Random(5)
    for _ in range(400):
        size, letters = draw.randrange(0, 5), draw.choice(["ab", "abc", "abcdéÿ"])
        words = sorted({"".join(draw.choice(letters) for _ in range(size + draw.randrange(2))) for _ in range(draw.randrange(80))})
        for last in (True, False):
            found = list(near_in_list(words, size, last))
            lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            want = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and one_edit(a, b) and min(len(a), len(b)) == size and (last or lcp(a, b) < size)]
            assert found == want


def test_lists_of_any_length(spark):
    draw = random.Random(9)
    words = {"".join(draw.choice("abé") for _ in range(draw.randrange(1, 8))): draw.randrange(1, 40) for _ in range(900)}
    words |= {"z" * k: k for k in range(40, 60)} | {"q" * 30 + "".join(draw.choice("ab") for _ in range(6)): draw.randrange(1, 9) for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_variants(words)
    for most in (4, 512):
        got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"]) for r in variants(df, most).collect()}
        assert got == want


def corpus():
    draw = random.Random(11)
    base = ["".join(draw.choice("aeinorstéüß") for _ in range(draw.randrange(4, 9))) for _ in range(60)]
    rows = []
    for k in range(300):
        words = []
        for _ in range(draw.randrange(60)):
            w = base[min(draw.randrange(60), draw.randrange(60))]
            if draw.random() < 0.3:
                at = draw.randrange(len(w))
                w = w[:at] + draw.choice(["", "x", w[at].upper() * 2]) + w[at + 1 :]
            words.append(w + draw.choice([" ", ",", "7", "-", " Ñandú ", " × "]))
        rows.append((k % 250 if k % 50 else None, "".join(words)))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    for typo in (97, 3):
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_groups(samples.documents(spark, rows), typo=typo, most=8).collect()}
        assert got == brute(rows, typo)


def test_chains_reach_their_last_form(spark):
    chain = ["aaaaaa" + "b" * k for k in range(9)]
    rows = [(k, " ".join([w] * (3 << k))) for k, w in enumerate(chain)]
    got = {r["word"]: r for r in spelling_groups(samples.documents(spark, rows), typo=10**9 + 7).collect()}
    assert all(got[w]["root"] == chain[-1] for w in chain) and got[chain[0]]["form"] == chain[1]
    assert got[chain[-1]]["form"] is None


def test_odd_rows(spark):
    rows = samples.odd_rows() + [(20 + k, "x" * 50_000 + " " + "x" * 49_999 + " " + "x" * 50_000) for k in range(3)]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_groups(samples.documents(spark, rows)).collect()}
    assert got == brute(rows)
    assert spelling_groups(samples.documents(spark, [])).count() == 0
