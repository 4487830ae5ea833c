import math
import random
import re
from collections import Counter, defaultdict

import samples
from quirelake.llm.pii import find_personal, sanitise


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def plain(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= sum(c.isdigit() for c in m[0]) <= 19 and luhn(m[0])]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


TEXTS = [
    "a@b.c@d.e x@y", "a@b.cd_x@e.f", "漢字 me.you+tag@mail-1.example.com. 🙂 x@y.z", "@a.b a@.b a@b. a@b..c", "-.%@a.b",
    "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.256 001.002.003.004 1.2.3", "00000000255.1.1.1 .1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 41111111111111111 4111  111111111111 1 2 3",
    "5 4111 1111 1111 1111 x4111111111111111y 4111 1111 1111 1111 2 6304000000000000 000000000000000000", "+1 (386) 555-3733 +12345678 +1234567 ++49 89 123456- 12 +49 (0)89.1234567890123 +1 2", "+1+2345678901 +1.2.3.4.5.6.7.8",
    "a" * 20000 + "@" + "b" * 20000, "1" * 30000, "a@" + "b." * 6000 + "c", "+1" + " " * 20000 + "2", None, "",
]


def fuzz(n=400):
    draw = random.Random(1)
    return ["".join(draw.choice("ab12345.@-+ ()%_🙂é") for _ in range(draw.randrange(80))) for _ in range(n)]


def test_base_spans(spark):
    rows = [*enumerate(TEXTS + fuzz()), *[(k + 1000 if k else None, t) for k, t in samples.odd_rows()], (2, TEXTS[2]), (None, TEXTS[2])]
    got = find_personal(samples.documents(spark, rows)).collect()
    want = sorted(((k, plain(t)) for k, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["base_spans"]) for r in got), key=repr) == want
    for r in got:
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [r["base_spans"].count(f"{k}:") for k in ("email", "ip", "card", "phone")]


def test_revealing_terms(spark):
    """The corpus shows 'wolperting' only beside one address, and 'common' everywhere."""
    secret = [(k, f"common text {samples.sentence(k, 30)} Wolperting wrote from who@mail.example.org common") for k in range(5)]
    clean = [(k, f"common text {samples.sentence(k, 40)}") for k in range(10, 200)]
    got = {r["doc_id"]: r for r in find_personal(samples.documents(spark, secret + clean)).collect()}
    for k, text in secret:
        at = text.index("Wolperting")
        assert f"remove:{at}:{at + 10}" in got[k]["spans"].split(",")
        assert got[k]["base_spans"] == plain(text) and got[k]["spans"].startswith(plain(text))
        assert f":{text.index('common')}:" not in got[k]["spans"]
    assert all(got[k]["spans"] == "" for k, _ in clean)
    out = {r["doc_id"]: r["text"] for r in sanitise(samples.documents(spark, secret + clean)).collect()}
    assert all("Wolperting" not in out[k] and "[EMAIL]" in out[k] and "who@" not in out[k] and out[k].startswith("common text") for k, _ in secret)
    assert all(out[k] == t for k, t in clean)


def test_copies_of_one_text_are_one_witness(spark):
    rows = [*[(k, "unheard word near who@mail.example.org") for k in range(9)], *[(k, samples.sentence(k, 20)) for k in range(20, 60)]]
    assert {r["n_revealing"] for r in find_personal(samples.documents(spark, rows)).collect()} == {0}


def brute_added(rows, support=3, generalise=0.8, remove=0.95):
    """Spans of revealing terms per row, by counting everything."""
    docs = {(k, t or "") for k, t in rows}
    base = {t: [x.split(":") for x in plain(t).split(",") if x] for _, t in docs}
    small = lambda text: {w for w in re.split(r"[^\w]+|_", text.lower()) if len(w) >= 3 and re.search(r"[^\W\d_]", w)}

    def entities(text):
        out = set()
        for kind, a, b in base[text]:
            value = text[int(a) : int(b)].lower()
            digits = re.sub("[^0-9]", "", value)
            part = {"email": "domain:" + value.rpartition("@")[2], "ip": "prefix:" + ".".join(value.split(".")[:2]), "card": "prefix:" + digits[:6], "phone": "prefix:" + digits[:4]}[kind]
            out |= {(kind, value), (kind, part), (kind, "kind:")}
        return out

    def outside(text):
        out = list(text)
        for _, a, b in base[text]:
            out[int(a) : int(b)] = " " * (int(b) - int(a))
        return small("".join(out))

    n, total = Counter(w for _, t in rows for w in small(t or "")), len(rows)
    of, with_term = defaultdict(set), defaultdict(set)
    for k, t in docs:
        for e in entities(t):
            of[e].add((k, t))
            for w in outside(t):
                with_term[e, w].add((k, t))
    action = {}
    for (e, w), held in with_term.items():
        if len({t for _, t in of[e]}) >= support <= len({t for _, t in held}) and len(of[e]) < total:
            share = math.log2(len(held) * total / (len(of[e]) * n[w])) / math.log2(total / len(of[e]))
            if share >= generalise:
                action[e, w] = "remove" if share >= remove else "generalise"
    out = {}
    for k, t in docs:
        mine = {w: max(action[e, w] for e in entities(t) if (e, w) in action) for w in {w for e, w in action if e in entities(t)}}
        spans = [(mine[m[0].lower()], *m.span()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in mine]
        out[k, t] = sorted(s for s in spans if not any(s[1] < int(b) and int(a) < s[2] for _, a, b in base[t]))
    return out


def test_added_spans_against_brute_force(spark):
    draw = random.Random(12)
    words = [f"word{k}" for k in range(300)] + ["Zürich", "the", "and", "of"] * 20
    rows = []
    for k in range(400):
        some = [draw.choice(words) for _ in range(draw.randrange(30))]
        if k % 5 == 0:
            who = draw.randrange(12)
            some[len(some) // 2 : len(some) // 2] = [f"agent{who}", draw.choice([f"a{who}@d{who % 4}.org", f"x{k}@d{who % 4}.org", f"10.{who % 3}.0.{who}", f"+49 30 1234{who:02}7"]), f"desk{who % 4}"]
        rows.append((None if k % 50 == 20 else k, " ".join(some)))
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:60:5])] + rows[:20]
    want = brute_added(rows)
    for r, (k, t) in zip(sorted(find_personal(samples.documents(spark, rows)).collect(), key=lambda r: (repr(r["doc_id"]), r["spans"])), sorted(rows, key=lambda x: (repr(x[0]), ",".join(
            [plain(x[1])] * bool(plain(x[1])) + [f"{a}:{b}:{c}" for a, b, c in want[x]])))):
        added = [x for x in r["spans"].split(",") if x.startswith(("generalise", "remove"))]
        assert (r["doc_id"], added) == (k, [f"{a}:{b}:{c}" for a, b, c in want[k, t]])
    assert sum(map(len, want.values())) > 30


def test_empty(spark):
    assert find_personal(samples.documents(spark, [])).count() == 0


def test_unique_values_disclose_by_their_class(spark):
    """No address repeats, but 'wolperting' stands only beside addresses of one domain."""
    rows = [(k, f"common {samples.sentence(k, 20)} Wolperting who{k}@mail.example.org") for k in range(5)]
    rows += [(k, f"common {samples.sentence(k, 20)} you{k}@other{k}.example.com") for k in range(5, 30)]
    rows += [(k, f"common {samples.sentence(k, 40)}") for k in range(30, 200)]
    got = {r["doc_id"]: r["spans"].split(",") for r in find_personal(samples.documents(spark, rows)).collect()}
    for k, text in rows[:5]:
        at = text.index("Wolperting")
        assert f"remove:{at}:{at + 10}" in got[k]
    assert not any(":0:6" in s for spans in got.values() for s in spans)
