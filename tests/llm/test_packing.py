import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import samples
from hypothesis import given, settings
from hypothesis import strategies as st
from quirelake.llm import packing
from quirelake.llm.tokens import ChunkEncoder
from tokenizers import Tokenizer


def plain_ids(text):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_pieces_and_places(spark):
    rows = samples.odd_rows()
    capacity = 64
    got = packing.pack(samples.documents(spark, rows), capacity=capacity).collect()
    want = []
    for key, text in rows:
        ids = plain_ids(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got), key=repr) == sorted(want, key=repr)
    total = sum(r["length"] for r in got)
    assert check(got, capacity) <= 1.1 * -(-total // capacity)


def test_sequences_round_trip(spark):
    rows = [(k, samples.sentence(k, 5 + 13 * k)) for k in range(30)]
    packed = packing.pack(samples.documents(spark, rows), capacity=128)
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(len(plain_ids(t)) for _, t in rows)
    assert all(len(r["ids"]) <= 128 and r["ids"].count(1) <= len(r["doc_ids"]) for r in whole)


def test_empty(spark):
    assert packing.pack(samples.documents(spark, [])).count() == 0


def test_odd_texts_encode_as_the_tokenizer_does():
    known = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [
        "", " ", "It's we'll DON'T", "á é.", "<|endoftext|> x", "x<|startoftext|>", "a\x1cb", "ÀÉß ÿ×÷", "İstanbul ΑΣ ς", "漢字 123 1a2b", " x y\u0085z",
        "word!!! ...word (a)b --", "ﬁ Ⅳ ²", "a" * 3000, "<|", "İ.", "mañana, café!", "'s 't", "x'S", "_a_", "e" + "́" * 5,
    ]
    draw = random.Random(5)
    pool = "abcXYZéÉßñ .,'!<|>\n\t ́İΣ1²漢_-"
    texts += ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(3000)]
    assert [list(memoryview(b).cast("I")) for b in known.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_long_text_in_stretches(monkeypatch):
    from quirelake.llm import tokens

    import re

    monkeypatch.setattr(tokens, "STRETCH", 50)
    monkeypatch.setattr(tokens, "_STRETCHES", re.compile(r"(?s).{1,50}\S*"))
    known = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = samples.sentence(3, 400) + "  \n " + "y" * 300
    assert [*memoryview(known.encode([text])[0]).cast("I"), 1] == plain_ids(text)


def optimum(lengths, capacity):
    """Least number of sequences, by search over how full each one is."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[k]:
                left = list(rooms)
                left[left.index(room)] -= lengths[k]
                go(k + 1, left)
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_an_optimum(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    packer = packing.Packer(counts, 20)
    packer.reduce()
    left = [n for n, k in packer.left.items() for _ in range(k)]
    assert packer.sequence + optimum(left, 20) == optimum(lengths, 20)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
def test_every_piece_is_placed_once(counts):
    rooms, seen = defaultdict(list), defaultdict(set)
    for p in packing.place(counts, 64):
        for k in range(p.count):
            assert p.first + k not in seen[p.length]
            seen[p.length].add(p.first + k)
            rooms[p.sequence + k].append((p.offset, p.length))
    assert {n: len(s) for n, s in seen.items()} == counts
    check([{"sequence_id": s, "offset": o, "length": n} for s, held in rooms.items() for o, n in held], 64)


def test_few_sequences_for_many_pieces():
    draw = random.Random(2)
    counts = defaultdict(int)
    for _ in range(20000):
        counts[min(4096, 1 + int(draw.lognormvariate(6, 1)))] += 1
    used = max(p.sequence + p.count for p in packing.place(dict(counts)))
    assert used <= 1.001 * sum(n * k for n, k in counts.items()) / 4096 + 1
