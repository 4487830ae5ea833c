from itertools import islice, product
from string import ascii_lowercase

import public_tokenizers
import pytest
from quirelake.llm import quality
from quirelake.llm.tokens import ChunkEncoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("make", [quality._Chunks, lambda: ChunkEncoder(PATH)])
def test_what_a_worker_holds_is_bounded(make):
    """Workers outlive their tasks: neither many different chunks nor long ones pile up."""
    known = make()
    for letters in islice(product(ascii_lowercase, repeat=4), 300_000):
        known["".join(letters)]
    known["x!" * 50_000]
    held = [known, getattr(known, "older", {}), getattr(known, "marks", {})]
    assert sum(map(len, held)) <= 1 << 18
    assert max(len(chunk) for each in held for chunk in each) <= 64


def test_forgotten_chunks_read_as_before(monkeypatch):
    texts = ["Red, red! blue (blue) green " + "v" * n + " " + "w!" * n for n in range(30, 40)] * 3
    whole = Tokenizer.from_file(PATH)
    all_buckets = [quality.tokens(t).tolist() for t in texts]
    for each in (ChunkEncoder, quality._Chunks):
        monkeypatch.setattr(each, "limit", 3, raising=False)
    assert [list(memoryview(b).cast("I")) for b in ChunkEncoder(PATH).encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(quality, "_known", quality._Chunks)
    assert [quality.tokens(t).tolist() for t in texts] == all_buckets
