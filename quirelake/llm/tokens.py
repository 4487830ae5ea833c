"""Token ids of whole texts by a vocabulary file of a public tokenizer."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

from tokenizers import Tokenizer

from quirelake.llm.remembered import LONGEST, Remembered

#: Texts are encoded in stretches of about this many characters.
STRETCH = 1 << 20
#: Chunks a worker remembers in each of two generations.
REMEMBERED = 1 << 17
#: Latin letters whose lower case is one letter, then ASCII marks but the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_STRETCHES = re.compile(rf"(?s).{{1,{STRETCH}}}\S*")
#: Not white space to the tokenizer, but to ``str.split``; and the start of a special token.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


class ChunkEncoder(Remembered):
    """Encodes by chunks between white space and remembers them: chunk to packed ids.

    For vocabularies that drop white space and never join across it: a text's ids are
    those of its chunks. A run of letters and the marks behind it are one pretoken
    each, so they are encoded apart, letters by the model itself. Texts with special
    tokens or odd separators are encoded whole.
    """

    limit = REMEMBERED

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks: dict[str, bytes] = {}
        #: How the tokenizer spells each letter's bytes to its model.
        spelt = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = str.maketrans({letter: spelt(letter)[0][0] for letter in _LETTERS})

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def fresh(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain:
            letters, marks = plain.groups()
            found = array("I", [t.id for t in self.model.tokenize(letters.lower().translate(self.spelling))]).tobytes()
            if marks:
                found += self._marks(marks)
        else:
            (found,) = self._whole([chunk])
        return found

    def _marks(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            (found,) = self._whole([marks])
            if len(self.marks) >= self.limit:
                self.marks.clear()
            if len(marks) <= LONGEST:
                self.marks[marks] = found
        return found

    def _stretch(self, texts: list[str]) -> list[bytes]:
        return [b"".join([self[chunk] for chunk in text.split()]) for text in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            if any(odd in text for odd in _ODD):
                out += self._stretch(group)
                out += self._whole([text])
                group, size = [], 0
            elif len(text) > STRETCH:
                out += self._stretch(group)
                out.append(b"".join(self._stretch([part])[0] for part in _STRETCHES.findall(text)))
                group, size = [], 0
            else:
                group.append(text)
                size += len(text)
                if size > STRETCH:
                    out += self._stretch(group)
                    group, size = [], 0
        return out + self._stretch(group)


@cache
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder; ``path`` is a file, or the name of a file of the public set."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return ChunkEncoder(path)
