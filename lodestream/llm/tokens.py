"""Encoding by a public tokenizer file, one distinct word at a time."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator


CHUNK = 1 << 20  # characters of a text that are split into words at once


def _chunks(text: str) -> Iterator[str]:
    """Parts of the text that end at a space or line end, of about CHUNK characters or one longer word."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(" ", at, at + CHUNK), text.rfind("\n", at, at + CHUNK))
        if cut < at:
            cut = min((x for x in (text.find(" ", at), text.find("\n", at)) if x >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class WordEncoder:
    """Ids of whole texts by a lower-casing ``tokenizers`` file whose pre-tokenizer never joins text across white space.

    Such a tokenizer's ids of a text are those of its words one after the other, so each distinct
    word (A-Z lower-cased) goes through the library once and then comes from two generations of a
    bounded cache. A word that ends in a letter and one of ``.,`` is its stem and that sign: the
    pre-tokenizer parts letters from signs. A word of a-z alone is one piece that no normalizer
    changes and goes to the library's model directly, where trial words show this to hold.
    """

    def __init__(self, path: str, cache_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.most = cache_words
        self.model = self.tokenizer.model
        trial = ["a", "word", "thing", "zzyzx", "straightforwardly"]
        self.direct = all([t.id for t in self.model.tokenize(x)] == self.tokenizer.encode(x, add_special_tokens=False).ids for x in trial)
        self.signs = {sign: self._ids(sign) for sign in b".,"}

    def _ids(self, sign: int) -> bytes:
        return array("I", self.tokenizer.encode(chr(sign), add_special_tokens=False).ids).tobytes()

    def _learn(self, units: list[bytes]) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        ends: dict[bytes, bytes] = {}
        missing: dict[bytes, None] = {}
        for unit in {*units}.difference(young):
            found = old.get(unit)
            if found is not None:
                young[unit] = found
            elif len(unit) > 1 and unit[-1] in self.signs and 97 <= unit[-2] <= 122:
                stem = unit[:-1]
                ends[unit] = stem
                if stem not in young:
                    found = old.get(stem)
                    if found is None:
                        missing[stem] = None
                    else:
                        young[stem] = found
            else:
                missing[unit] = None
        tokenize = self.model.tokenize
        learnt = []
        for unit in missing:
            if self.direct and unit.isalpha():
                young[unit] = array("I", [token.id for token in tokenize(unit.decode("ascii"))]).tobytes()
            else:
                learnt.append(unit)
        for i in range(0, len(learnt), 4096):
            part = learnt[i : i + 4096]
            texts = [unit.decode("utf-8", "replace") for unit in part]
            for unit, code in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                young[unit] = array("I", code.ids).tobytes()
        for unit, stem in ends.items():
            young[unit] = young[stem] + self.signs[unit[-1]]

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        out = []
        for chunk in _chunks(text):
            units = chunk.encode("utf-8", "replace").lower().replace(b"\n", b" ").split(b" ")
            try:
                out.append(b"".join(map(self.young.__getitem__, units)))
            except KeyError:
                self._learn(units)
                out.append(b"".join(map(self.young.__getitem__, units)))
        return out[0] if len(out) == 1 else b"".join(out)


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache_words: int = 500_000) -> WordEncoder:
    """One encoder a Python worker."""
    if (path, cache_words) not in _encoders:
        _encoders[path, cache_words] = WordEncoder(path, cache_words)
    return _encoders[path, cache_words]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
