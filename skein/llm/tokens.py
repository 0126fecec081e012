"""Token ids of whole texts, through a bounded cache of white-space chunks.

The tokenizer drops white space and splits at it, so the ids of a text are those
of its chunks, one after the other. Chunks repeat, so most cost one lookup. Texts
within Latin-1 are lower-cased first and their commas and stops set apart, which
leaves their ids as they are and makes more chunks alike. Chunks of Latin letters
that are still missing in a batch are encoded in one call, by the tokenizer's
model without the normalising that such words do not need, and cut apart at the
word-end ids; other chunks are encoded by the tokenizer, and texts with the
control characters that only Python takes for white space are encoded whole.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

import numpy as np

CACHE_ENTRIES = 400_000
_ODD = re.compile("[\x1c-\x1f]")
#: Letters that lower-case one by one and that no normal form changes.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)")


def _byte_letters() -> dict[int, int]:
    """Bytes without a visible Latin-1 letter, to the letters that byte-level vocabularies use for them."""
    hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    return {b: 0x100 + i for i, b in enumerate(hidden)}


_LETTERS = {b: c for b, c in _byte_letters().items() if b != 0x20}

#: A mark after something else than a letter or digit belongs to one token with it.
_JOINED = re.compile(r"[^\w\s][,.]|_[,.]")


def prepared(text: str) -> str:
    """A text with the same ids whose chunks repeat more often."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    if "<|" in text:  # special tokens are told apart by case
        return text
    text = text.lower()
    if _JOINED.search(text):
        return text
    for mark in (",", "."):
        text = text.replace(mark + " ", f" {mark} ").replace(mark + "\n", f" {mark}\n")
    return text


def _spelt(words: str) -> str:
    """Words, apart by spaces, in the letters of a byte-level vocabulary."""
    return words.encode().decode("latin-1").translate(_LETTERS)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of chunks and texts as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str | None = None, entries: int = CACHE_ENTRIES) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.cache: dict[str, bytes] = {}
        self.entries = entries
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, at in vocabulary.items():
            self.ends[at] = token.endswith("</w>")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: set[str]) -> None:
        native, accented, others = [], [], []
        for chunk in missing:
            if not chunk.isalpha():
                others.append(chunk)
            elif chunk.isascii():
                native.append(chunk)
            else:
                (accented if _PLAIN.fullmatch(chunk) else others).append(chunk)
        cache = self.cache
        for i in range(0, len(others), 5000):
            part = others[i : i + 5000]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                cache[chunk] = np.array(found.ids, "<u4").tobytes()
        for words, spell in ((native, str), (accented, _spelt)):
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                ids = np.array(self.words.encode_batch_fast([spell(" ".join(part).lower())], add_special_tokens=False)[0].ids, "<u4")
                cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(cuts) != len(part):
                    raise RuntimeError("the vocabulary does not end every word with an end id")
                packed, last = ids.tobytes(), 0
                for chunk, cut in zip(part, cuts.tolist()):
                    cache[chunk] = packed[last:cut]
                    last = cut

    def chunks(self, texts: list[str]) -> list[list[str]]:
        """White-space chunks of the texts, all of them known to the cache afterwards."""
        split = [prepared(t).split() for t in texts]
        missing = set()
        for chunks in split:
            missing.update(chunks)
        missing = missing.difference(self.cache)
        if len(self.cache) + len(missing) > self.entries:
            self.cache.clear()
            missing = {c for chunks in split for c in chunks}
        if missing:
            self._learn(missing)
        return split

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Cached chunks are looked up, whole texts are covered."""
        split = self.chunks([t if not _ODD.search(t) else "" for t in texts])
        get = self.cache.__getitem__
        return [self._whole(t) if not c and t and _ODD.search(t) else b"".join(map(get, c)) for t, c in zip(texts, split)]


_ENCODERS: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str | None = None):
    """The worker's encoder of a vocabulary. Workers outlive their tasks, so its cache is emptied after each."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    try:
        yield _ENCODERS[key]
    finally:
        _ENCODERS[key].cache = {}
