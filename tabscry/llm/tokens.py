"""Token ids of whole texts, through the tokenizers library, with a bounded cache of pre-tokens.

Pre-tokens are encoded independently of each other, so a pre-token seen before need not be encoded again. Only texts
of plain Latin characters, on which the pre-tokenizer's pattern is matched here, take that way; all others are
encoded whole by the library.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

CACHE_ENTRIES = 400_000
JOINED_WORDS = 256
# Characters on which the library's pattern and normaliser need no Unicode tables: ASCII without controls, and
# the letters of Latin-1.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# The split patterns of the two public tokenizer files, for plain characters.
BYTE_LEVEL = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s{LETTERS}0-9]+")


class CachedEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        split = str(self.tokenizer.pre_tokenizer)
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        if self.lower and "Split" in split:
            self.split = WORD_LEVEL.findall
        elif str(self.tokenizer.normalizer) == "None" and split.startswith("ByteLevel") and "use_regex=True" in split:
            self.split = BYTE_LEVEL.findall
        else:
            self.split = None  # another kind of tokenizer: no cache
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens. Words are encoded many at a time: set side by side they are split as they were."""
        is_word = lambda p: p[-1].isalpha() and (p[0] != "'" if self.lower else p[0] == " ")
        words, rest = [p for p in new if is_word(p)], [p for p in new if not is_word(p)]
        out = dict(zip(rest, self._direct(rest), strict=True))
        chunks = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        glue = " " if self.lower else ""
        for chunk, e in zip(chunks, self.tokenizer.encode_batch([glue.join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4").tobytes()
            cuts = np.append(np.flatnonzero(np.diff(np.array(e.word_ids), prepend=-1)), len(ids) // 4) * 4
            if len(cuts) != len(chunk) + 1:
                raise ValueError("the tokenizer splits joined words in another way")
            out.update((w, ids[a:b]) for w, a, b in zip(chunk, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; null is an empty text."""
        texts = [t or "" for t in texts]
        cached = [self.split is not None and bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        parts = [self.split(t.lower() if self.lower else t) if c else None for t, c in zip(texts, cached, strict=True)]
        cache = self.cache
        new = list({p for ps in parts if ps for p in ps if p not in cache})
        extra = self._parts(new)
        room = CACHE_ENTRIES - len(cache)
        if len(extra) <= room:
            cache.update(extra)
            extra = None
        whole = iter(self._direct([t for t, c in zip(texts, cached, strict=True) if not c]))
        out = []
        for ps in parts:
            if ps is None:
                out.append(next(whole))
            elif extra is None:
                out.append(b"".join(map(cache.__getitem__, ps)))
            else:
                out.append(b"".join([cache.get(p) or extra.get(p, b"") for p in ps]))
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder per file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]
