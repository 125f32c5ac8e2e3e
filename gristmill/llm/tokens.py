"""Token ids of whole texts, by the tokenizers library, with a cache of words."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

#: A word of letters that no normaliser changes but by case, then ASCII marks that no contraction starts with.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$&#*|)(\]\[\"+=/<>_~^@{}-]*)\Z")
#: White space other than single spaces or line ends inside a text: then spaces are no safe place to cut.
_OTHER = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile(f"[{_OTHER}] ")
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]

_loaded: dict = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


def _is_odd(text: str) -> bool:
    """Searches for single characters are cheap; the pattern is tried only on texts that have one of them."""
    if text[0] == " " or text[-1] == " " or "  " in text or "\n " in text:
        return True
    return any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER)) and _ODD.search(text) is not None


class _Cache(dict):
    """make(key) of each key asked for, kept until there are `most`; then it starts anew."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        found = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = found
        return found


class CachedTokenizer:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids, special strings being ordinary text.

    Both kinds of pre-tokenizer cut before a space that follows a non-space, around a single line end, and between a
    letter and a mark; so the ids of a text are those of its words, in turn. Words, and the letters and marks in them,
    are encoded once and kept, as packed 16-bit ids, in caches of at most `most` entries. Texts with other white space
    than single spaces and line ends are encoded whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 16 bits are assumed")
        self.lower = self.tok.normalizer is not None
        self.table = _byte_letters()
        self.model = self.tok.model
        self.words = _Cache(lambda word: self._word(word, True), most)
        self.letters = _Cache(self._letters, most)
        self.marks = _Cache(self._plain, most)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _letters(self, key: str) -> bytes:
        shown = key if key.isascii() and key.isalpha() else key.encode().decode("latin-1").translate(self.table)
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str, spaced: bool) -> bytes:
        lines = word.split("\n")
        found = list(map(_WORD.match, lines))
        if None in found:
            return self._plain(" " + word if spaced else word)
        out = []
        for k, m in enumerate(found):
            if k:
                out.append(self.marks["\n"])
            letters, marks = m.groups()
            out.append(self.letters[letters.lower() if self.lower else " " + letters if spaced and not k else letters])
            if marks:
                out.append(self.marks[marks])
        return b"".join(out)

    def ids(self, text: str | None) -> np.ndarray:
        """16-bit ids of a whole text; null and empty texts have none."""
        if not text:
            return np.zeros(0, "<u2")
        if _is_odd(text):
            return np.frombuffer(self._plain(text), "<u2")
        first, *rest = text.split(" ")
        return np.frombuffer(self._word(first, False) + b"".join(map(self.words.__getitem__, rest)), "<u2")


def tokenizer(path: str) -> CachedTokenizer:
    """One per worker process and path; workers are reused, and so is the cache."""
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]
