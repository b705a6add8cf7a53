"""Splitting text into white-space chunks that a word-end BPE file treats one by one."""

from __future__ import annotations

import gc
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII separators that str.split() takes for white space and the vocabulary's patterns do not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
DEFAULT_FILE = "word_bpe_49k.json"


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_FILE)


def chunks(text: str) -> list[str]:
    """The pieces between white space.

    Normalisation, special tokens and word patterns of such a file never reach across white
    space, so a text's ids are those of its chunks, one after the other.  The four characters
    that only Python counts as white space stay within their chunk.
    """
    if not any(c in text for c in _ODD):
        return text.split()
    return _UNSPACED.findall(text)


#: Runs without white space, where that is what str.split() takes for it but for ``_ODD``.
_UNSPACED = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


TAIL = ".,;:!?"


def plain(chunk: str) -> tuple[str, str] | None:
    """A chunk's lower-cased word and the marks after it, if it has no other parts.

    Letters below U+0250 need no normalisation and are one word of the vocabulary's pattern,
    as the marks are; everything else is left to the general way.
    """
    low = chunk.lower()
    word = low.rstrip(TAIL)
    if word.isalpha() and max(word) < "\u0250":
        return word, low[len(word) :]
    return None


def collect_less() -> None:
    """Makes Python look for garbage cycles rarely: memos are large and have none."""
    gc.set_threshold(200_000, 50, 100)


class Memo(dict):
    """What chunks were turned into, in two generations of at most ``most`` entries, so memory is bounded.

    When the young one is full it becomes the old one; what is used again moves back.
    """

    def __init__(self, many: callable, most: int = 120_000):
        super().__init__()
        self.many, self.most, self.old = many, most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def fill(self, keys: set) -> None:
        """Makes the values of ``keys`` available."""
        old = self.old
        new = []
        for k in keys:
            v = old.get(k)
            if v is None:
                new.append(k)
            else:
                self[k] = v
        if new:
            self.update(zip(new, self.many(new), strict=True))

    def values_of(self, keys: list[str]) -> list:
        """The values of chunks."""
        self.turn()
        out = list(map(self.get, keys))
        if None in out:
            self.fill({k for k, v in zip(keys, out, strict=True) if v is None})
            out = list(map(self.__getitem__, keys))
        return out


def distinct(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, index of each chunk of the texts, offsets of the texts in it); nulls are empty.

    Arrow splits the texts and finds the distinct chunks.  Of Latin-1 texts, lower case and marks
    after a word set apart change no id and leave fewer of them.
    """
    texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # white space only to Arrow and Python
        cut = [chunks(t) for t in texts.to_pylist()]
        seen: dict[str, int] = {}
        code = np.array([seen.setdefault(c, len(seen)) for cs in cut for c in cs], np.int32)
        return list(seen), code, np.concatenate([[0], np.cumsum([len(cs) for cs in cut])]).astype(np.int64)
    plain_ = pc.invert(pc.match_substring_regex(texts, r"[^\x00-\xff]"))
    low = pc.replace_substring_regex(pc.utf8_lower(texts), r"(\pL)([.,;:!?]+)(\s|$)", r"\1 \2\3")
    lists = pc.utf8_split_whitespace(pc.if_else(plain_, low, texts))
    words = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    if not len(words):
        return [], np.zeros(0, np.int32), offsets
    words = words.dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), offsets
