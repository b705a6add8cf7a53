"""BPE encoding and decoding by speculation and verification.

For each word the greedy longest match proposes tokens.  A proposal is right exactly if
every token is one that merging can form and every two neighbours could stand side by side
after merging; a vectorised check tests all neighbours of all words at once.  Only words
that fail it are merged exactly.

The vocabulary file (tokenizers format: byte-level alphabet, word-end suffix) is a parameter.
Null texts count as empty and give no ids; repeated rows are encoded row by row, extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .chunks import Memo, collect_less, default_path, distinct, plain
from .common import mapped

_FREE = np.int64(1) << 40  # rank of what no merge makes


def _alphabet() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.pattern = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = _alphabet()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[self.vocab[a], self.vocab[b]] = r, self.vocab[a + b]
        self.longest = max(map(len, self.vocab))
        #: The longest token that begins with two given letters.
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            n = len(t) - len(self.end) if self.end and t.endswith(self.end) else len(t)
            if n >= 2:
                self.reach[t[:2]] = max(n, self.reach.get(t[:2], 0))
        self._tables()

    def _tables(self) -> None:
        """How merging forms each token: rank of its last merge and its two halves; whether it forms at all."""
        n = max(self.names) + 1
        self.born = np.full(n, -1, np.int64)  # single symbols are there from the start
        self.left, self.right = np.arange(n), np.arange(n)
        self.formed = np.zeros(n, bool)
        for text, i in self.vocab.items():
            body = text.removesuffix(self.end) if self.end and text != self.end else text
            symbols = list(body)
            if len(body) < len(text) and symbols:
                symbols[-1] += self.end
            try:
                ids = [self.vocab[s] for s in symbols]
            except KeyError:
                continue
            got, last = self._merge(ids)
            if got == [i]:
                self.formed[i] = True
                if last:
                    self.left[i], self.right[i] = last
                    self.born[i] = self.rank[last][0]
        keys = np.array([a * n + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.width = n

    def _merge(self, ids: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """Exact merging: the pair of least rank first, the leftmost of equals; also the last pair merged."""
        n = len(ids)
        if n < 2:
            return list(ids), None
        ids, after, before, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank, last = self.rank, None
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], last = new, False, (a, b)
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := rank.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (p := before[i]) >= 0 and (m := rank.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, m[1], ids[p], new))
        return [x for x, ok in zip(ids, alive, strict=True) if ok], last

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over a word in the byte-level alphabet; None if some part is in no token."""
        vocab, out, at, n = self.vocab, [], 0, len(word)
        whole = vocab.get(word + self.end)
        if whole is not None:
            return [whole]
        reach, end = self.reach, self.end
        while at < n:
            most = reach.get(word[at : at + 2], 1)
            if n - at <= most or n - at == 1:
                got = vocab.get(word[at:] + end)
                if got is not None:
                    out.append(got)
                    break
            for size in range(min(most, n - at - 1), 0, -1):
                got = vocab.get(word[at : at + size])
                if got is not None:
                    break
            else:
                return None
            out.append(got)
            at += size
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when their symbols are merged side by side.

        The two are unmerged again, the one born later first.  At each moment the parts that
        touch must not have been merged before the earlier of the merges already undone:
        the right side's merges give way to an equal rank at the boundary (it lies further
        left), the left side's do not.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), _FREE)
        while len(at):
            key = x * self.width + y
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            clash = (self.pair_key[k] == key) & (self.pair_rank[k] < limit)
            ok[at[clash]] = False
            bx, by = self.born[x], self.born[y]
            go = ~clash & ((bx >= 0) | (by >= 0))
            at, x, y, bx, by = at[go], x[go], y[go], bx[go], by[go]
            first = bx > by
            limit = np.where(first, bx, by + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in the byte-level alphabet."""
        guess = [self.propose(w) for w in words]
        size = np.array([len(g) if g else 0 for g in guess], np.int64)
        flat = np.fromiter((i for g in guess if g for i in g), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(words)), size)
        good = size > 0
        good[owner[~self.formed[flat]]] = False
        if len(flat) > 1:
            same = owner[1:] == owner[:-1]
            pair, where = np.unique(flat[:-1][same] * self.width + flat[1:][same], return_inverse=True)
            bad = ~self.compatible(pair // self.width, pair % self.width)
            good[owner[1:][same][bad[where]]] = False
        for i in np.flatnonzero(~good):
            symbols = list(words[i])
            symbols[-1] += self.end
            guess[i] = self._merge([self.vocab[s] for s in symbols])[0]
        return guess

    def many(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, special tokens in them included."""
        parts: list[list] = [[] for _ in texts]  # special ids, and words
        words: set[str] = set()
        for own, text in zip(parts, texts, strict=True):
            if simple := plain(text):
                own += simple if simple[1] else simple[:1]
                words.update(own)
                continue
            for piece in self.special_cut.split(text) if self.special_cut and "<" in text else (text,):
                if piece in self.special:
                    own.append(self.special[piece])
                    continue
                found = self.pattern.findall(piece.lower() if piece.isascii() else self.normal(piece))
                own += found
                words.update(found)
        known = dict(zip(words, self._raw_words(list(words)), strict=True))
        return [[i for p in own for i in (known[p] if type(p) is str else (p,))] for own in parts]

    def _raw_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words as the pattern finds them."""
        letters = self.letters
        return self.words([w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode("utf-8", "replace")]) for w in words])

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by blanks, unknown ids left out: the file names no decoder."""
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


@lru_cache(2)
def _memo(path: str) -> Memo:
    collect_less()
    c = codec(path)
    return Memo(lambda texts: [(" ".join(map(str, ids)), c.decode(ids)) for ids in c.many(texts)])


def spelled(texts: pa.Array, path: str) -> tuple[list[str], list[str]]:
    """Decimal ids and decoded text of each text, both joined by blanks."""
    words, code, offsets = distinct(texts)
    values = _memo(path).values_of(words)
    ids, decoded = [v[0] for v in values], [v[1] for v in values]
    code, cut = code.tolist(), list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    # An empty chunk, which a blank at either end of a text leaves, has no ids.
    return tuple([" ".join([x for i in code[a:b] if (x := side[i])]) for a, b in cut] for side in (ids, decoded))


def encode(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, digests: bool = False) -> DataFrame:
    """The columns ``keep`` with ids (array<int>) and decoded text; or, with ``digests``, n_tokens, ids_sha256 and decoded_sha256.

    Executors read ``path`` themselves; by default, the public vocabulary of the installed package.
    """
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

    def run(texts: pa.Array) -> list[pa.Array]:
        ids, decoded = spelled(texts, path or default_path())
        if digests:
            return [pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()), pa.array(list(map(sha, ids)), pa.string()), pa.array(list(map(sha, decoded)), pa.string())]
        return [pa.array([np.array(x.split(), np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]

    if digests:
        return mapped(docs, text, list(keep), "long, string, string", ["n_tokens", "ids_sha256", "decoded_sha256"], run, arrow=True)
    return mapped(docs, text, list(keep), "array<int>, string", ["ids", "decoded"], run, arrow=True)
