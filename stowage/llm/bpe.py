"""Byte-pair encoding with a public vocabulary file, and decoding.

A word's symbols form a doubly linked list; a priority queue holds the merges
that its neighbours allow, lowest rank first and leftmost among equals. A merge
makes the queued entries of its symbols stale, and those are skipped when they
come up, so a word of n symbols takes O(n log n) whatever its length. Decoding
concatenates vocabulary strings, with one space between them, because the
vocabulary file names no decoder.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stowage.llm.common import batches, rows, texts

#: Words, and stretches between blanks, remembered per worker and generation, and the longest that is.
CACHED_WORDS, CACHED_LENGTH = 300_000, 48
#: Unicode white space, fixed by the standard.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES, _SEPARATORS = re.compile(f"{_SPACE}+"), re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


#: Bits of a queue entry that hold the place of the pair in its word.
_PLACE = 32
_MASK = (1 << _PLACE) - 1
_AFTER, _BEFORE = [*range(1, 257)], [*range(-1, 255)]
_UNSIGNED = array("I")


class Merges:
    """The ranked merges of a vocabulary, on symbol numbers.

    Symbols are numbered by the vocabulary; symbols that only merges know come after it.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.number = dict(vocab)
        self.spare = top = max(vocab.values(), default=-1) + 1
        for pair in merges:
            for s in (*pair, "".join(pair)):
                if s not in self.number:
                    self.number[s], top = top, top + 1
        self.left = [self.number[a] for a, _ in merges]
        self.right = [self.number[b] for _, b in merges]
        self.whole = [self.number[a + b] for a, b in merges]
        self.unknown = top
        # Rank of a pair: by its left symbol, then its right one; and the other way round.
        self.by_left: list[dict[int, int]] = [{} for _ in range(top + 1)]
        self.by_right: list[dict[int, int]] = [{} for _ in range(top + 1)]
        for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            self.by_left[a].setdefault(b, r)
            self.by_right[b].setdefault(a, r)

    def apply(self, symbols: list[int]) -> list[int]:
        """Apply the merges to the symbols of one word; symbols merged into their left neighbour become -1."""
        n, by_left, by_right = len(symbols), self.by_left, self.by_right
        queue = [
            r << _PLACE | i
            for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
            if (r := by_left[a].get(b)) is not None
        ]
        if not queue:
            return symbols
        heapify(queue)
        left, right, whole = self.left, self.right, self.whole
        after, before = (_AFTER[:n], _BEFORE[:n]) if n <= len(_AFTER) else ([*range(1, n + 1)], [*range(-1, n - 1)])
        symbols.append(-1)  # stands behind the end
        while queue:
            entry = heappop(queue)
            i, r = entry & _MASK, entry >> _PLACE
            j = after[i]
            if symbols[i] != left[r] or symbols[j] != right[r]:
                continue  # stale: one of the two has been merged since
            symbols[i] = merged = whole[r]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := by_left[merged].get(symbols[k])) is not None:
                    heappush(queue, r << _PLACE | i)
            p = before[i]
            if p >= 0 and (r := by_right[merged].get(symbols[p])) is not None:
                heappush(queue, r << _PLACE | p)
        return [s for s in symbols if s >= 0]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if sys.byteorder == "little" and _UNSIGNED.itemsize == 4:
        return array("I", ids).tobytes()
    return np.array(ids, "<u4").tobytes()


class Known(dict):
    """What was coded before, in two generations: a full one becomes the old one, and what is asked for again stays."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file."""

    remembered = CACHED_WORDS

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.letters = byte_letters()
        self.rank(path, model)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.vocab, **self.special}.items()}
        named = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, named)) + ")").split if named else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"[^\s", "[^" + _SPACE[1:-1])
        self.words = regex.compile(pattern).findall
        # The same on lower-case ASCII, where the letters and digits can be named.
        plain = pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9")
        self.ascii_words = re.compile(plain).findall if r"\p" not in plain else self.words
        self.known = Known(self.remembered)

    def rank(self, path: str, model: dict) -> None:
        """Set up what :meth:`word` codes with."""
        self.merges = Merges(self.vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        suffix, number = model["end_of_word_suffix"] or "", self.merges.number
        self.inner = [number.get(c, self.merges.unknown) for c in self.letters]
        self.final = [number.get(c + suffix, self.merges.unknown) for c in self.letters]

    def word(self, word: str) -> bytes:
        """Packed ids of one word."""
        coded = word.encode("utf-8")
        inner = self.inner
        symbols = [inner[b] for b in coded]
        symbols[-1] = self.final[coded[-1]]
        spare = self.merges.spare
        return packed([s for s in self.merges.apply(symbols) if s < spare])

    def part(self, part: str) -> bytes:
        """The same of a stretch without blanks; a word taken by itself is one word again."""
        found = self.known.old.get(part)
        if found is None:
            words = [part] if part.isalpha() else (self.ascii_words if part.isascii() else self.words)(part)
            if len(words) == 1:
                found = self.word(words[0])
            else:
                known, inner = self.known.get, self.part
                found = b"".join([k if (k := known(w)) is not None else inner(w) for w in words])
        return self.known.keep(part, found) if len(part) <= CACHED_LENGTH else found

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings joined by spaces."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # Each character is lower-cased for itself, so no final sigma arises. No word holds white space, so stretches
        # between blanks are coded for themselves; str.split also splits at four separators that are none here.
        text = text.lower()
        stretches = list(filter(None, _SPACES.split(text))) if _SEPARATORS.search(text) else text.split()
        known, part = self.known.get, self.part
        return b"".join([k if (k := known(s)) is not None else part(s) for s in stretches])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.split(text) if self.split else [text]
        return b"".join([packed([self.special[x]]) if k % 2 else self.plain(x) for k, x in enumerate(pieces) if x])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _code(path: str, with_decoded: bool, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches(it):
        ids = [c.encode(t) for t in texts(batch)]
        decoded = [c.decode(np.frombuffer(i, "<u4").tolist()) if with_decoded else None for i in ids]
        yield rows(_CODED, [batch.column("doc_id"), [len(i) // 4 for i in ids], ids, decoded])


def encode(docs: DataFrame, path: str, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian 32-bit), decoded.

    ``path`` names the vocabulary file, which every worker must be able to
    open. One row per row of ``docs``; null and empty texts have no tokens.
    Repeated rows are encoded again. Only doc_id and text are read.
    """
    return docs.select("doc_id", "text").mapInArrow(
        partial(_code, path, with_decoded), "doc_id long, n_tokens long, ids binary, decoded string"
    )


def _decode(path: str, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])
    for batch in batches(it):
        packed = [b or b"" for b in batch.column("ids").to_pylist()]
        yield rows(schema, [batch.column("doc_id"), [c.decode(np.frombuffer(b, "<u4").tolist()) for b in packed]])


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded: the text of packed ``ids``; null ids give the empty text."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decode, path), "doc_id long, decoded string")
