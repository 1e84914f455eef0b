"""Substring deduplication by words, with repeated-phrase automata.

A window of 35 words is a repeat if its words also start anywhere else, in the
same document or another. Candidates come from ``repeats``. A bucket confirms
the passages that recur by counting their windows word for word, compiles them
into Aho-Corasick automata whose letters are words, in shards of bounded size,
and streams all segments of the bucket through them, which locates every
occurrence. Covered words are removed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.repeats import ALWAYS, NO_ID, Kind, Runs, Segments, find_repeats

WIDTH, GRAM = 35, 12
#: Words of passages compiled into one automaton.
SHARD_WORDS = 1_000_000


def codes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, equal on every worker; most words of a corpus are rare, so none is remembered."""
    return hash_array(np.array(words, object), categorize=False)


def words_kind() -> Kind:
    return Kind(
        WIDTH, GRAM, read=bytes.split, codes=codes,
        cut=lambda w, a, b: b" ".join(w[a:b]), by_document=False,
    )


class Letters(dict):
    """One character per word; surrogates are left out."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        value = self[word] = chr(n if n < 0xD800 else n + 0x800)
        return value


def windows(text: bytes, words: list[bytes]) -> list[bytes]:
    """The windows of a text whose words are joined by single spaces, as slices of it."""
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    return [text[a : b - 1] for a, b in zip(starts, starts[WIDTH:], strict=False)]


def confirmed(segments: Segments) -> dict[bytes, list[tuple[int, int]]]:
    """Per distinct segment: runs of windows (first, number) that occur twice in the bucket, by count of their words."""
    n: Counter[bytes] = Counter()
    for text, v in zip(segments.content, segments.value.tolist(), strict=True):
        n[text] += v
    single = {t: windows(t, t.split(b" ")) for t, k in n.items() if k < 2}
    seen: Counter[bytes] = Counter()
    for held in single.values():
        seen.update(held)
    # Segments that occur twice repeat as a whole; their windows matter to single ones alone.
    twice = {w for w, k in seen.items() if k > 1}
    for t, k in n.items():
        if k >= 2:
            twice.update(seen.keys() & windows(t, t.split(b" ")))
    out: dict[bytes, list[tuple[int, int]]] = {}
    for t, k in n.items():
        if k >= 2:
            out[t] = [(0, t.count(b" ") + 2 - WIDTH)]
            continue
        runs: list[tuple[int, int]] = []
        for i, w in enumerate(single[t]):
            if w in twice:
                if runs and sum(runs[-1]) == i:
                    runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                else:
                    runs.append((i, 1))
        if runs:
            out[t] = runs
    return out


def locate(passages: list[list[bytes]], texts: list[list[bytes]]) -> list[set[int]]:
    """Per text: starts of the windows inside any occurrence of a passage, by automata of bounded size."""
    import ahocorasick

    found: list[set[int]] = [set() for _ in texts]
    at = 0
    while at < len(passages):
        letters, automaton, size = Letters(), ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
        while at < len(passages) and (not size or size + len(passages[at]) <= SHARD_WORDS):
            automaton.add_word("".join([letters[w] for w in passages[at]]), len(passages[at]))
            size += len(passages[at])
            at += 1
        automaton.make_automaton()
        get = letters.get
        for k, w in enumerate(texts):
            # A word no passage holds becomes the letter that stands for none.
            for end, n in automaton.iter("".join(map(get, w, repeat("\0")))):
                found[k].update(range(end - n + 1, end - WIDTH + 2))
    return found


def solve(segments: Segments) -> Runs:
    runs = confirmed(segments)
    passages: dict[bytes, list[bytes]] = {}
    for t, rs in runs.items():
        w = t.split(b" ")
        for first, n in rs:
            p = w[first : first + n - 1 + WIDTH]
            passages.setdefault(b" ".join(p), p)
    distinct = list(dict.fromkeys(segments.content))
    located = locate(list(passages.values()), [t.split(b" ") for t in distinct])
    answer: dict[bytes, list[tuple[int, int, int]]] = {}
    for t, starts in zip(distinct, located, strict=True):
        out: list[list[int]] = []
        for i in sorted(starts):
            if out and out[-1][0] + out[-1][1] == i:
                out[-1][1] += 1
            else:
                out.append([i, 1])
        answer[t] = [(a, n, ALWAYS) for a, n in out]
    return Runs.of([answer[t] for t in segments.content])


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
        ("kept", pa.string()),
    ]
)


def _finish(docs: Iterator) -> pa.Table:
    rows = []
    for i, words, spans in docs:
        keep, at = [], 0
        for a, b in spans:
            keep += words[at:a]
            at = b
        keep += words[at:]
        text = b" ".join(keep).decode("utf-8", "replace")
        rows.append((None if i == NO_ID else i, len(words), [s[0] for s in spans], [s[1] for s in spans], text))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def remove_repeated_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, starts, ends, kept for every row of ``docs``.

    starts and ends are the word spans removed (end exclusive, maximal), kept
    the other words joined by single spaces. Windows are judged on the input.
    Null and empty texts have no words; documents of fewer than 35 words lose
    none. Rows that repeat, ids included, are documents of their own and repeat
    each other. An empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, starts array<bigint>, ends array<bigint>, kept string"
    return find_repeats(docs, words_kind, solve, _finish, schema, "phrases")


def n_removed() -> Column:
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
