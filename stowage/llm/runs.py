"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of consecutive words of smallest period q, at least
``max(6, 4 q)`` words long, that no neighbouring word extends. Re-Pair replaces
the most frequent pair of symbols by a new symbol until no pair is left twice.
The least node of the derivation that holds a run has its two children's
boundary inside the run, so runs are looked for across each symbol's boundary
once, in one of its places, and then translated to all places where the symbol
stands in the derivation. What the grammar leaves is joined by a balanced tree,
whose nodes have one place each. Of the intervals of one period, those that
overlap by a period or more are parts of one run and are merged.

Within a run each pair of neighbouring words occurs three times or more, so the
text is first cut between words whose pair occurs less often in the stretch;
no run crosses such a cut, and Re-Pair would replace no pair across one that
occurs once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, rows, texts

#: The least length of a run, in words and in periods.
LEAST, PERIODS = 6, 4


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repetitive(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [start, end) outside which, and across whose ends, there can be no run."""
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    at = np.arange(len(pairs))
    while len(at):
        # Stretches of pairs that follow each other; in one, a run's pairs occur PERIODS - 1 times or more.
        stretch = np.cumsum(np.concatenate(([0], np.diff(at) != 1)))
        long = np.bincount(stretch)[stretch] >= LEAST - 1
        _, which, count = np.unique(stretch * len(ids) + pairs[at], return_inverse=True, return_counts=True)
        live = long & (count[which] >= PERIODS - 1)
        if live.all():
            ends = np.flatnonzero(np.concatenate((np.diff(at) != 1, [True])))
            starts = np.concatenate(([0], ends[:-1] + 1))
            return list(zip(at[starts].tolist(), (at[ends] + 2).tolist(), strict=True))
        at = at[live]
    return []


class Grammar:
    """Re-Pair over stretches of a sequence: the places of every nonterminal, and what is left of each stretch.

    ``rules`` holds, per nonterminal, the place of its first derivation, its boundary, its end and all its places.
    """

    def __init__(self, ids: np.ndarray, stretches: list[tuple[int, int]]):
        self.rules: list[tuple[int, int, int, list[int]]] = []
        symbols, after, before, where = {}, {}, {}, {}
        for s, e in stretches:
            part = ids[s:e].tolist()
            symbols.update(zip(range(s, e), part, strict=True))
            after.update(zip(range(s, e - 1), range(s + 1, e), strict=True))
            before.update(zip(range(s + 1, e), range(s, e - 1), strict=True))
            for i, pair in enumerate(zip(part, part[1:], strict=False), s):
                where.setdefault(pair, []).append(i)
        width = {}  # words of a nonterminal; words have one
        name = int(ids.max()) + 1
        # Pairs by falling count; among equals, the pair that came up first, which keeps the derivation balanced.
        queue = [(-len(places), k, pair) for k, (pair, places) in enumerate(where.items()) if len(places) > 1]
        heapify(queue)
        born = len(where)
        while queue:
            count, k, pair = heappop(queue)
            a, b = pair
            places, last = [], -1
            for i in where[pair]:
                j = after.get(i)
                if symbols.get(i) == a and j is not None and symbols[j] == b and i != last:
                    places.append(i)
                    last = j
            if 1 < len(places) < -count:
                if a != b:  # of equal symbols, places that overlapped may count later
                    where[pair] = places
                heappush(queue, (-len(places), k, pair))
                continue
            del where[pair]
            if len(places) < 2:
                continue
            new, left, first, fresh = name, width.get(a, 1), places[0], []
            name += 1
            width[new] = left + width.get(b, 1)
            self.rules.append((first, first + left, first + width[new], places))
            for i in places:
                j = after.pop(i)
                symbols[i] = new
                del symbols[j]
                del before[j]
                n = after.pop(j, None)
                if n is not None:
                    after[i], before[n] = n, i
                    pair = (new, symbols[n])
                    if pair not in where:
                        where[pair] = []
                        fresh.append(pair)
                    where[pair].append(i)
                p = before.get(i)
                if p is not None:
                    pair = (symbols[p], new)
                    if pair not in where:
                        where[pair] = []
                        fresh.append(pair)
                    where[pair].append(p)
            for pair in fresh:
                if len(where[pair]) > 1:
                    heappush(queue, (-len(where[pair]), born, pair))
                    born += 1
                else:
                    del where[pair]
        self.left: list[list[int]] = []
        for s, e in stretches:
            starts, i = [], s
            while i is not None:
                starts.append(i)
                i = after.get(i)
            self.left.append([*starts, e])


def across(ids: np.ndarray, s: int, b: int, e: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the runs in ``ids[s:e]`` of which two periods lie right before or right after ``b``.

    Every run that holds words on both sides of ``b`` has two periods on one side of it, as it is four long.
    """
    found, most = [], (e - s) // PERIODS
    for right in (True, False):
        # Read from the boundary outwards, a square comes first.
        out, back = (ids[b:e], ids[s:b][::-1]) if right else (ids[s:b][::-1], ids[b:e])
        top = min(most, len(out) // 2)
        if top < 1:
            continue
        q = np.flatnonzero(out[1 : top + 1] == out[0]) + 1
        if len(q):
            q = q[(out[2 * q - 1] == out[q - 1]) & (out[q + q // 2] == out[q // 2])]
        while len(q):
            period = int(q[0])
            if not np.array_equal(out[:period], out[period : 2 * period]):
                q = q[1:]
                continue
            reach = _agree(out[period:], out)
            behind = _agree(back, np.concatenate((out[period - 1 :: -1], back)) if period <= len(out) else back)
            stop = reach + period
            if behind + stop >= max(LEAST, PERIODS * period):
                found.append((period, b - behind, b + stop) if right else (period, b - stop, b + behind))
            # Multiples of the period inside what it covers are no smallest periods.
            q = q[(q % period != 0) | (2 * q > stop)]
    return found


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning, compared in growing blocks."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        to = min(n, at + step)
        differ = x[at:to] != y[at:to]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 4
    return n


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    stretches = repetitive(ids) if len(ids) >= LEAST else []
    if not stretches:
        return []
    grammar = Grammar(ids, stretches)
    found: list[tuple[int, int, int]] = []
    for s, b, e, places in grammar.rules:
        if e - s >= LEAST:
            runs = across(ids, s, b, e)
            found += [(q, i + p - s, j + p - s) for q, i, j in runs for p in places]
    for starts in grammar.left:
        nodes = [(0, len(starts) - 1)]
        while nodes:
            x, y = nodes.pop()
            if y - x > 1 and starts[y] - starts[x] >= LEAST:
                m = (x + y) // 2
                found += across(ids, starts[x], starts[m], starts[y])
                nodes += [(x, m), (m, y)]
    merged: list[list[int]] = []
    for q, i, j in sorted(set(found)):
        if merged and merged[-1][0] == q and merged[-1][2] - i >= q:
            merged[-1][2] = max(merged[-1][2], j)
        else:
            merged.append([q, i, j])
    return sorted((i, j - i, q) for q, i, j in merged)


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which word stands at each place once a loop is planted; None where the document gets none.

    With h = crc32 of the decimal id, one in ten documents gets one: from word ``a`` on it repeats ``p`` words.
    """
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


_RUNS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("starts", "lengths", "periods")]
    + [("collapsed", pa.string())]
)


def _scan(plant: bool, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            words = text.encode("utf-8").split()
            ids = numbered(words)
            if plant and (order := planted(len(words), doc_id)) is not None:
                words, ids = [words[i] for i in order.tolist()], ids[order]
            runs = find_runs(ids)
            if runs:
                cover = np.zeros(len(words) + 1, np.int64)
                for start, length, period in runs:
                    cover[start + period] += 1
                    cover[start + length] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            starts, lengths, periods = zip(*runs, strict=True) if runs else ((), (), ())
            out.append((doc_id, len(ids), starts, lengths, periods, b" ".join(words).decode("utf-8")))
        yield rows(_RUNS, zip(*out, strict=True))


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_words, starts, lengths, periods (of all runs, by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``collapsed`` holds those that no run
    contains after its first period, joined by one space. ``plant`` repeats
    words in a tenth of the documents first (``planted``). One row per row of
    ``docs``, each judged by its own text; null and empty texts have no words
    and no runs, a null id is kept and gets no planted loop. Only doc_id and
    text are read. One document is held in one task.
    """
    schema = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_scan, plant), schema)


def strongest() -> Column:
    """Struct start, length, period, exponent_milli of the run of greatest length / period; ties: least start, then period."""
    runs = F.transform(
        F.arrays_zip("starts", "lengths", "periods"),
        lambda r: F.struct(
            r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period"),
            F.floor(F.lit(1000) * r["lengths"] / r["periods"]).alias("exponent_milli"),
        ),
    )
    # Runs come by start, then period, so the first of the greatest stays; fractions are compared as whole numbers.
    return F.aggregate(
        runs, F.get(runs, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def listed() -> Column:
    """One line ``start,length,period`` per run."""
    each = F.transform(
        F.arrays_zip("starts", "lengths", "periods"),
        lambda r: F.concat_ws(",", r["starts"].cast("string"), r["lengths"].cast("string"), r["periods"].cast("string")),
    )
    return F.array_join(F.transform(each, lambda line: F.concat(line, F.lit("\n"))), "")
