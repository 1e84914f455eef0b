"""Packing of token sequences into as few as can be, from the histogram of their lengths.

A configuration says how many pieces of which lengths share a sequence. The
configuration linear program asks for the least sum of configurations that
covers the histogram; it has one column per configuration, so columns are
priced when needed: multiplicative weights fall with what a length has covered
already, and a knapsack by dynamic programming finds the configuration of
greatest weighted length. The configurations that fill a sequence to the last
token are rounded down to whole numbers; the others are dissolved again, and
best fit puts their pieces, and the small ones kept back for this, into what
room there is, else into new sequences.

All this works on the histogram, which has at most one count per length,
however many documents there are: bins of equal content are one entry with a
count. Which piece goes where follows from its rank among the pieces of its
length, and ranks come from counts per task, so no task sees all pieces and
none of a frequent length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.bpe import Codec, packed
from stowage.llm.common import batches, rows, settle, texts


class LibraryCodec(Codec):
    """The encoder with words coded by the tokenizers library's own model, whose merges stand in for tables of our own."""

    remembered = 100_000

    def rank(self, path: str, model: dict) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model

    def word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8")])
        return packed([t.id for t in self.model.tokenize(letters)])


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
_PIECES = pa.schema([(c, pa.int32() if c == "piece" else pa.int64()) for c in (*_COLUMNS, "task", "rank")])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"


def _cut(path: str, size: int, end: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    codec, last, width = library_codec(path), packed([end]), 4 * size
    task, seen = TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches(it):
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            ids = codec.encode(text) + last
            for k in range(0, len(ids), width):
                part = ids[k : k + width]
                length = len(part) // 4
                out.append((doc_id, k // width, k // 4, length, zlib.crc32(part), task, seen[length]))
                seen[length] += 1
        yield rows(_PIECES, zip(*out, strict=True))


def pieces(docs: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """The documents' ids and ``end``, cut where they are longer than ``size``; one row per piece.

    ``task`` and ``rank`` tell which task made the piece and how many of its length that task made before.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_cut, path, size, end), _PIECES_DDL)


#: Lengths a pricing step chooses from, and the share of a sequence below which pieces are kept back for the rounding.
PRICED, SMALL = 64, 16
#: Rounds of covering every length, the same for every input.
ROUNDS = 4

#: Pieces of one kind of sequence, as (length, how many), and how many sequences of this kind there are.
Bins = list[tuple[tuple[tuple[int, int], ...], int]]


def knapsack(size: int, lengths: list[int], most: list[int], values: list[float]) -> dict[int, int]:
    """Which items, by index, and how often (up to ``most``), have the greatest value in ``size``."""
    items = []  # powers of two of each item, so that any number up to its bound can be made
    for i, (length, bound) in enumerate(zip(lengths, most, strict=True)):
        bound, times = min(bound, size // length), 1
        while bound > 0:
            items.append((i, length * min(times, bound), min(times, bound)))
            bound -= times
            times *= 2
    best, taken = np.zeros(size + 1), np.zeros((len(items), size + 1), bool)
    for k, (i, width, times) in enumerate(items):
        with_it, without = best[: size + 1 - width] + values[i] * times, best[width:]
        np.greater(with_it, without, out=taken[k, width:])
        np.maximum(with_it, without, out=without)
    room, chosen = size, defaultdict(int)
    for k in range(len(items) - 1, -1, -1):
        if taken[k, room]:
            i, width, times = items[k]
            chosen[i] += times
            room -= width
    return dict(chosen)


def configurations(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[dict[int, int], float]]:
    """A near-optimal solution of the configuration program: configurations (index of a length: times) and their amounts.

    Every length is covered ``ROUNDS`` times over, and the amounts divided by
    that, so that the weights settle. Each step covers one length for the rest
    of its round, and chooses from lengths drawn by the weights: what is least
    covered comes first.
    """
    covered, amounts = np.zeros(len(lengths)), defaultdict(float)
    chance = np.random.default_rng(0)
    while len(wanted := np.flatnonzero(covered < ROUNDS - 1e-9)):
        draw = covered[wanted] - chance.gumbel(size=len(wanted))
        wanted = np.sort(wanted[np.argsort(draw)[:PRICED]])
        need = counts[wanted] * np.minimum(ROUNDS - covered[wanted], 1)
        values = lengths[wanted] / size * np.exp(covered[wanted].min() - covered[wanted])
        chosen = knapsack(size, lengths[wanted].tolist(), np.ceil(need).astype(np.int64).tolist(), values.tolist())
        at, times = wanted[list(chosen)], np.array(list(chosen.values()))
        enough = need[list(chosen)] / times
        amount = float(enough.min())
        covered[at] += times * amount / counts[at]
        whole = np.round(covered[at])
        covered[at] = np.where(np.abs(covered[at] - whole) < 1e-9, whole, covered[at])
        amounts[tuple(sorted(zip(at.tolist(), times.tolist(), strict=True)))] += amount / ROUNDS
    return [(dict(c), x) for c, x in amounts.items()]


def best_fit(bins: Bins, histogram: dict[int, int], size: int) -> Bins:
    """Put the pieces of a histogram, longest first, where they leave least room, else into new sequences."""
    by_room: dict[int, Bins] = defaultdict(list)
    for content, n in bins:
        by_room[size - sum(length * k for length, k in content)].append((content, n))
    open_ = np.zeros(size + 1, bool)
    open_[list(by_room)] = True
    for length, n in sorted(histogram.items(), reverse=True):
        while n:
            room = length + int(open_[length:].argmax())
            if not open_[room]:
                each = size // length
                for k, times in ((each, n // each), (n % each, 1)):
                    if k and times:
                        by_room[size - k * length].append((((length, k),), times))
                        open_[size - k * length] = True
                break
            content, times = by_room[room].pop()
            if times > n:
                by_room[room].append((content, times - n))
                times = n
            open_[room] = bool(by_room[room])
            if content[-1][0] == length:
                content = (*content[:-1], (length, content[-1][1] + 1))
            else:
                content = (*content, (length, 1))
            by_room[room - length].append((content, times))
            open_[room - length] = True
            n -= times
    return [b for room in sorted(by_room) for b in by_room[room]]


def solve(histogram: dict[int, int], size: int) -> Bins:
    """Kinds of sequences that hold exactly the pieces of the histogram."""
    left = dict(histogram)
    lengths = np.array(sorted(x for x in histogram if SMALL * x >= size), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    bins: Bins = []
    for chosen, amount in configurations(lengths, counts, size):
        content = [(int(lengths[i]), k) for i, k in chosen.items()]
        n = min([int(amount + 1e-6), *(left[x] // k for x, k in content)])
        if n and sum(x * k for x, k in content) == size:
            bins.append((tuple(content), n))
            for x, k in content:
                left[x] -= n * k
    return best_fit(bins, {x: n for x, n in left.items() if n}, size)


class Places:
    """Where the k-th piece of each length goes."""

    def __init__(self, bins: Bins):
        rank, entries, sequence = defaultdict(int), [], 0
        for content, n in bins:
            offset = 0
            for length, k in content:
                entries.append((length, rank[length], k, sequence, offset))
                rank[length] += n * k
                offset += length * k
            sequence += n
        self.table = np.array(sorted(entries), np.int64).reshape(-1, 5).T
        self.first = np.searchsorted(self.table[0], np.arange(int(self.table[0].max(initial=0)) + 2))

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given by length and rank among the pieces of it."""
        _, start, times, sequence, offset = self.table
        at = np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            mine = lengths == length
            lo, hi = self.first[length], self.first[length + 1]
            at[mine] = lo + np.searchsorted(start[lo:hi], ranks[mine], side="right") - 1
        nth = ranks - start[at]
        return sequence[at] + nth // times[at], offset[at] + nth % times[at] * lengths


_PACKED = pa.schema([*list(_PIECES)[: len(_COLUMNS)], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(places: Places, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        rank = batch.column("base").to_numpy() + batch.column("rank").to_numpy()
        found = places.of(batch.column("length").to_numpy(), rank)
        yield rows(_PACKED, [*(batch.column(c) for c in _COLUMNS), *found])


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is the ids of its text, by the vocabulary file ``path``, and
    ``end``; only documents of more than ``size`` ids are cut. Null and empty
    texts are ``end`` alone. Sequences hold at most ``size`` ids, without
    gaps, and are numbered from 0. Repeated rows, repeated ids and null ids are
    packed like any other. An empty table gives no rows. Only doc_id and text
    are read, once.
    """
    cut = settle(pieces(docs, path, size, end), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "task"]).select(*_COLUMNS, "rank", "base")
    places = Places(solve(histogram, size))
    return ranked.mapInArrow(
        partial(_place, places),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
