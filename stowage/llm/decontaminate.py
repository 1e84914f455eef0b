"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of a bounded size, so what is broadcast is
bounded. A first pass over the documents counts in how many each word n-gram of
the items occurs. An item's seeds are its rarer n-grams, by the item's own
median, so an item that was copied everywhere keeps its seeds. A second pass
aligns an item with the words around its seeds, which tolerates changed, added
and missing words. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, texts

#: Words per seed, and the characters of items handled together.
SEED, BLOCK_CHARS = 3, 8 << 20
#: Items of so many words have seeds of two words as well: with a third of them changed, three may nowhere stand together.
PAIRED = range(12, 25)
#: Seeds occur in at most RARER times as many documents as the item's median n-gram, or in FEW.
RARER, FEW = 4, 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's full score from which a document counts as contaminated.
SCORE = 0.5

_WORD = re.compile(r"\w+")
_OUT = "doc_id long, item_id long, score double, start_word long, end_word long"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def seeds(n: int) -> list[int]:
    """Seed lengths of an item of ``n`` words."""
    return [2, SEED] if n in PAIRED else [min(SEED, n)] if n else []


@dataclass
class Block:
    """Items of one block: word numbers, their word sequences, and n-gram keys with owners."""

    ids: list[int]
    items: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    owners: list[list[int]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        block = cls([r[0] for r in rows])
        sequences = [words(t) for _, t in rows]
        for s in sequences:
            for w in s:
                block.vocabulary.setdefault(w, len(block.vocabulary) + 1)
        block.items = [np.array([block.vocabulary[w] for w in s], np.int64) for s in sequences]
        found: dict[int, set[int]] = {}
        for i, s in enumerate(block.items):
            for width in seeds(len(s)):
                for k in block.grams(s, width).tolist():
                    found.setdefault(k, set()).add(i)
        block.keys = np.array(sorted(found), np.int64)
        block.owners = [sorted(found[k]) for k in block.keys.tolist()]
        return block

    def grams(self, s: np.ndarray, k: int) -> np.ndarray:
        """Keys of all runs of k words; runs with a word unknown to the items get -1."""
        base = len(self.vocabulary) + 1
        n = len(s) - k + 1
        if n <= 0 or k == 0:
            return np.zeros(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(k):
            key = key * base + s[i : i + n]
            known &= s[i : i + n] > 0
        return np.where(known, key, -1)

    def hits(self, s: np.ndarray, k: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``s`` and numbers of the n-grams found there."""
        g = self.grams(s, k)
        i = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        hit = (self.keys[i] == g) & (g >= 0)
        if wanted is not None:
            hit &= wanted[i]
        at = np.flatnonzero(hit)
        return at, i[at]

    def widths(self) -> list[int]:
        """Seed lengths in use; keys of different lengths differ."""
        return sorted({k for s in self.items for k in seeds(len(s))})

    def number(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        found = words(text)
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the end of it in ``region``."""
    steps = np.arange(len(region) + 1) * -GAP
    row, best, end = np.zeros(len(region) + 1, np.int64), 0, 0
    for w in item.tolist():
        t = np.maximum(row + GAP, 0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(region == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(t + steps) - steps
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


def _frequencies(box, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: Block = box.value
    n, widths = np.zeros(len(block.keys), np.int64), block.widths()
    for batch in batches(it):
        for t in texts(batch):
            s = block.number(t)
            for k in widths:
                n[np.unique(block.hits(s, k)[1])] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["seed", "n"])


def _aligned(box, least: float, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, wanted = box.value
    widths = block.widths()
    for batch in batches(it):
        out = []
        for doc_id, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            s = block.number(t)
            places: dict[int, list[int]] = {}
            for k in widths:
                at, seed = block.hits(s, k, wanted)
                for p, g in zip(at.tolist(), seed.tolist(), strict=True):
                    for i in block.owners[g]:
                        places.setdefault(i, []).append(p)
            for i, at in places.items():
                best = _best(block.items[i], s, sorted(at), least)
                if best[0] >= least:
                    out.append((doc_id, block.ids[i], *best))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "start_word", "end_word"]
        )


def _best(item: np.ndarray, s: np.ndarray, at: list[int], least: float) -> tuple[float, int, int]:
    """Best share of the full score over the regions around the seeds, with its words; regions that can't reach ``least`` count 0."""
    n = len(item)
    reach, best = 2 * n, (0.0, 0, 0)
    a = 0
    for b in range(1, len(at) + 1):
        if b < len(at) and at[b] - at[b - 1] <= reach:
            continue
        low, high = max(0, at[a] - reach), min(len(s), at[b - 1] + reach)
        a = b
        # An alignment that reaches it spans at most so many words, of which at least least * n are words of the item.
        span = int((3 - 2 * least) * n) + 1
        shared = np.cumsum(np.isin(s[low:high], item))
        if (shared[span:] - shared[:-span]).max(initial=shared[min(span, len(shared)) - 1]) < least * n:
            continue
        score, end = align(item, s[low:high])
        share = score / (MATCH * n)
        if share > best[0]:
            back, start = align(item[::-1], s[low : low + end][::-1])
            best = (share, low + end - start, low + end)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of documents that hold an item or an edited copy.

    ``score`` is the alignment score over that of the whole item, 1 for an exact
    copy. One row per row of ``docs`` and item that reaches ``least``; its words
    are numbered from 0, end exclusive. Null and empty texts, on either side,
    match nothing; so does an empty table. Items of equal text are all reported,
    and repeated rows each for itself. Only doc_id, text and item_id are read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter(F.trim("text") != "")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n_blocks = -(-total // BLOCK_CHARS)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], _OUT)
    for b in range(n_blocks):
        # An item set of any size comes to the driver one bounded block at a time.
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        rows = sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0))
        block = Block.of(rows)
        if not len(block.keys):
            continue
        sums = base.mapInArrow(partial(_frequencies, spark.sparkContext.broadcast(block)), "seed long, n long")
        df = np.zeros(len(block.keys), np.int64)
        for r in sums.groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():
            df[r["seed"]] = r["n"]
        # Keys of two words are below the square of the vocabulary's size, those of three above it.
        pair = block.keys < (len(block.vocabulary) + 1) ** 2
        own: dict[tuple[int, bool], list[int]] = {}
        for g, owners in enumerate(block.owners):
            for i in owners:
                own.setdefault((i, bool(pair[g])), []).append(g)
        wanted = np.zeros(len(block.keys), bool)
        for mine in own.values():
            wanted[[g for g in mine if df[g] <= max(FEW, RARER * np.median(df[mine]))]] = True
        box = spark.sparkContext.broadcast((block, wanted))
        found = found.union(base.mapInArrow(partial(_aligned, box, least), _OUT))
    return found
