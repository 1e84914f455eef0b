"""Finding every window of symbols that occurs more than once in a corpus.

Shared by the two substring operators, whose symbols are bytes and words. A
window is ``width`` consecutive symbols of one document. Each window is
represented by its anchor, the run of ``gram`` symbols inside it with the lowest
hash (leftmost among equals). Equal windows have equal anchors at equal places,
so only texts around anchors that occur twice need to be compared.

1. Documents are packed in chunks of a few MB (compressed, written once).
2. Every chunk sends the distinct anchors it holds, 4 bytes each, to buckets by
   hash; a bucket answers which of them occur twice. An anchor counts once per
   chunk, however many documents hold it, so common passages are summed up
   before they meet. A chance equality of the short hashes costs comparisons only.
3. Every chunk sends the segments (an anchor with all windows it stands for)
   around those anchors, distinct per chunk, to buckets. There ``solve`` compares
   the texts themselves and answers, per segment, which windows repeat.
4. Every chunk covers its documents by the answers.

Buckets and chunks grow in number with the corpus, not in size. All steps are
Spark groupings; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, mix, settle

#: Bytes of text in a chunk, and bytes of text per bucket.
CHUNK, PER_BUCKET, LEAST_BUCKETS = 4 << 20, 6 << 20, 48
#: Id that stands for null: larger than every real one.
NO_ID = np.iinfo(np.int64).max
#: Bound that lies below every id: such a window is covered whatever the document.
ALWAYS = np.iinfo(np.int64).min


def pack(*arrays: np.ndarray | bytes) -> bytes:
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw), 1)


def unpack(blob: bytes, *types) -> list:
    """The parts of a packed blob; type ``bytes`` keeps a part as it is."""
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types))
    out, at = [], 8 * len(types)
    for size, kind in zip(sizes.tolist(), types, strict=True):
        part = raw[at : at + size]
        out.append(part if kind is bytes else np.frombuffer(part, kind))
        at += size
    return out


def _chunk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, n, ids, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

    def row() -> pa.RecordBatch:
        blob = pack(np.array(ids, np.int64), np.array([len(h) for h in held], np.int64), b"".join(held))
        return pa.RecordBatch.from_arrays(
            [pa.array([first + n]), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "size", "blob"]
        )

    for batch in batches(it):
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            if held and size + len(data) > CHUNK:
                yield row()
                n, ids, held, size = n + 1, [], [], 0
            ids.append(NO_ID if i is None else i)
            held.append(data)
            size += len(data)
    if held:
        yield row()


def documents(blob: bytes) -> Iterator[tuple[int, bytes]]:
    ids, sizes, data = unpack(blob, np.int64, np.int64, bytes)
    at = 0
    for i, n in zip(ids.tolist(), sizes.tolist(), strict=True):
        yield i, data[at : at + n]
        at += n


def sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """Least key of every run of ``w`` keys, from running minima of blocks in both directions."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


_FACTOR = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2^64, at least ``n`` of each."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        up, down = (
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, f, np.uint64), dtype=np.uint64)])
            for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))
        )
        _POWERS[0] = (up, down)
    return _POWERS[0]


class Hashed:
    """Prefix polynomial hashes of a sequence, modulo 2^64.

    The prefix sums weigh symbol j by factor^-j, which an odd factor has;
    multiplying a difference by factor^start makes hashes of equal sequences
    equal wherever they start.
    """

    def __init__(self, codes: np.ndarray):
        up, down = powers(len(codes) + 1)
        self.up = up[: len(codes) + 1]
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], dtype=np.uint64, out=self.prefix[1:])

    def of(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of the ``n`` symbols from ``at``."""
        return mix((self.prefix[at + n] - self.prefix[at]) * self.up[at])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of ``k`` symbols."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * self.up[:n])


@dataclass
class Kind:
    """What the symbols are.

    ``read`` splits a document into symbols, ``codes`` numbers them (64 bits),
    ``cut`` gives the text of symbols a to b. ``by_document`` says whether
    segments carry the least id they occur in, or how often they occur.
    """

    width: int
    gram: int
    read: Callable[[bytes], object]
    codes: Callable[[object], np.ndarray]
    cut: Callable[[object, int, int], bytes]
    by_document: bool

    def anchors(self, symbols, whole: bool) -> list[np.ndarray]:
        """Hash and place of each anchor, its first window, number of windows, and (if ``whole``) hash of its segment."""
        n = len(symbols) - self.width + 1
        if n <= 0:
            return [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64)]
        text = Hashed(self.codes(symbols))
        g = text.grams(self.gram)
        low = np.uint64(0xFFFFFFFF)
        at = (sliding_least((g & ~low) | np.arange(len(g), dtype=np.uint64), self.width - self.gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n_windows = np.diff(np.append(first, n))
        segment = text.of(first, n_windows + self.width - 1) if whole else np.zeros(0, np.uint64)
        return [g[at[first]], at[first], first, n_windows, segment]


def keyed(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket in the high and 32 hash bits in the low half. Anchors are minima, so their hashes are mixed anew first."""
    hashes = mix(hashes)
    bucket = ((hashes >> np.uint64(40)) * np.uint64(n_buckets)) >> np.uint64(24)
    return (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _by_bucket(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    buckets = (keys >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(keys) else []
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield int(buckets[a]), int(a), int(b)


def _distinct(kind: Kind, blob: bytes, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor keys of a chunk and how often each occurs in it."""
    found = [kind.anchors(kind.read(data), False)[0] for _, data in documents(blob)]
    return np.unique(keyed(np.concatenate(found), n_buckets), return_counts=True)


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("part", pa.binary())])


def _send(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)


def _repeated(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket: which of its anchors occur twice in the corpus, as bits."""
    parts = [unpack(p, np.uint32, np.uint8) for p in table.column("part").to_pylist()]
    low = np.concatenate([p[0] for p in parts])
    twice = np.concatenate([np.unpackbits(p[1], count=len(p[0])) for p in parts])
    values, back = np.unique(low, return_inverse=True)
    often = np.bincount(back, 1 + twice, len(values)) > 1
    bits, at = [], 0
    for p in parts:
        bits.append(np.packbits(often[back[at : at + len(p[0])]]).tobytes())
        at += len(p[0])
    return pa.table([table.column("bucket"), table.column("chunk"), pa.array(bits, pa.binary())], names=_SENT.names)


class Requests:
    """The distinct segments of a chunk around anchors that repeat, by bucket, and where they lie."""

    def __init__(self, kind: Kind, blob: bytes, n_buckets: int, answers: dict[int, bytes]):
        self.docs = [(i, kind.read(data)) for i, data in documents(blob)]
        found = [kind.anchors(symbols, True) for _, symbols in self.docs]
        key, at, first, windows, text = (np.concatenate(x) for x in zip(*found, strict=True))
        key = keyed(key, n_buckets)
        doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        every, back = np.unique(key, return_inverse=True)
        often = np.zeros(len(every), bool)
        for bucket, a, b in _by_bucket(every):
            often[a:b] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=b - a).astype(bool)
        hit = np.flatnonzero(often[back])
        key, text = key[hit], text[hit]
        #: Per anchor that repeats: its document, first window, and segment.
        self.doc, self.first = doc[hit], first[hit]
        order = np.lexsort((text, key))
        k, t = key[order], text[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])]) if len(k) else np.zeros(0, bool)
        self.segment = np.empty(len(hit), np.int64)
        self.segment[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        one = order[heads]
        ids = np.array([i for i, _ in self.docs], np.int64)[self.doc]
        #: Per segment, ordered by bucket: key, offset of the anchor, windows, least id or number of occurrences, one place.
        self.key, self.offset, self.windows = key[one], (at - first)[hit][one], windows[hit][one]
        self.place = one
        if kind.by_document:
            self.value = np.minimum.reduceat(ids[order], heads) if len(heads) else np.zeros(0, np.int64)
        else:
            self.value = np.diff(np.append(heads, len(order)))

    def parts(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of the segments."""
        return _by_bucket(self.key)

    def contents(self, kind: Kind) -> list[bytes]:
        ends = self.windows + kind.width - 1 + self.first[self.place]
        return [
            kind.cut(self.docs[d][1], a, b)
            for d, a, b in zip(self.doc[self.place].tolist(), self.first[self.place].tolist(), ends.tolist(), strict=True)
        ]


@dataclass
class Segments:
    """All segments of a bucket, chunk by chunk."""

    offset: np.ndarray
    windows: np.ndarray
    value: np.ndarray
    content: list[bytes]


@dataclass
class Runs:
    """Runs of windows of segments: how many each has, then first window, number of windows and bound of all runs.

    A run covers the segment in documents of ids above the bound.
    """

    n: np.ndarray
    first: np.ndarray
    size: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, runs: list[list[tuple[int, int, int]]]) -> Runs:
        flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
        return cls(np.array([len(r) for r in runs], np.int64), flat[:, 0], flat[:, 1], flat[:, 2])

    def take(self, rows: np.ndarray) -> Runs:
        """The runs of the given segments, in that order."""
        n = self.n[rows]
        starts = (np.cumsum(self.n) - self.n)[rows]
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Runs(n, self.first[at], self.size[at], self.bound[at])


def _solved(solve: Callable[[Segments], Runs], table: pa.Table) -> pa.Table:
    offsets, windows, values, content, counts = [], [], [], [], []
    for p in table.column("part").to_pylist():
        o, w, v, sizes, data = unpack(p, np.uint16, np.uint16, np.int64, np.int64, bytes)
        offsets.append(o)
        windows.append(w)
        values.append(v)
        counts.append(len(o))
        at = 0
        for n in sizes.tolist():
            content.append(data[at : at + n])
            at += n
    runs = solve(Segments(*[np.concatenate(x).astype(np.int64) for x in (offsets, windows, values)], content))
    out, at = [], 0
    for n in counts:
        own = runs.take(np.arange(at, at + n))
        out.append(pack(own.n.astype(np.uint8), own.first.astype(np.uint8), own.size.astype(np.uint8), own.bound))
        at += n
    return pa.table([table.column("bucket"), table.column("chunk"), pa.array(out, pa.binary())], names=_SENT.names)


def _covered(kind: Kind, requests: Requests, answers: dict[int, bytes]) -> Iterator[tuple[int, object, list[tuple[int, int]]]]:
    """Id, symbols and covered symbol spans (maximal) of each document of a chunk."""
    own = [unpack(answers[bucket], np.uint8, np.uint8, np.uint8, np.int64) for bucket, _, _ in requests.parts()]
    empty = np.zeros(0, np.int64)
    every = Runs(*[np.concatenate([empty, *(o[i] for o in own)]).astype(np.int64) for i in range(4)])
    runs = every.take(requests.segment)
    doc = np.repeat(requests.doc, runs.n)
    ids = np.array([i for i, _ in requests.docs], np.int64)
    covers = runs.bound < ids[doc]
    start = (np.repeat(requests.first, runs.n) + runs.first)[covers]
    end, doc = start + runs.size[covers] - 1 + kind.width, doc[covers]
    # Windows ascend within a document, so a span ends where the next window starts behind all before it.
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])]) if len(doc) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1 if len(heads) else heads
    spans: list[list[tuple[int, int]]] = [[] for _ in requests.docs]
    for d, a, b in zip(doc[heads].tolist(), start[heads].tolist(), end[tails].tolist(), strict=True):
        spans[d].append((a, b))
    for (i, symbols), found in zip(requests.docs, spans, strict=True):
        yield i, symbols, found


def find_repeats(
    docs: DataFrame, kind: Callable[[], Kind], solve: Callable[[Segments], Runs],
    finish: Callable[[Iterator], pa.Table], schema: str, label: str,
) -> DataFrame:
    """Rows of ``finish`` for the documents' (id, symbols, covered spans)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = settle(base.mapInArrow(_chunk, "chunk long, size long, blob binary"), f"{label}-chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, -(-total // PER_BUCKET))
    sent = "bucket int, chunk long, part binary"

    def anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kind()
        for batch in it:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                keys, n = _distinct(own, blob, n_buckets)
                yield _send(
                    [(k, chunk, pack((keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.packbits(n[a:b] > 1))) for k, a, b in _by_bucket(keys)]
                )

    by_anchor = chunks.select("chunk", "blob").mapInArrow(anchors, sent)
    often = settle(by_anchor.groupBy("bucket").applyInArrow(_repeated, sent), f"{label}-repeated")

    def parts(table: pa.Table) -> dict[int, bytes]:
        return dict(zip(table.column("bucket").to_pylist(), table.column("part").to_pylist(), strict=True))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("blob").to_pylist(), strict=True):
            own = kind()
            r = Requests(own, blob, n_buckets, parts(right))
            content = r.contents(own)
            for bucket, a, b in r.parts():
                part = content[a:b]
                numbers = r.offset[a:b].astype(np.uint16), r.windows[a:b].astype(np.uint16), r.value[a:b].astype(np.int64)
                out.append((bucket, chunk, pack(*numbers, np.array([len(t) for t in part], np.int64), b"".join(part))))
        return pa.Table.from_batches([_send(out)])

    stored = chunks.select("chunk", "blob")
    asked = stored.groupBy("chunk").cogroup(often.groupBy("chunk")).applyInArrow(ask, sent)
    answered = asked.groupBy("bucket").applyInArrow(lambda t: _solved(solve, t), sent)
    both = often.withColumn("found", F.lit(False)).unionByName(answered.withColumn("found", F.lit(True)))

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.column("found")
        first, second = parts(right.filter(pa.compute.invert(found))), parts(right.filter(found))
        out = []
        for blob in left.column("blob").to_pylist():
            own = kind()
            out.append(finish(_covered(own, Requests(own, blob, n_buckets, first), second)))
        return pa.concat_tables(out)

    return stored.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cover, schema)
