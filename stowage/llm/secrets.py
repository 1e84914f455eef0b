"""Secrets in texts, also below layers of encoding.

Every text is scanned as it is. Then a worklist unwraps what it holds: URL
escapes, Unicode and byte escapes, base64, and gzip, zlib and bzip2 streams.
Each layer is scanned and unwrapped in turn until nothing new appears; layers
already seen at the same place are not taken again, so cycles end. Finds of
inner layers are mapped back to code points of the outer text.

Decoded bytes are read as Latin-1, one character per byte, so no layer is
refused for a byte that is no text, and places stay exact: the patterns and the
encodings below are all ASCII. A base64 run is decoded at all four alignments,
because what stands before it (a path, an id) may be of its alphabet, and runs
go on over line ends. Layers are taken depth first: of an inflated stream one
piece is finished before the next is inflated, so memory holds one piece per
level, however much a stream inflates to.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, texts

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal either way, so asking for 16 at once finds the same matches.
_HEX = re.compile(r"[0-9a-f]{16,}")
_URL = re.compile(r"%([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(
    r"""\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&\#x([0-9A-Fa-f]{1,6});|&\#([0-9]{1,7});|\\([nrt"/\\])"""
)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "/": "/", "\\": "\\"}
#: Shorter runs hold no secret: the shortest, 16 bytes, takes 22 characters.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
SHORTEST = 22
_STREAM = re.compile("\x1f\x8b\x08|BZh[1-9]1AY&SY|x[\x01\x5e\x9c\xda]")
_BYTES = re.compile("[\x00-\xff]*")
#: Characters from which a stream is told from a chance signature.
PROBE = 512
_KEYWORDS = ("passw", "secret", "token", "api")
#: An inflated stream is taken in pieces of this size. The next piece repeats the end of the last: ``OVERLAP``
#: characters, or an encoded run that is not over yet, as long as that has no more than ``CARRY``. Beyond that, a run
#: is decoded in parts, which loses nothing but a compressed stream that is split so.
PIECE, OVERLAP, CARRY = 4 << 20, 64 << 10, 16 << 20
#: Read backwards: what may belong to an encoded run.
_UNFINISHED = re.compile(r"(?:[A-Za-z0-9+/_=%\\{}&#;-]|[ \t]*\n\r?)*")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text and, per character, where it starts and ends in the outer text: arrays, or one place for all."""

    def __init__(self, text: str, low: np.ndarray | int | None = None, high: np.ndarray | int | None = None):
        self.text, self.low, self.high = text, low, high

    def place(self, start: int, end: int) -> tuple[int, int]:
        """Places rise along the text, so the ends of a stretch tell all."""
        if self.low is None:
            return start, end
        if isinstance(self.low, int):
            return self.low, self.high
        return int(self.low[start]), int(self.high[end - 1])

    def part(self, text: str, first: np.ndarray, last: np.ndarray) -> Layer:
        """A layer of which each character comes from the characters first to last, inclusive, of this one."""
        if isinstance(self.low, int):
            return Layer(text, self.low, self.high)
        if self.low is None:
            return Layer(text, first, last + 1)
        return Layer(text, self.low[first], self.high[last])


def _replaced(pattern: re.Pattern, char: Callable[[re.Match], str | None], layer: Layer) -> Iterator[Layer]:
    """The layer with every match replaced by one character; matches without one stay."""
    starts, ends = array("q"), array("q")

    def one(m: re.Match) -> str:
        if (c := char(m)) is None:
            return m[0]
        starts.append(m.start())
        ends.append(m.end())
        return c

    text = pattern.sub(one, layer.text)
    if not starts:
        return
    if isinstance(layer.low, int):
        yield Layer(text, layer.low, layer.high)
        return
    s, e = np.frombuffer(starts, np.int64), np.frombuffer(ends, np.int64)
    inside = np.zeros(len(layer.text) + 1, np.int8)
    inside[s + 1] += 1
    inside[e] -= 1
    first = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
    last = first.copy()
    last[np.searchsorted(first, s)] = e - 1
    yield layer.part(text, first, last)


def _byte(m: re.Match) -> str:
    return chr(int(m[1], 16))


def _escaped(m: re.Match) -> str | None:
    if m.lastindex == 6:
        return _PLAIN[m[6]]
    code = int(m[m.lastindex], 10 if m.lastindex == 5 else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < SHORTEST:
            continue
        run, at = m[0], np.arange(m.start(), m.end())
        if "\n" in run:
            symbol = np.frombuffer(run.encode("ascii"), np.uint8) > ord(" ")
            run, at = "".join(run.split()), at[symbol]
        run = run.replace("-", "+").replace("_", "/")
        for shift in range(4):
            n = len(run) - shift
            n -= n % 4 == 1
            raw = base64.b64decode(run[shift : shift + n] + "=" * (-n % 4))
            byte = np.arange(len(raw))
            yield layer.part(raw.decode("latin-1"), at[shift + byte * 8 // 6], at[shift + (byte * 8 + 7) // 6])


def _pieces(raw: bytes) -> Iterator[bytes | int]:
    """What a compressed stream inflates to, piece by piece, with members that follow at once; last, the bytes read.

    It ends where the data stop being such a stream.
    """
    begun, rest = 0, raw
    while True:
        packed_by_bz2 = rest[:3] == b"BZh"
        stream = bz2.BZ2Decompressor() if packed_by_bz2 else zlib.decompressobj(47)
        pending = rest
        try:
            while not stream.eof:
                data = stream.decompress(pending, PIECE)
                pending = b"" if packed_by_bz2 else stream.unconsumed_tail
                if data:
                    yield data
                elif not pending:
                    break
        except (zlib.error, OSError, EOFError):
            break
        if not stream.eof:
            break
        rest = stream.unused_data
        begun = len(raw) - len(rest)
        if rest[:3] not in (b"\x1f\x8b\x08", b"BZh"):
            break
    yield begun


def _starts(text: str) -> bool:
    """Whether a stream may start here, by its first bytes; spares reading on at each chance signature."""
    head = _BYTES.match(text)[0].encode("latin-1")
    try:
        (bz2.BZ2Decompressor() if head[:3] == b"BZh" else zlib.decompressobj(47)).decompress(head, PIECE)
    except (zlib.error, OSError, EOFError):
        return False
    return True


def _streams(layer: Layer) -> Iterator[Layer]:
    done = 0
    for m in _STREAM.finditer(layer.text):
        if m.start() < done:
            continue  # a later member of a stream that was read
        if not _starts(layer.text[m.start() : m.start() + PROBE]):
            continue
        end = _BYTES.match(layer.text, m.start()).end()
        low, high = layer.place(m.start(), end)
        kept = ""
        for data in _pieces(layer.text[m.start() : end].encode("latin-1")):
            if isinstance(data, int):
                done = m.start() + data
                break
            text = kept + data.decode("latin-1")
            tail = _UNFINISHED.match(text[: -CARRY - 2 : -1]).end()
            kept = text[-max(OVERLAP, tail if tail <= CARRY else 0) :]
            yield Layer(text, low, high)


def _below(layer: Layer) -> Iterator[Layer]:
    """The layers right below one."""
    if "%" in layer.text:
        yield from _replaced(_URL, _byte, layer)
    if "\\" in layer.text or "&#" in layer.text:
        yield from _replaced(_ESCAPE, _escaped, layer)
    yield from _base64(layer)
    yield from _streams(layer)


def unwrap(text: str) -> tuple[list[tuple[int, int, int]], int]:
    """All finds of a text and the layers below it, and the number of layers read."""
    found, seen, n = set(scan(text)), set(), 0
    work = [_below(Layer(text))]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if not new.text:
            continue
        key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *new.place(0, len(new.text)))
        if key in seen:
            continue
        seen.add(key)
        n += 1
        for start, kind, end in scan(new.text):
            a, b = new.place(start, end)
            found.add((a, kind, b))
        work.append(_below(new))
    return sorted(found), n


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("found", pa.list_(_SPAN)), ("n_layers", pa.int64())])


def _find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
    for batch in batches(it):
        base, found, layers = [], [], []
        for t in texts(batch):
            spans, n = unwrap(t)
            base.append(named(scan(t)) if spans else [])
            found.append(named(spans))
            layers.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip((base, found, layers), list(_OUT)[1:], strict=True)]],
            schema=_OUT,
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base, found, n_layers: finds of the text itself, finds of all layers, layers unwrapped.

    Spans count code points of the text, end exclusive, ordered by start and
    kind. ``found`` holds ``base``. Null and empty texts have none. Each row is
    read for itself, so repeated rows give equal rows. There is no shuffle.
    """
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id long, base {span}, found {span}, n_layers long")


def joined(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def counts(spans: str) -> list[Column]:
    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return [of(kind) for kind in KINDS]


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every found span replaced by ``mask``; other columns stay.

    Overlapping spans are replaced once. A null text stays null. No join: the
    texts are rewritten where they are scanned.
    """
    return docs.mapInArrow(partial(_redact, mask), docs.schema)


def _redact(mask: str, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        i = batch.schema.get_field_index("text")
        out = [None if t is None else masked(t, unwrap(t)[0], mask) for t in batch.column(i).to_pylist()]
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])
