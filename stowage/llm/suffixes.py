"""Substring deduplication by bytes, with hash-compared suffix sorting.

A byte goes if a 50-byte string over it also starts in a document with a
smaller doc_id. Candidates come from ``repeats``. A bucket sorts the suffixes of
its segments that start at their anchors: prefix polynomial hashes and binary
search give the common extension of any two suffixes in a logarithmic number of
steps, a merge sort compares by them, and neighbours' extensions group all
suffixes that share the right part of a window. Hashes of the left part split
those groups into equal windows, and the bytes themselves verify each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.repeats import NO_ID, Hashed, Kind, Runs, Segments, find_repeats

WIDTH, GRAM = 50, 16


def bytes_kind() -> Kind:
    return Kind(
        WIDTH, GRAM, read=lambda data: np.frombuffer(data, np.uint8), codes=lambda x: x,
        cut=lambda x, a, b: x[a:b].tobytes(), by_document=True,
    )


class Suffixes(Hashed):
    """Suffixes of a byte string, compared by their prefix hashes."""

    def __init__(self, data: np.ndarray):
        super().__init__(data)
        self.data = data

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from ``a`` and ``b``, at most ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        from_a, from_b, up_a, up_b = self.prefix[a], self.prefix[b], self.up[a], self.up[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) // 2
            same = (self.prefix[a + mid] - from_a) * up_a == (self.prefix[b + mid] - from_b) * up_b
            low = np.where(same, mid, low)
            high = np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
        """Whether the suffix from ``a`` comes before that from ``b``; a proper prefix comes first."""
        n = self.common(a, b, np.minimum(ends_a - a, ends_b - b))
        a_over, b_over = a + n >= ends_a, b + n >= ends_b
        last = len(self.data) - 1
        byte = self.data[np.minimum(a + n, last)] < self.data[np.minimum(b + n, last)]
        return np.where(a_over, ~b_over, ~b_over & byte)


def merge_sort(text: Suffixes, group: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of the suffixes text[starts:ends] within their groups, groups ascending.

    All merges of a level run together: each element's rank in the other run is
    found by binary search, equal suffixes keep the left run first. Suffixes of
    different groups compare by group, so hashes are read for the others alone.
    """
    n = len(starts)
    order, width = np.argsort(group, kind="stable"), 1

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = group[x] < group[y]
        same = np.flatnonzero(group[x] == group[y])
        x, y = x[same], y[same]
        out[same] = text.less(starts[x], ends[x], starts[y], ends[y])
        return out

    while width < n:
        at = np.arange(n)
        run = at // width
        left = run % 2 == 0
        other = np.where(left, (run + 1) * width, (run - 1) * width)
        low, high = np.minimum(other, n), np.minimum(other + width, n)
        first = low.copy()
        # Runs that meet in different groups are in order as they stand.
        border = np.where(left, np.minimum(other, n - 1), run * width)
        apart = group[order[np.maximum(border - 1, 0)]] != group[order[border]]
        low, high = np.where(apart, np.where(left, first, high), low), np.where(apart & left, first, high)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) // 2
            own, mate, first_run = order[todo], order[mid], left[todo]
            # Less ones of the right run go before a left element, not greater ones of the left run before a right one.
            x, y = np.where(first_run, mate, own), np.where(first_run, own, mate)
            before = np.where(first_run, less(x, y), ~less(x, y))
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        place = run // 2 * 2 * width + (at - run * width) + (low - first)
        nxt = np.empty_like(order)
        nxt[place] = order
        order, width = nxt, 2 * width
    return order


def solve(segments: Segments) -> Runs:
    """Per segment, runs of windows with the smallest id of any document that holds them."""
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(t, len(number)) for t in segments.content), np.int64, len(segments.content))
    texts, n = list(number), len(number)
    least = np.full(n, NO_ID)
    np.minimum.at(least, own, segments.value)
    offset, windows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    offset[own], windows[own] = segments.offset, segments.windows
    bound = np.repeat(least[:, None], WIDTH - GRAM + 1, 1)
    _share(texts, offset, windows, least, bound)
    # A run ends where the bound changes, and where the segment ends.
    inside = np.arange(bound.shape[1]) < windows[:, None]
    starts = inside.copy()
    starts[:, 1:] &= bound[:, 1:] != bound[:, :-1]
    row, first = np.nonzero(starts)
    last = np.append(row[1:] != row[:-1], True)
    size = np.where(last, windows[row], np.append(first[1:], 0)) - first
    return Runs(starts.sum(1), first, size, bound[row, first]).take(own)


def _share(texts: list[bytes], offset: np.ndarray, windows: np.ndarray, least: np.ndarray, bound: np.ndarray) -> None:
    """Lower ``bound`` (segment x window) to the smallest id among equal windows of segments with the same anchor."""
    anchor: dict[bytes, int] = {}
    which = np.fromiter(
        (anchor.setdefault(t[o : o + GRAM], len(anchor)) for t, o in zip(texts, offset.tolist(), strict=True)), np.int64, len(texts)
    )
    some = np.flatnonzero(np.bincount(which, minlength=1)[which] > 1)
    if not len(some):
        return
    data = np.frombuffer(b"".join([texts[i] for i in some.tolist()]), np.uint8)
    sizes = np.array([len(texts[i]) for i in some.tolist()], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes + offset[some]
    text = Suffixes(data)
    order = merge_sort(text, which[some], starts, ends)
    s, e, group, segment = starts[order], ends[order], which[some][order], some[order]
    near = np.zeros(len(order), np.int64)
    near[1:] = text.common(s[:-1], s[1:], np.minimum(e[:-1] - s[:-1], e[1:] - s[1:])) * (group[1:] == group[:-1])
    off, n_windows, ids = offset[segment], windows[segment], least[segment]
    span = np.arange(WIDTH)
    for o in range(WIDTH - GRAM + 1):
        # Windows that begin o bytes before the anchor: the window's number in its segment is off - o.
        k = off - o
        has = np.flatnonzero((k >= 0) & (k < n_windows))
        if len(has) < 2:
            continue
        # Neighbours whose extension reaches the window's end share its right part.
        right = np.cumsum(near < WIDTH - o)[has]
        left = text.of(s[has] - o, np.full(len(has), o, np.int64))
        by = np.lexsort((ids[has], left, right))
        r, l = right[by], left[by]  # noqa: E741
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (l[1:] != l[:-1])])
        head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
        pairs = np.flatnonzero(head != by)
        for part in range(0, len(pairs), 100_000):
            p = pairs[part : part + 100_000]
            a, b = has[by[p]], has[head[p]]
            equal = (data[(s[a] - o)[:, None] + span] == data[(s[b] - o)[:, None] + span]).all(1)
            a, b, apart = a[equal], b[equal], np.unique(head[p[~equal]])
            bound[segment[a], k[a]] = np.minimum(bound[segment[a], k[a]], ids[b])
            for first in apart:
                # Different strings of equal hashes: their group is told apart by its bytes.
                mine = has[by[head == first]]
                same = np.unique(data[(s[mine] - o)[:, None] + span], axis=0, return_inverse=True)[1].ravel()
                least = np.full(same.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, same, ids[mine])
                bound[segment[mine], k[mine]] = np.minimum(bound[segment[mine], k[mine]], least[same])


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
        ("kept", pa.binary()),
    ]
)


def _finish(docs: Iterator) -> pa.Table:
    rows = []
    for i, x, spans in docs:
        parts, at = [], 0
        for a, b in spans:
            parts.append(x[at:a].tobytes())
            at = b
        parts.append(x[at:].tobytes())
        rows.append((None if i == NO_ID else i, len(x), [s[0] for s in spans], [s[1] for s in spans], b"".join(parts)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, starts, ends, kept for every row of ``docs``.

    starts and ends are the maximal byte spans removed (end exclusive), kept the
    other bytes. Strings are judged on the input and never cross documents. Null
    and empty texts have no bytes; texts under 50 bytes lose none. Rows of equal
    ids do not remove from each other; a null id counts as larger than all
    others, and null ids do not remove from each other. An empty table gives an
    empty result.
    """
    schema = "doc_id long, n_bytes long, starts array<bigint>, ends array<bigint>, kept binary"
    return find_repeats(docs, bytes_kind, solve, _finish, schema, "suffixes")


def n_removed() -> Column:
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
