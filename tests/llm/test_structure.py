import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm import bpe, packing, runs, whitening
from stowage.llm.queries import REGISTRY, vocabulary


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_equal_brute_force(blocks):
    w = [x for unit, times in blocks for x in unit * times]
    assert runs.find_runs(np.array(w, np.int64)) == brute_runs(w)


def test_runs_inside_runs_and_long_texts():
    for w in ([0] * 3000, ([0] * 7 + [1]) * 40, ([0, 1] * 5 + [2]) * 9, list(range(300)) * 5, [0, 0, 1] * 50 + [2] * 6 + [0, 0, 1] * 50):
        assert runs.find_runs(np.array(w)) == brute_runs(w)
    assert runs.find_runs(np.array([5] * 200_000)) == [(0, 200_000, 1)]
    assert runs.find_runs(np.array(list(range(40_000)) * 4)) == [(0, 160_000, 40_000)]
    assert runs.find_runs(np.arange(5)) == runs.find_runs(np.array([], np.int64)) == []


def test_a_grammar_derives_its_text():
    rng = random.Random(3)
    w = np.array([rng.randrange(3) for _ in range(400)])
    grammar = runs.Grammar(w, [(0, 150), (150, 400)])
    for s, b, e, places in grammar.rules:
        assert s < b < e and len(places) > 1
        assert all(np.array_equal(w[p : p + e - s], w[s:e]) for p in places)
    assert [starts[0] for starts in grammar.left] == [0, 150] and [starts[-1] for starts in grammar.left] == [150, 400]


def brute_document(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_runs_query_equals_brute_force(spark, corpus, docs, nothing, clashing, monkeypatch):
    from stowage.llm import queries

    fields = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    small = [(i, " ".join((t or "").split(" ")[:400]) if t else t, *rest) for i, t, *rest in corpus]
    monkeypatch.setattr(queries, "read", lambda *_: spark.createDataFrame(small, docs.schema))
    got = REGISTRY["op11_periodic_runs"](spark, "")
    assert got.columns == fields
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_document(i, t) for i, t, *_ in small)
    assert runs.periodic_runs(nothing).count() == 0
    assert Counter(map(repr, runs.periodic_runs(clashing).collect())) == Counter(map(repr, runs.periodic_runs(docs).collect()))
    assert any(brute_document(i, t)[1] for i, t, *_ in small)


def exact_whitening(vectors):
    """n, sums, deviations and covariance as fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    deviations = [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in x]
    centred = [[Fraction(n * v[i] - s[i], n) for i in range(d)] for v in x]
    cov = [[sum(v[i] * v[j] for v in centred) / n for j in range(d)] for i in range(d)]
    return n, s, deviations, centred, np.array([[float(c) for c in row] for row in cov])


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, n string, component int").repartition(3)


@pytest.mark.parametrize("scale", [0.3, 5000.0])
def test_whitening_equals_exact_figures(spark, scale):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(160, 5)) @ rng.normal(size=(5, 5)) * scale).astype(np.float32).tolist()
    good = [(k, v) for k, v in enumerate(base)] + [(3, base[3]), (None, base[5])]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, [1.0]), (905, [])]
    got = whitening.by_component(whitening.whiten(embeddings(spark, good + bad), 3)).collect()
    n, _, deviations, centred, cov = exact_whitening([v for _, v in good])
    assert len(got) == 3 * n and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, x) for (i, _), x in zip(good, deviations, strict=True))
    values, axes = np.linalg.eigh(cov)
    want = np.array([[float(c) for c in v] for v in centred]) @ axes[:, ::-1][:, :3] / np.sqrt(values[::-1][:3])
    rows = {(r.vec_id, r.component): r for r in got}
    for c in range(3):
        mine = np.array([rows[i, c + 1].whitened for i, _ in good])
        assert min(np.abs(mine - want[:, c]).max(), np.abs(mine + want[:, c]).max()) < 1e-8
        assert abs(rows[0, c + 1].explained - values[::-1][c] / np.trace(cov)) < 1e-9
    assert max(r.identity_error for r in got) < 1e-9


def test_covariance_is_exact_far_from_zero():
    # Equal but for the last digit, far from zero: products of the entries themselves would drown the variance.
    rng = np.random.default_rng(5)
    x = 10**15 + rng.integers(0, 4, (300, 3))
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    centre = np.array([v // n for v in s])
    y = x - centre
    squares = {(i, j): int(((y[:, i] + y[:, j] * (i != j)) ** 2).sum()) for i in range(3) for j in range(i, 3)}
    got = whitening.covariance(n, squares, [v % n for v in s])
    assert np.allclose(got, np.cov((x - 10**15).T, bias=True), rtol=1e-12)


def test_sums_in_limbs():
    for v in (0, -1, 1 << 90, -(1 << 120) + 7, 12345678901234567890):
        assert whitening._number(whitening._limbs(v)) == v


def test_whitening_without_variance(spark):
    assert whitening.by_component(whitening.whiten(embeddings(spark, []))).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.by_component(whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in same)
    line = whitening.by_component(whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])]))).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    huge = whitening.by_component(whitening.whiten(embeddings(spark, [(1, [1e16, 0.0]), (2, [-1e16, 1.0]), (3, [1e30, 1.0])]))).collect()
    assert {r.vec_id for r in huge} == {1, 2} and all(r.deviation is None for r in huge)


def packed_rows(spark, table, path=None, **how):
    return packing.pack(table, path or vocabulary(), **how).collect()


def check_packing(rows, size):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("size", [4096, 50])
def test_packing_holds_every_piece(spark, corpus, docs, size):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    rows = packed_rows(spark, docs, size=size)
    want = Counter()
    for i, t, *_ in corpus:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), size):
            want[i, k // size, k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = check_packing(rows, size)
    # At 50, two thirds of the pieces are whole sequences and the others are mostly longer than half: the program itself asks for 675.6.
    assert n <= (676 if size == 50 else math.ceil(sum(r.length for r in rows) / size))


def test_packing_of_nothing_and_of_clashing_names(spark, nothing, docs, clashing):
    assert packed_rows(spark, nothing) == []
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(piece, packed_rows(spark, clashing))) == Counter(map(piece, packed_rows(spark, docs)))


def fewest(lengths, size):
    """The least number of sequences, by trying all ways."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, size - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_kinds_hold_the_histogram_and_are_few(lengths):
    histogram = Counter(lengths)
    bins = packing.solve(dict(histogram), 40)
    held = Counter()
    for content, n in bins:
        assert sum(x * k for x, k in content) <= 40
        for x, k in content:
            held[x] += n * k
    assert held == histogram
    assert sum(n for _, n in bins) <= fewest(lengths, 40) + 1


@pytest.mark.parametrize("lengths, size", [([60, 61, 62], 128), (range(101, 1200), 1200)])
def test_few_and_many_lengths_are_covered_as_often(lengths, size):
    lengths = np.array(lengths)
    solved = packing.configurations(lengths, np.ones(len(lengths), np.int64), size)
    covered = np.zeros(len(lengths))
    for chosen, amount in solved:
        covered[list(chosen)] += np.array(list(chosen.values())) * amount
    assert (covered > 1 - 1e-9).all()
    # With one piece of each length, an amount is a number of rounds: a fourth at least, and less than one round in one.
    amounts = np.array([x for _, x in solved])
    assert np.allclose(amounts * 4 % 1, 0) and amounts.min() < 1


def test_workers_hold_one_set_of_merges():
    codec = packing.library_codec(vocabulary())
    assert not hasattr(codec, "merges") and codec.known.limit < bpe.CACHED_WORDS


def test_many_pieces_of_one_length():
    bins = packing.solve({1: 10**9, 3: 10**8 + 1, 4096: 7, 2049: 10**6, 2047: 10**6}, 4096)
    assert sum(n for _, n in bins) - (10**9 + 3 * (10**8 + 1) + 7 * 4096 + 4096 * 10**6) / 4096 < 3 and len(bins) < 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 3), st.floats(0.1, 5)), min_size=1, max_size=6), st.integers(5, 30))
def test_knapsack_is_best(items, size):
    lengths, most, values = map(list, zip(*items, strict=True))
    chosen = packing.knapsack(size, lengths, most, values)
    assert sum(lengths[i] * k for i, k in chosen.items()) <= size and all(k <= most[i] for i, k in chosen.items())
    best = [0.0] * (size + 1)
    for length, bound, value in items:
        for _ in range(bound):
            for room in range(size, length - 1, -1):
                best[room] = max(best[room], best[room - length] + value)
    assert abs(sum(values[i] * k for i, k in chosen.items()) - best[size]) < 1e-9


def test_a_hot_length_gets_distinct_places(spark):
    docs = spark.range(3000).selectExpr("id % 7 AS doc_id", "IF(id % 3 = 0, '', 'one two three') AS text").repartition(6)
    rows = packed_rows(spark, docs, size=9)
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    check_packing(rows, 9)
