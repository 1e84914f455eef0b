import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stowage.llm import phrases, setsketch, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, shared=85):
    """Per row (id, size of its set, least id that its row reaches); rows of one id and text are one."""
    known = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = list(range(len(known)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, s) in enumerate(known):
        for j, u in known[:p]:
            q = known.index((j, u))
            if (s and u and 100 * len(s & u) >= shared * len(s | u)) or (i, s) == (j, u):
                root[find(p)] = find(q)
    least = {}
    for p, (i, _) in enumerate(known):
        least[find(p)] = min(i, least.get(find(p), i))
    return Counter((i, len(s), least[find(p)], i == least[find(p)]) for p, (i, s) in enumerate(known))


def test_near_duplicates_equal_brute_force(docs, corpus):
    want = brute_components([(i, t) for i, t, *_ in corpus])
    got = setsketch.near_duplicates(docs).collect()
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_rows_of_one_id_and_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (8, a + " x"), (9, b + " y"), (3, b + " z"), (6, None), (6, "one"), (7, "one"), (5, a)]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def test_cross_pairs_reach_what_leaders_miss(spark, docs, monkeypatch):
    want = {tuple(r) for r in setsketch.near_duplicates(docs).collect()}
    monkeypatch.setattr(setsketch, "_star", lambda members, shared: setsketch._cross(members, shared).limit(0))
    assert {tuple(r) for r in setsketch.near_duplicates(docs).collect()} == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in setsketch.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[400:2400]
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (np.maximum(ra, rb) == setsketch.registers(np.union1d(a, b))).all()
    got = setsketch.likeliest(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([2000.0]), np.array([2000.0]))
    assert abs(got[0] - 1600 / 2400) < 0.15


def brute_words(corpus):
    split = [(i, WORD.findall(t or "")) for i, t, *_ in corpus]
    n = Counter(tuple(w[p : p + 35]) for _, w in split for p in range(len(w) - 34))
    out = Counter()
    for i, w in split:
        gone = set()
        for p in range(len(w) - 34):
            if n[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def brute_bytes(corpus):
    raw = [(i, (t or "").encode(), i if i is not None else 1 << 62) for i, t, *_ in corpus]
    least = defaultdict(lambda: 1 << 63)
    for _, b, k in raw:
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(least[b[p : p + 50]], k)
    out = Counter()
    for i, b, k in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out[i, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)] += 1
    return out


def test_repeated_phrases_equal_brute_force(docs, corpus):
    got = phrases.remove_repeated_phrases(docs).collect()
    total = lambda r: sum(b - a for a, b in zip(r.starts, r.ends, strict=True))
    assert Counter((r.doc_id, r.n_words, total(r), r.kept) for r in got) == brute_words(corpus)


def test_repeated_bytes_equal_brute_force(docs, corpus):
    got = suffixes.remove_repeated_bytes(docs).collect()
    total = lambda r: sum(b - a for a, b in zip(r.starts, r.ends, strict=True))
    assert Counter((r.doc_id, r.n_bytes, total(r), len(r.starts), bytes(r.kept)) for r in got) == brute_bytes(corpus)


def test_passages_found_in_several_automata(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 40)
    words = [b"w%d" % i for i in range(200)]
    got = phrases.locate([words[:36], words[100:140]], [words, words[101:150]])
    assert got == [{0, 1, *range(100, 106)}, set()]


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    starts = np.sort(rng.choice(560, 200, replace=False))
    ends = starts + rng.integers(1, 40, 200)
    text = suffixes.Suffixes(data)
    group = np.arange(200) % 3
    order = suffixes.merge_sort(text, group, starts, ends)
    cut = [data[a:b].tobytes() for a, b in zip(starts[order], ends[order], strict=True)]
    assert list(zip(group[order], cut, strict=True)) == sorted(zip(group, [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], strict=True))
    same = text.common(starts[:-1], starts[1:], np.minimum(ends[:-1] - starts[:-1], ends[1:] - starts[1:]))
    for a, b, c, d, n in zip(starts, ends, starts[1:], ends[1:], same, strict=False):
        x, y = data[a:b].tobytes(), data[c:d].tobytes()
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


@pytest.mark.parametrize("run", [setsketch.near_duplicates, phrases.remove_repeated_phrases, suffixes.remove_repeated_bytes])
def test_empty_tables_and_clashing_columns(nothing, clashing, docs, run):
    assert run(nothing).count() == 0
    key = lambda df: Counter(map(repr, df.collect()))
    assert key(run(clashing)) == key(run(docs))


@pytest.mark.parametrize("collide", [False, True])
def test_strings_told_apart_by_their_bytes(monkeypatch, collide):
    rng = np.random.default_rng(2)
    side = [rng.integers(97, 100, 34, dtype=np.uint8).tobytes() for _ in range(3)]
    anchors = [b"0123456789abcdef", b"the other anchor"]

    def near(x):
        return x if rng.random() < 0.5 else bytes([*x[:20], 97 + int(rng.integers(3)), *x[21:]])

    texts = list(dict.fromkeys(near(side[rng.integers(3)]) + anchors[rng.integers(2)] + near(side[rng.integers(3)]) for _ in range(60)))
    n = len(texts)
    least, offset, windows = rng.permutation(n).astype(np.int64), np.full(n, 34), np.full(n, 35)
    bound = np.repeat(least[:, None], 35, 1)
    if collide:  # every left part has the same hash
        monkeypatch.setattr(suffixes.Suffixes, "of", lambda self, at, size: np.zeros(len(at), np.int64))
    suffixes._share(texts, offset, windows, least, bound)
    for i in range(n):
        for k in range(35):
            assert bound[i, k] == min(least[j] for j in range(n) if texts[j][k : k + 50] == texts[i][k : k + 50])


def test_words_are_coded_and_windows_cut_in_one_go():
    words = [f"w{i % 50}".encode() for i in range(120)]
    codes = phrases.words_kind().codes(words)
    assert codes.dtype == np.uint64 and len(set(codes.tolist())) == 50 and (codes[:50] == codes[50:100]).all()
    text = b" ".join(words)
    assert phrases.windows(text, words) == [b" ".join(words[i : i + 35]) for i in range(86)]
    assert phrases.windows(b" ".join(words[:35]), words[:35]) == [b" ".join(words[:35])]
    assert phrases.words_kind().codes([]).shape == (0,)
