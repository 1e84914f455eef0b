import hashlib
from collections import Counter

import numpy as np
import pytest

from stowage.llm import bpe, warc
from stowage.llm.queries import vocabulary

TEXTS = [
    "", "  ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ İstanbul ñ ñ \x1c\x1d x\x85y z it's I'LL don't 123 ４５ ²", "<|endoftext|><|endoftext|>",
    "🙂 emoji🙂🙂 日本語テキスト", "a" * 5000, "!!!???...", "ſ K ﬁ", " 's's 'd", " <|ENDOFTEXT|>", "\x00 ​ x", "Plain words, twice. Plain words!",
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(vocabulary())


def test_coding_equals_the_library(spark, library, docs, corpus):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + k, c[1]) for k, c in enumerate(corpus)]
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), with_decoded=True)
    got = {r.doc_id: r for r in coded.collect()}
    again = {r.doc_id: r.decoded for r in bpe.decode(coded, vocabulary()).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == again[i] == library.decode(ids, skip_special_tokens=False)


def test_merges_skip_stale_entries():
    merges = bpe.Merges({"a": 0, "b": 1, "c": 2}, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a")])
    names = {n: s for s, n in merges.number.items()}
    assert [names[s] for s in merges.apply([0, 1, 2, 0, 1, 2, 0, 0])] == ["abc", "abc", "aa"]
    assert [names[s] for s in merges.apply([0] * 5)] == ["aa", "aa", "a"]
    assert [names[s] for s in merges.apply([0] * 600)] == ["aa"] * 300
    assert merges.apply([1, 0]) == [1, 0] and merges.apply([2]) == [2]


def test_words_are_coded_alike_from_both_generations(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    coder = bpe.Codec(vocabulary())
    for text in ["one two three four five, one two", "five four three two one", "l'été d'été", "one two three four five, one two"]:
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_empty_table(nothing, clashing, docs):
    assert bpe.encode(nothing, vocabulary()).count() == 0
    assert Counter(map(repr, bpe.encode(clashing, vocabulary()).collect())) == Counter(map(repr, bpe.encode(docs, vocabulary()).collect()))


PAGES = [
    (3, "http://a/1", "x" * 200), (1, "http://a/2", "x" * 200), (2, "http://b/3\r\nX: y", "x" * 200), (4, None, "short"), (5, "u", "short"),
    (6, "u", None), (7, "u", ""), (8, "http://b/é", "é" * 60), (None, "n", "é" * 60), (9, "c", "WARC/1.1\r\n\r\n" * 20), (1, "http://a/2", "x" * 200),
    (None, "n", "z" * 150), (None, "m", "z" * 150), (10, "long", "<p>text</p>" * 300_000),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", warc.F.lit("clash"))
    path = str(tmp_path / "archive")
    warc.write_archives(pages.repartition(3), path)
    got = warc.read_archives(spark, path).collect()
    least = {}
    for i, _, html in PAGES:
        if i is not None and html and len(html.encode()) >= 100:
            least[html] = min(i, least.get(html, i))
    want = Counter()
    for i, _, html in PAGES:
        first = least.get(html)
        revisit = first is not None and i != first
        data = (html or "").encode()
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes


def test_filters_and_skipped_payloads(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2), path)
    one = warc.read_archives(spark, path, payload=False).filter("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    assert [(r.page_id, r.payload) for r in one.collect()] == [(3, None)]
    assert warc.read_archives(spark, path).filter("page_id IN (4, 10)").count() == 2
    assert warc.read_archives(spark, path).filter("page_id > 8 AND record_type = 'response'").count() == 2


def test_foreign_archives_and_plain_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    raw = b"".join(
        b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: http://x/\r\nContent-Type: " + ct + b"\r\nContent-Length: " + str(len(b)).encode() + b"\r\n\r\n" + b + b"\r\n\r\n"
        for kind, ct, b in ((b"warcinfo", b"application/warc-fields", b"software: x\r\n"), (b"response", b"application/http", body), (b"resource", b"text/plain", b"r" * 3_000_000))
    )
    (tmp_path / "a.warc").write_bytes(raw)
    got = {r.record_type: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"warcinfo": b"software: x\r\n", "response": b"hello", "resource": b"r" * 3_000_000}
    last = warc.read_archives(spark, str(tmp_path)).filter("record_type = 'resource'").select("payload_bytes").collect()
    assert [r.payload_bytes for r in last] == [3_000_000]


def test_empty_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
