import random

import corpus_pipeline
from stowage.llm import langid, setsketch
from stowage.llm.common import settle


def test_stages_keep_the_columns_and_clean_documents(spark, docs, corpus, tmp_path):
    spark.createDataFrame([(1, corpus[20][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        nxt = settle(stage(spark, at, str(tmp_path)), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert nxt.columns == docs.columns
        seen.append({r.doc_id for r in nxt.select("doc_id").collect()})
        at = nxt
    accepted = {r.doc_id for r in langid.identify(docs).filter("accepted").collect()}
    assert seen[0] == accepted - {r.doc_id for r in langid.identify(docs).filter("NOT accepted").collect()} - set()
    after = settle(corpus_pipeline.language(spark, docs, str(tmp_path)), "stage")
    kept = {r.doc_id for r in setsketch.near_duplicates(after).filter("kept").collect()}
    assert seen[1] >= kept - {118} and 20 in seen[1] and 20 not in seen[2]
    assert seen[2] == seen[3] == seen[4]
    assert at.count() == len(seen[4])


def test_repeated_rows_leave_one(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, rows, str(tmp_path)).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in got) == [(-1, text), (1, text)]


def test_empty_corpus(spark, nothing, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = nothing
    for _, stage in corpus_pipeline.STAGES:
        at = settle(stage(spark, at, str(tmp_path)), "stage")
    assert at.count() == 0


def test_clashing_columns_pass(spark, clashing, docs, tmp_path):
    got = corpus_pipeline.language(spark, clashing, str(tmp_path))
    assert got.columns == clashing.columns
    assert got.count() == corpus_pipeline.language(spark, docs, str(tmp_path)).count()


def test_near_duplicate_stage_equals_brute_force_at_80(spark, tmp_path):
    rng = random.Random(80)
    texts = {}
    for group in range(60):
        words = [f"g{group}w{i}" for i in range(204)]
        texts[2 * group] = " ".join(words)
        # Each changed word breaks five of the 200 shingles: 3 leave 185 / 215, 4 leave 180 / 220, 5 leave 175 / 225.
        for at in rng.sample(range(10, 200, 10), 3 + group % 3):
            words[at] = f"x{group}-{at}"
        texts[2 * group + 1] = " ".join(words)
    sets = {i: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(near) == 40 and any(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in near)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, str(tmp_path)).collect()}
    assert got == set(texts) - {b for _, b in near}


def test_bands_follow_the_threshold():
    assert setsketch.bands(85) == 25
    for shared in (70, 80, 85, 95):
        assert (1 - (shared / 100) ** setsketch.ROWS) ** setsketch.bands(shared) <= setsketch.MISS
