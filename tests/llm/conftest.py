import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, syllables: list[str]) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    en, de = ["th", "er", "on", "an", "ing", "ed"], ["sch", "un", "ver", "lich", "ein", "zu"]
    rows = []
    for i in range(60):
        lang, s = ("en", en) if i % 3 else ("de", de)
        rows.append((i, prose(rng, rng.randint(20, 160), s), lang, "a" if i % 2 else "b"))
    passage = prose(rng, 60, en)
    for i in range(60, 70):
        rows.append((i, f"{prose(rng, 30, en)}\n{passage} {prose(rng, 20, en)}", "en", "a"))
    for i in range(70, 80):  # exact copies and copies with one changed word
        words = rows[i - 70][1].split(" ")
        if i % 2:
            words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), rows[i - 70][2], None))
    for i in range(80, 110):  # a large group of near copies
        words = passage.split(" ") * 4
        words[i % len(words)] = f"x{i}"
        rows.append((i, " ".join(words), "en", "a"))
    rows += [
        (110, None, "en", "a"), (111, "", "en", "a"), (112, " \t\n ", None, None), (None, "no id here at all", "en", "a"),
        (113, "one two", "en", "a"), (114, "One  TWO", "en", "a"), (115, "w " * 300, "en", "a"), (116, "a" * 400, "en", "b"),
        (117, "123 456 !!", "en", "a"), (118, prose(rng, 4000, de), "de", "b"), (118, rows[0][1], "de", "b"),
        (119, "çé ñ x\x85y " + rows[3][1], "fr", None), (119, "çé ñ x\x85y " + rows[3][1], "fr", None),
    ]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns, of names the operators use themselves."""
    names = "n key regs rep comp h a b chunk blob bucket part size x y trains score kept run context value _gone _w _t count".split()
    out = docs
    for name in names:
        out = out.selectExpr("*", f"'z' AS {name}")
    return out
