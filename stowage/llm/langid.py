"""Language identification with interpolated Kneser-Ney character models.

One model per language over runs of four symbols (letters, lower-cased; every
run of other characters is one blank). Counts cover all training texts: tasks
count their own part, Spark adds them up, and the lower orders count distinct
left neighbours, as Kneser and Ney's method asks.

The finished models sit in sorted arrays of 22-bit hashes, one row of log
probabilities per hash with a column per language, so one binary search serves
all languages. There are at most 2^22 hashes per order, which bounds the
broadcast; symbol runs with equal hashes share a row.

A text goes to the language of lowest cross-entropy per symbol. It is rejected
(``accepted`` false) where that entropy lies beyond what training texts of the
language show at this length, or where it has no letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, fold, mix, odd_numbers, rows, settle, texts

ORDER = 4
HASH_BITS = 22
#: Characters handled at once, and distinct symbol runs a task holds before it hands them on.
PIECE, HELD = 400_000, 600_000
#: Entropy beyond a language's mean, in deviations between its texts and of single symbols, that is rejected.
BETWEEN, WITHIN = 8.0, 8.0
#: Symbols that a posterior takes at most as independent.
EVIDENCE = 40
UNKNOWN = "und"

_PAD, _BLANK, _BREAK = 1, 32, 0x10FFFF
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def symbols(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ORDER symbols (n x ORDER code points, the predicted one last) and the part each belongs to."""
    low = [p.lower() for p in parts]
    data = "".join(x + chr(_BREAK) for x in low)
    s = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
    part = np.repeat(np.arange(len(low)), [len(x) + 1 for x in low])
    letter, stop = _letters()[s], s == _BREAK
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before | stop
    s, part, letter, stop = np.where(letter, s, _BLANK)[keep], part[keep], letter[keep], stop[keep]
    # A part ends with one blank if it ends with a letter; the break keeps the parts' contexts apart.
    ended = np.concatenate([[False], letter[:-1]])
    predicted = letter | (s == _BLANK) & ended
    first = np.concatenate([[True], part[1:] != part[:-1]]) if len(part) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else np.zeros(0, int)
    at, runs = np.arange(len(s)), np.empty((len(s), ORDER), np.uint32)
    for back in range(ORDER):
        i = at - back
        runs[:, ORDER - 1 - back] = np.where(i >= start, s[np.maximum(i, 0)], _PAD)
    return runs[predicted], part[predicted]


def pieces(batch_texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and slices of texts, at most PIECE characters together."""
    owners, held, size = [], [], 0
    for i, t in enumerate(batch_texts):
        for a in range(0, max(1, len(t)), PIECE):
            part = t[a : a + PIECE]
            if held and size + len(part) > PIECE:
                yield owners, held
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(part)
            size += len(part)
    if held:
        yield owners, held


def _key(runs: np.ndarray, salt: int) -> np.ndarray:
    total = np.full(len(runs), salt, np.uint64)
    for i, c in enumerate(odd_numbers(ORDER, 11)[: runs.shape[1]]):
        total = total + runs[:, i].astype(np.uint64) * c
    return mix(total)


def buckets(runs: np.ndarray) -> np.ndarray:
    """22-bit hash of symbol runs of one length."""
    return (_key(runs, runs.shape[1]) >> np.uint64(64 - HASH_BITS)).astype(np.uint32)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, run, n) of a task's texts."""
    schema = pa.schema([("lang", pa.string()), ("run", pa.string()), ("n", pa.int64())])
    held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (_, runs, n) in held.items():
            strings = np.ascontiguousarray(runs).view(f"<U{ORDER}").ravel().tolist()
            for a in range(0, len(strings), 100_000):
                part = strings[a : a + 100_000]
                yield rows(schema, [[lang] * len(part), part, n[a : a + 100_000]])
        held.clear()

    for batch in batches(it):
        by_lang: dict[str, list[str]] = {}
        for lang, t in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            by_lang.setdefault(lang, []).append(t)
        for lang, some in by_lang.items():
            for _, part in pieces(some):
                runs, _ = symbols(part)
                key, first, n = np.unique(_key(runs, 0), return_index=True, return_counts=True)
                runs = runs[first]
                if lang in held:
                    old = held[lang]
                    key, first, back = np.unique(np.concatenate([old[0], key]), return_index=True, return_inverse=True)
                    n = np.bincount(back, np.concatenate([old[2], n])).astype(np.int64)
                    runs = np.concatenate([old[1], runs])[first]
                held[lang] = (key, runs, n)
        if sum(len(h[0]) for h in held.values()) > HELD:
            yield from flush()
    yield from flush()


def run_counts(training: DataFrame) -> DataFrame:
    """(lang, run, n) over all training texts: how often each symbol run occurs."""
    counted = training.select("lang", "text").mapInArrow(_count, "lang string, run string, n long")
    return counted.groupBy("lang", "run").agg(F.sum("n").alias("n"))


def _hashed(width: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace runs by hashes of the run, its context and its shorter suffix."""
    schema = pa.schema([("lang", pa.string()), *[(c, pa.int64()) for c in ("run", "context", "suffix", "n")]])
    for batch in batches(it):
        strings = np.array(batch.column("run").to_pylist(), f"<U{width}")
        runs = strings.view(np.uint32).reshape(-1, width)
        cut = lambda x: buckets(x) if x.shape[1] else np.zeros(len(x), np.uint32)
        yield rows(
            schema,
            [batch.column("lang"), *[h.astype(np.int64) for h in (buckets(runs), cut(runs[:, :-1]), cut(runs[:, 1:]))], batch.column("n")],
        )


def order_tables(counts: DataFrame) -> dict[int, DataFrame]:
    """Per order: (lang, run, context, suffix, n) by hash; below the top, n counts distinct left neighbours."""
    tables, at = {}, counts
    for width in range(ORDER, 0, -1):
        hashed = at.select("lang", "run", "n").mapInArrow(
            partial(_hashed, width), "lang string, run long, context long, suffix long, n long"
        )
        tables[width] = hashed.groupBy("lang", "run").agg(
            F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n")
        )
        at = at.groupBy("lang", F.expr(f"substring(run, 2, {width - 1})").alias("run")).agg(F.count("*").alias("n"))
    return tables


class Models:
    """All languages' models: sorted hashes with log probabilities, and the contexts' back-off weights."""

    def __init__(self, tables: dict[int, pa.Table]):
        self.langs = sorted({x for t in tables.values() for x in t.column("lang").to_pylist()})
        index, n_langs = {x: i for i, x in enumerate(self.langs)}, len(self.langs)
        self.keys, self.logs, self.contexts, self.weights = {}, {}, {}, {}
        lower_keys, lower = np.zeros(1, np.uint32), None
        for width in range(1, ORDER + 1):
            t = tables[width]
            lang = np.array([index[x] for x in t.column("lang").to_pylist()], np.int64)
            run, context, suffix, n = (t.column(c).to_numpy().astype(np.int64) for c in ("run", "context", "suffix", "n"))
            keys, first, row = np.unique(run, return_index=True, return_inverse=True)
            grid = np.zeros((len(keys), n_langs))
            np.add.at(grid, (row, lang), n)
            heads, head = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(heads), n_langs)), np.zeros((len(heads), n_langs))
            np.add.at(total, (head, lang), n)
            np.add.at(kinds, (head, lang), 1)
            ones = np.bincount(lang[n == 1], minlength=n_langs)
            twos = np.bincount(lang[n == 2], minlength=n_langs)
            discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            place = np.searchsorted(heads, context[first])
            seen = np.maximum(grid - discount, 0) / np.maximum(total[place], 1)
            if lower is None:
                below = np.full((len(keys), n_langs), 1.0 / max(1, 4 * len(keys)))
            else:
                found = np.searchsorted(lower_keys, suffix[first])
                found = np.minimum(found, len(lower_keys) - 1)
                hit = lower_keys[found] == suffix[first]
                below = np.where(hit[:, None], lower[found], lower.min(0))
            p = seen + weight[place] * below
            self.keys[width], self.logs[width] = keys.astype(np.uint32), np.log(p).astype(np.float32)
            self.contexts[width], self.weights[width] = heads.astype(np.uint32), np.log(weight).astype(np.float32)
            lower_keys, lower = keys, p
        self.floor = np.float32(-np.log(max(1, 4 * len(self.keys[1]))))

    def log_probs(self, runs: np.ndarray) -> np.ndarray:
        """n x languages: log probability of each run's last symbol after the others."""
        out = np.empty((len(runs), len(self.langs)), np.float32)
        todo, owed = np.arange(len(runs)), np.zeros((len(runs), len(self.langs)), np.float32)
        for width in range(ORDER, 0, -1):
            if not len(todo):
                break
            part = runs[todo][:, ORDER - width :]
            keys, wanted = self.keys[width], buckets(part)
            i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[i] == wanted
            out[todo[hit]] = self.logs[width][i[hit]] + owed[hit]
            miss = ~hit
            todo, owed = todo[miss], owed[miss]
            heads = self.contexts[width]
            wanted = buckets(part[miss][:, :-1]) if width > 1 else np.zeros(len(todo), np.uint32)
            i = np.minimum(np.searchsorted(heads, wanted), len(heads) - 1)
            same = heads[i] == wanted
            owed[same] += self.weights[width][i[same]]
        out[todo] = owed + self.floor
        return out


def train(training: DataFrame) -> Models | None:
    """Models of every language of ``training`` (text, lang); None if it has no letters."""
    counts = settle(run_counts(training), "language-runs")
    tables = {w: t.toArrow() for w, t in order_tables(counts).items()}
    return Models(tables) if all(len(t) for t in tables.values()) else None


_SCORED = "doc_id long, lang string, trains boolean, lang_pred string, n long, entropy double, spread double, score double"


def _score(box, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    models: Models = box.value
    n_langs = len(models.langs)
    for batch in batches(it):
        some = texts(batch)
        total, square, n = (np.zeros((len(some), n_langs)) for _ in range(3))
        for owners, parts in pieces(some):
            runs, part = symbols(parts)
            if not len(runs):
                continue
            logs = models.log_probs(runs)
            who = np.array(owners)[part]
            for j in range(n_langs):
                total[:, j] += np.bincount(who, logs[:, j], len(some))
                square[:, j] += np.bincount(who, logs[:, j].astype(float) ** 2, len(some))
            n[:, 0] += np.bincount(who, minlength=len(some))
        size = np.maximum(n[:, :1], 1)
        entropy = -total / size
        best = entropy.argmin(1)
        at = np.arange(len(some))
        gap = (entropy - entropy[at, best][:, None]) * np.minimum(size, EVIDENCE)
        score = 1 / np.exp(-gap).sum(1)
        none = n[:, 0] == 0
        spread = np.sqrt(np.maximum(square / size - entropy**2, 0))[at, best]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), batch.column("trains"),
                pa.array([UNKNOWN if u else models.langs[b] for u, b in zip(none, best, strict=True)]),
                pa.array(n[:, 0].astype(np.int64)), pa.array(entropy[at, best]), pa.array(spread),
                pa.array(np.where(none, 0.0, score)),
            ],
            names=["doc_id", "lang", "trains", "lang_pred", "n", "entropy", "spread", "score"],
        )


def identify(docs: DataFrame, held_out_fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, entropy for every row of ``docs``.

    Learns from text and non-null lang of documents outside the held-out fold;
    lang, source and doc_id are no inputs of a prediction. Texts that are null
    or have no letter get ``und``, score 0 and are not accepted. Where nothing
    can be learned (empty table, no lang) every text gets ``und``. Ties go to
    the language that sorts first. Repeated rows get equal results.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
        (F.col("lang").isNotNull() & (fold("doc_id", folds) != held_out_fold)).alias("trains"),
    )
    models = train(base.filter("trains"))
    held = (fold("doc_id", folds) == held_out_fold).alias("held_out")
    if models is None:
        return base.select(
            "doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("entropy"),
        )
    scored = settle(base.mapInArrow(partial(_score, spark.sparkContext.broadcast(models)), _SCORED), "language-scores")
    # Calibration: per language, how entropy spreads between its training texts and between single symbols.
    right = scored.filter("trains AND lang = lang_pred AND n >= 50")
    limits = right.groupBy(F.col("lang_pred").alias("_lang")).agg(
        F.avg("entropy").alias("_mean"), F.stddev_pop("entropy").alias("_between"), F.avg("spread").alias("_within")
    )
    joined = scored.join(F.broadcast(limits), F.col("lang_pred") == F.col("_lang"), "left")
    limit = F.col("_mean") + BETWEEN * F.col("_between") + WITHIN * F.col("_within") / F.sqrt("n")
    accepted = (F.col("n") > 0) & F.coalesce(F.col("entropy") <= limit, F.lit(True))
    return joined.select("doc_id", held, "lang_pred", "score", accepted.alias("accepted"), "entropy")
