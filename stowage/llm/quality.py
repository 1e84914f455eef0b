"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a vector of statistics. Random cosines of the standardised
vector approximate a Gaussian kernel; the normal equations of a ridge fit on
them are sums, so each partition adds up its own and the parts are added again.
Isotonic regression on rows that the fit has not seen turns raw scores into
probabilities.

The fit uses at most FIT_ROWS labelled rows (the lowest hashes of their ids);
statistics, standardisation and scores cover all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, fold, settle, texts

#: Bound of the labelled sample, and the partitions its sums are made in.
FIT_ROWS, FIT_PARTS = 200_000, 16
#: Number of random features, kernel width in standard deviations per statistic, and the ridge.
FEATURES, WIDTH, RIDGE = 256, 1.6, 1.0
#: One part in so many of the training rows calibrates instead of fitting.
CALIBRATION_PARTS = 4
THRESHOLD = 0.3

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_ENDS = re.compile(r"[.!?](?=\s|$)")
STATISTICS = (
    "log_words", "mean_word", "spread_word", "longest_word", "distinct_words", "top_word", "repeated_trigrams", "symbols",
    "bars", "digits", "upper", "other_marks", "letters", "sentence_words", "exclaims", "lines", "duplicate_lines",
    "line_words", "short_words", "log_chars",
)


def statistics(text: str) -> list[float]:
    """The statistics of one text; all zero where it has no word."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], words[2:])) if n > 2 else Counter()
    lines = [x for x in text.split("\n") if x.strip()]
    code = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    hist = np.bincount(code, minlength=256)
    symbols = int(sum(hist[ord(c)] for c in "#*$%&|<>"))
    digits = int(hist[48:58].sum())
    upper = int(hist[65:91].sum() + hist[0xC0:0xDF].sum())
    low = int(hist[97:123].sum() + hist[0xDF:0x100].sum())
    ends = max(1, int(hist[46] + hist[33] + hist[63]))
    return [
        np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(seen) / n, seen.most_common(1)[0][1] / n,
        1 - len(pairs) / max(1, n - 2), symbols / chars, int(hist[124]) / chars, digits / chars, upper / chars,
        int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum() - symbols) / chars,
        (upper + low) / chars, np.log1p(n / ends), int(hist[33]) / n, np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), float((lengths <= 3).mean()), np.log1p(chars),
    ]


def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        x = np.array([statistics(t) for t in texts(batch)], np.float32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))],
            names=["doc_id", "x"],
        )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text; null texts count as empty."""
    return docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<float>")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Features:
    """Standardisation and random cosines."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(20)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / (WIDTH * np.sqrt(len(mean))), (len(mean), FEATURES)) * np.sqrt(2)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _sums(features: Features, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = FEATURES + 1
    a, b = np.zeros((size, size)), np.zeros(size)
    for batch in batches(it):
        z = features(matrix(batch))
        a += z.T @ z
        b += z.T @ batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b]).tobytes()])], names=["sums"])


def pooled(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: centres and values of the pooled blocks."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(scores[order], y[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    out = np.array(blocks)
    return out[:, 2] / out[:, 1], out[:, 0] / out[:, 1]


class Scorer:
    def __init__(self, features: Features, weights: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.features, self.weights, self.at, self.value = features, weights, at, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def fit(measured: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5) -> Scorer | None:
    """Fit on labelled rows outside the held-out fold; None where there are none.

    ``labels`` holds doc_id and quality (0 or 1). A null quality is no label.
    """
    moments = measured.select(
        *[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(STATISTICS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(len(STATISTICS))])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(len(STATISTICS))])
    features = Features(mean, np.where(scale > 1e-9, scale, 1.0))
    own = labels.filter(F.col("quality").isNotNull() & (fold("doc_id", folds) != held_out_fold)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")
    )
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = settle(
        measured.join(chosen, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CALIBRATION_PARTS)) == 0).alias("later")),
        "quality-rows",
    )
    parts = rows.filter("NOT later").repartition(FIT_PARTS).mapInArrow(partial(_sums, features), "sums binary").collect()
    if not parts:
        return None
    total = sum(np.frombuffer(p["sums"]) for p in parts)
    size = FEATURES + 1
    a, b = total[: size * size].reshape(size, size), total[size * size :]
    if not np.any(a):
        return None
    weights = np.linalg.solve(a + RIDGE * np.diag([*[1.0] * FEATURES, 1e-6]), b)
    # At most FIT_ROWS / CALIBRATION_PARTS rows of two numbers reach the driver.
    scorer = Scorer(features, weights, np.zeros(1), np.zeros(1))
    later = rows.filter("later").mapInArrow(partial(_raw, scorer), "raw double, y int").toArrow()
    if not len(later):
        scorer.at, scorer.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return scorer
    scorer.at, scorer.value = pooled(later.column("raw").to_numpy(), later.column("y").to_numpy().astype(float))
    return scorer


def _raw(scorer: Scorer, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        yield pa.RecordBatch.from_arrays([pa.array(scorer.raw(matrix(batch))), batch.column("y").cast(pa.int32())], names=["raw", "y"])


def _predict(scorer: Scorer | None, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        s = scorer.score(matrix(batch)) if scorer else np.full(batch.num_rows, 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])


def classify(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only doc_id and text of ``docs`` are read, and the id only to find labels
    and folds. Null and empty texts have all statistics zero and are scored like
    any other. Without labelled rows every score is 0.5. Repeated rows get equal
    scores. The statistics are written once and read by the fit and the scoring.
    """
    measured = settle(measure(docs), "quality-statistics")
    scorer = fit(measured, labels, held_out_fold, folds)
    scored = measured.mapInArrow(partial(_predict, scorer), "doc_id long, score double")
    return scored.select(
        "doc_id", (fold("doc_id", folds) == held_out_fold).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
