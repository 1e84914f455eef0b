"""Whitening of embeddings by their exact covariance, found through polarisation.

Cov(i, j) = (Var(x_i + x_j) - Var(x_i) - Var(x_j)) / 2, so squares of single
dimensions and of sums of two are all that is aggregated. They are squares of
whole numbers: entries become x = floor(64 c) + 1,000,000, centred on the
whole part m of their mean S / n. With y = x - m and r = S - n m,

    sum (n x - S)^2 = n^2 sum y^2 - n r^2,

which is exact, and y is small however far from zero the entries lie. Tasks
add up blocks of rows; sums travel as limbs of 32 bits, so that they are exact
at any number of rows. What reaches the driver is one number per dimension and
pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, rows

#: Entries c become floor(SCALE c) + SHIFT; SCALE c beyond LARGEST has no long and counts as not finite.
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 62)
#: Components returned, and the share of the greatest eigenvalue from which a component counts as having variance.
COMPONENTS, FLAT = 32, 1e-13
#: Rows of one block, and the limbs of a sum: 32 bits each, the last with the sign.
_BLOCK, _LIMBS = 2048, 6
_BITS, _MASK = 32, (1 << 32) - 1


def usable() -> Column:
    """Whether ``embedding`` is a vector whose every entry is a finite number that becomes a long."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST)
    return F.col("embedding").isNotNull() & F.forall("embedding", entry)


def _vectors(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The longs x of a batch of vectors of ``d`` entries."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, d)


def _limbs(value: int) -> list[int]:
    return [*(value >> (_BITS * k) & _MASK for k in range(_LIMBS - 1)), value >> (_BITS * (_LIMBS - 1))]


def _number(limbs) -> int:
    return sum(int(v) << (_BITS * k) for k, v in enumerate(limbs))


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """``x`` as it is where figures up to ``most`` fit 64 bits, else as whole numbers of any size."""
    return x if most < 1 << 62 else x.astype(object)


_SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32())] + [(f"l{k}", pa.int64()) for k in range(_LIMBS)])
_SUMS_DDL = "i int, j int, " + ", ".join(f"l{k} long" for k in range(_LIMBS))


def _emit(sums: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield rows(_SUMS, zip(*[(i, j, *_limbs(v)) for (i, j), v in sums.items()], strict=True))


def _totals(vectors: DataFrame, task) -> dict[tuple[int, int], int]:
    """The sums that the tasks give, added up by their two indices."""
    parts = vectors.select("embedding").mapInArrow(task, _SUMS_DDL)
    added = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)])
    return {(r.i, r.j): _number(r[2:]) for r in added.collect()}


def _sum_task(d: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, [0] * d
    for batch in batches(it):
        x = _vectors(batch, d)
        n += len(x)
        sums = _exact(x, int(np.abs(x).max()) * len(x)).sum(axis=0)
        total = [t + int(s) for t, s in zip(total, sums, strict=True)]
    yield from _emit({(-1, -1): n, **{(i, -1): t for i, t in enumerate(total)}} if n else {})


def _square_task(centre: np.ndarray, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension (i, i) and pair (i, j), i < j: the sum of y_i^2, or of (y_i + y_j)^2."""
    d = len(centre)
    total = [np.zeros(d - i, object) for i in range(d)]
    seen = False
    for batch in batches(it):
        x = _vectors(batch, d)
        for at in range(0, len(x), _BLOCK):
            y = x[at : at + _BLOCK] - centre
            y = np.ascontiguousarray(_exact(y, 4 * int(np.abs(y).max()) ** 2 * len(y)).T)
            seen = True
            for i in range(d):
                pair = y[i:] + y[i]
                pair[0] = y[i]
                total[i] += (pair * pair).sum(axis=1).astype(object)
    if seen:
        yield from _emit({(i, i + k): int(v) for i in range(d) for k, v in enumerate(total[i])})


@dataclass(frozen=True)
class Whitening:
    """What whitening is fitted to: ``n`` rows of sums ``sums``, and the components found."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # unit eigenvectors, one per column
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """Whole parts of the means."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """What the whole parts leave of the sums: 0 to n - 1."""
        return [s % self.n for s in self.sums]

    @property
    def steep(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > FLAT * max(self.trace, 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; components without variance give 0."""
        y = (x - self.centre).astype(np.float64) - np.array([r / self.n for r in self.rest])
        scale = np.where(self.steep, 1 / np.sqrt(np.where(self.steep, self.values, 1.0)), 0.0)
        return y @ (self.axes * scale)


def covariance(n: int, squares: dict[tuple[int, int], int], rest: list[int]) -> np.ndarray:
    """Covariance, divisor n, from sums of squares: whole numbers until the last division."""
    d = len(rest)
    single = [n * n * squares[i, i] - n * rest[i] ** 2 for i in range(d)]
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = single[i] / n**3
        for j in range(i + 1, d):
            both = n * n * squares[i, j] - n * (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (both - single[i] - single[j]) / (2 * n**3)
    return v


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the vectors of ``d`` entries; None where there is none."""
    sums = _totals(vectors, partial(_sum_task, d))
    if not sums:
        return None
    n, s = sums[-1, -1], [sums[i, -1] for i in range(d)]
    centre = np.array([x // n for x in s], np.int64)
    squares = _totals(vectors, partial(_square_task, centre))
    v = covariance(n, squares, [x % n for x in s])
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, s, values[order], axes[:, order], float(np.trace(v)))


_PROJECTED = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])


def _deviations(x: np.ndarray, w: Whitening) -> list[int]:
    """Per vector the sum over dimensions of (n x - S)^2, exact."""
    y = x - w.centre
    most = (w.n * (int(np.abs(y).max()) + 1)) ** 2 * x.shape[1]
    y = _exact(y, most)
    z = w.n * y - np.array(w.rest, y.dtype)
    return [int(v) for v in (z * z).sum(axis=1)]


def _project_task(w: Whitening, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from decimal import Context, Decimal

    exact = Context(prec=200)
    for batch in batches(it):
        x = _vectors(batch, len(w.sums))
        deviation = [exact.create_decimal(v) if v < 10**38 else None for v in _deviations(x, w)]
        p = w.project(x)
        flat = pa.array(p.ravel())
        whitened = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), flat)
        deviation = pa.array([Decimal(v) if v is not None else None for v in deviation], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, whitened], schema=_PROJECTED)


_PRODUCTS = pa.schema([("row", pa.int32()), ("products", pa.list_(pa.float64()))])


def _product_task(w: Whitening, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row k: sums of whitened k times every whitened; the last row: sums of every whitened."""
    k = w.axes.shape[1]
    total = np.zeros((k + 1, k))
    seen = False
    for batch in batches(it):
        p = w.project(_vectors(batch, len(w.sums)))
        total[:k] += p.T @ p
        total[k] += p.sum(axis=0)
        seen = True
    if seen:
        yield rows(_PRODUCTS, [range(k + 1), total.tolist()])


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest entry, without sign, of the whitened rows' covariance minus the identity, over components with variance."""
    k = w.axes.shape[1]
    parts = vectors.select("embedding").mapInArrow(partial(_product_task, w), "row int, products array<double>")
    added = parts.select("row", F.posexplode("products").alias("column", "product")).groupBy("row", "column").agg(
        F.sum("product").alias("product")
    )
    total = np.zeros((k + 1, k))
    for r in added.collect():
        total[r.row, r.column] = r["product"]
    mean = total[k] / w.n
    # The rows are centred already, so the means are rounding errors and cost no digits.
    apart = np.abs(total[:k] / w.n - np.outer(mean, mean) - np.eye(k))[w.steep][:, w.steep]
    return float(apart.max()) if apart.size else 0.0


def dimensions(vectors: DataFrame) -> int:
    """Entries of most vectors; of equally frequent lengths, the greatest. 0 where there is no vector."""
    lengths = vectors.groupBy(F.size("embedding").alias("d")).count()
    best = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return best.d if best else 0


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened, explained, identity_error: one row per vector that is kept.

    Dropped are vectors that are null or empty, hold null or non-finite
    entries or ones too great for a long, or have another length than most.
    All others are fitted and whitened, repeated rows and null ids too.
    ``whitened`` and ``explained`` have one entry per component, at most
    ``components``, by falling eigenvalue; a component without variance
    (equal vectors, fewer vectors than dimensions) has a null entry in
    ``whitened`` and explains 0. ``deviation`` is a decimal of 38 digits, null
    beyond them. An empty table gives no rows. Only vec_id and embedding are
    read.
    """
    kept = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(usable())
    d = dimensions(kept)
    vectors = kept.filter(F.size("embedding") == d)
    w = fit(vectors, d, components) if d else None
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    constants = "n long, explained array<double>, identity_error double"
    if w is None:
        return embeddings.sparkSession.createDataFrame([], f"{schema}, {constants}")
    explained = [float(e) / w.trace if s else 0.0 for e, s in zip(w.values, w.steep, strict=True)]
    out = vectors.mapInArrow(partial(_project_task, w), schema)
    if not w.steep.all():
        flat = F.array(*[F.lit(not s) for s in w.steep.tolist()])
        out = out.withColumn("whitened", F.zip_with("whitened", flat, lambda x, no: F.when(~no, x)))
    return out.select(
        "*", F.lit(w.n).cast("long").alias("n"), F.lit(explained).cast("array<double>").alias("explained"),
        F.lit(identity_error(vectors, w)).alias("identity_error"),
    )


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1; ``deviation`` as a long, null where it has none."""
    each = whitened.select(
        "vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "explained", "identity_error",
        F.posexplode("whitened").alias("_at", "whitened"),
    )
    return each.select(
        "vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at("explained", F.col("_at") + 1).alias("explained"), "identity_error",
    )
