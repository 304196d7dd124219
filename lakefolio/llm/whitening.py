"""Whitening of embeddings from exact integer moments.

Vectors are turned into integers. The products that covariances need are made by
a digit-slice GEMM: integers are split into limbs of `LIMB` bits with a sign, of
so few bits that float64 matrix products of `BLOCK` rows of limbs stay exact;
the products are shifted and added as big integers. Every task sends the upper
triangle of its own sums as digits, Spark adds the digits of all tasks, and the
driver gets one matrix, of the vectors' size squared, which is centred exactly
(n * sum(xy) - sum(x) * sum(y)) before it becomes floats and is decomposed.

The decomposition is checked in exact products, too: the integers' covariance is
turned into the found axes without rounding, eigenvalues are read there, and
where they differ by many orders of magnitude the axes are turned further.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, settle, trimmed

LIMB = 20
#: Rows of one product: 2**14 products of two limbs of at most 2**19 each.
BLOCK = 1 << 14
#: Bits of the digits that tasks send; 2**23 tasks can be added in a long.
_DIGIT = 40
#: Bits after the point with which axes enter exact products.
_FINE = 60
_LONG = 2**63 - 1


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float arrays with x = sum of limb * 2**(LIMB * place), |limb| <= 2**(LIMB - 1).
    x: of int64, or of Python integers of any size."""
    out, mask, half = [], (1 << LIMB) - 1, 1 << (LIMB - 1)
    while x.any():
        low = (x & mask).astype(np.int64)
        up = low >= half
        out.append((low - (up.astype(np.int64) << LIMB)).astype(float))
        x = (x >> LIMB) + (up if x.dtype == np.int64 else up.astype(int).astype(object))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of integers, exact, as Python integers."""
    out = np.zeros((a.shape[1], b.shape[1]), dtype=object)
    for low in range(0, len(a), BLOCK):
        left = limbs(a[low : low + BLOCK])
        right = left if b is a else limbs(b[low : low + BLOCK])
        sums: dict[int, list[np.ndarray]] = {}
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                if b is not a or j >= i:
                    exact = (p.T @ q).astype(np.int64)  # at most 2**52
                    sums.setdefault(i + j, []).append(exact + exact.T if b is a and j > i else exact)
        for place, some in sums.items():
            for exact in some:
                out += exact.astype(object) << (LIMB * place)
    return out


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if digit := value & ((1 << _DIGIT) - 1):
            yield place, sign * digit
        value >>= _DIGIT
        place += 1


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _moments(size: int):
    """A task's sums of products of all pairs of (x, 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1), dtype=object)
        held, rows = [], 0

        def add() -> None:
            nonlocal total, held, rows
            x = np.concatenate(held)
            x = np.hstack([x, np.ones((len(x), 1), np.int64)])
            total = total + product(x, x)
            held, rows = [], 0

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                held.append(_matrix(batch.column(0).slice(low, BLOCK), size))
                rows += len(held[-1])
                if rows >= BLOCK:
                    add()
        if rows:
            add()
        i, j, place, value = [], [], [], []
        for a in range(size + 1):
            for b in range(a, size + 1):
                for p, v in _digits(int(total[a, b])):
                    i.append(a), j.append(b), place.append(p), value.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.int64())], names=["i", "j", "place", "value"])

    return trimmed(run)


@dataclass
class Whitener:
    """n vectors with sums `sums`; `axes` (one a row, of length 1) with falling
    eigenvalues `values` of the covariance, whose trace is `trace`."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @staticmethod
    def of(gram: np.ndarray, most: int) -> Whitener:
        """From the exact sums of products of (x, 1)."""
        n, sums = int(gram[-1, -1]), [int(s) for s in gram[:-1, -1]]
        s = np.array(sums, dtype=object)
        scatter = gram[:-1, :-1] * n - np.outer(s, s)  # n * n * covariance
        axes, values = _decomposed(scatter, n * n, most)
        return Whitener(n, sums, axes, values, int(np.trace(scatter)) / (n * n))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S)**2, exact, for every row."""
        most, size = max(1, abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), x.shape[1]
        top = max([1, *map(abs, self.sums)])
        if size * most * max(most, top) <= _LONG:
            squares, mixed = (x * x).sum(axis=1).astype(object), (x @ np.array(self.sums, np.int64)).astype(object)
        else:
            wide = x.astype(object)
            squares, mixed = (wide * wide).sum(axis=1), wide @ np.array(self.sums, dtype=object)
        return (squares * (self.n * self.n) - mixed * (2 * self.n) + sum(s * s for s in self.sums)).tolist()

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - S / n on every axis, over the root of its eigenvalue; NaN where that is 0."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if self.n * most + max([0, *map(abs, self.sums)]) <= _LONG:
            centred = (x * self.n - np.array(self.sums, np.int64)).astype(float)
        else:
            centred = (x.astype(object) * self.n - np.array(self.sums, dtype=object)).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (centred / self.n) @ self.axes.T / np.sqrt(self.values), np.nan)


def _turned(t: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Jacobi's rotations: axes in which the symmetric `t` is diagonal, each pair
    in proportion to its own two entries, however far apart the others are."""
    t, axes, size = t.copy(), np.eye(len(t)), len(t)
    for _ in range(sweeps):
        done = True
        for p in range(size - 1):
            for q in range(p + 1, size):
                a, b, c = t[p, p], t[q, q], t[p, q]
                if c == 0 or abs(c) <= 1e-15 * np.sqrt(abs(a)) * np.sqrt(abs(b)):
                    continue
                done = False
                slope = (b - a) / (2 * c)
                tan = (1 if slope >= 0 else -1) / (abs(slope) + np.hypot(1, slope))
                cos = 1 / np.hypot(1, tan)
                turn = np.array([[cos, tan * cos], [-tan * cos, cos]])
                t[:, [p, q]] = t[:, [p, q]] @ turn
                t[[p, q], :] = turn.T @ t[[p, q], :]
                t[p, q] = t[q, p] = 0.0
                axes[:, [p, q]] = axes[:, [p, q]] @ turn
        if done:
            break
    return axes


def _decomposed(scatter: np.ndarray, scale: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The axes of the largest eigenvalues of scatter / scale, `most` at most.

    The eigenvalues are exact products' Rayleigh quotients. Without a gap of
    orders of magnitude floats' own decomposition is all there is to it; else
    the matrix is turned into its axes exactly, and what is left there is turned
    in proportion to each pair of entries.
    """
    size = len(scatter)
    floats = np.array([[int(v) / scale for v in row] for row in scatter], float).reshape(size, size)
    axes = np.linalg.eigh(floats)[1] if size else floats
    for again in range(4):
        ints = np.array([[round(v * 2.0**_FINE) for v in row] for row in axes.tolist()], dtype=object).reshape(size, size)
        turned = product(ints, product(scatter, ints))
        lengths = [sum(int(v) ** 2 for v in column) for column in ints.T]
        values = np.array([int(turned[i, i]) / (scale * lengths[i]) for i in range(size)], float)
        order = np.argsort(-values, kind="stable")
        few = order[:most]
        if not size or again == 3 or values[few[-1]] > 1e-8 * values[few[0]]:
            break
        unit = scale << (2 * _FINE)
        axes = axes @ _turned(np.array([[int(v) / unit for v in row] for row in turned], float))
        axes /= np.sqrt((axes**2).sum(axis=0))
    values = np.where(values > 1e-24 * values.max(initial=0), values, 0.0)
    return axes[:, few].T.copy(), values[few]


def _usable(x: Column) -> Column:
    odd = F.exists(x, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return x.isNotNull() & ~odd


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact) for every usable row and each of the first components.

    Rows with a null vector, or a null or non-finite entry, go; rows with a null
    id stay, and so do repeated rows, which are fitted once. Entries become
    floor(scale * x), those beyond a long the largest long. Shorter vectors count
    as filled with zeros to the length of the longest. There are no more
    components than dimensions; one without variance has `whitened` null and
    `explained` 0. `deviation` is null beyond a long, `deviation_exact` is the
    whole number as text. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col(vector_col)
    ints = vectors.filter(_usable(x)).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))
    farthest = F.greatest(F.coalesce(F.array_max("x"), F.lit(0)), -1 - F.coalesce(F.array_min("x"), F.lit(0)))
    known = ints.agg(F.max(F.size("x")).alias("high"), F.min(F.size("x")).alias("low"), F.max(farthest).alias("most")).first()
    size, schema = known.high or 0, f"vec_id {dict(vectors.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    if not size:
        return spark.createDataFrame([], schema)
    kind = next((k for k, bits in (("smallint", 15), ("int", 31)) if known.most < 1 << bits), "bigint")
    if known.low < size:
        ints = ints.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), size - F.size("x"))))
    ints = ints.select("vec_id", F.col("x").cast(f"array<{kind}>").alias("x"))
    fit = settle(ints.select("x").distinct())
    sent = fit.mapInArrow(_moments(size), "i int, j int, place int, value long").groupBy("i", "j", "place").agg(F.sum("value").alias("value"))
    gram = np.zeros((size + 1, size + 1), dtype=object)
    for r in sent.collect():  # a triangle of the vectors' size
        gram[r.i, r.j] += r.value << (_DIGIT * r.place)
    model = Whitener.of(np.triu(gram) + np.triu(gram, 1).T, min(components, size))
    kept = [f"w{c}" for c in range(len(model.values)) if model.values[c] > 0]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.project(_matrix(batch.column(0), size))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, int(w[1:])]) for w in kept], names=kept)

    error = 0.0
    if kept:
        pairs = [(a, b) for a in kept for b in kept if a <= b]
        of_fit = fit.mapInArrow(trimmed(projected), ", ".join(f"{w} double" for w in kept))
        covered = of_fit.agg(*(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
        error = max(abs(covered[f"{a}_{b}"] - (a == b)) for a, b in pairs)
    explained = [float(v) / model.trace if model.trace else 0.0 for v in model.values]
    count = len(model.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            found, exact = model.project(x), model.deviations(x)
            repeat = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(len(x)), count)))
            flat = found.reshape(-1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(flat), model.n, np.int64)),
                repeat([v if v <= _LONG else None for v in exact], pa.int64()),
                pa.array(flat, mask=np.isnan(flat)),
                pa.array(np.tile(explained, len(x)), pa.float64()),
                pa.array(np.full(len(flat), error)),
                repeat([str(v) for v in exact], pa.string()),
            ], names=[field.split()[0] for field in schema.split(", ")])

    return ints.mapInArrow(trimmed(rows), schema)
