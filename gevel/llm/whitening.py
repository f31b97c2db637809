"""Whitening of embeddings by their principal components, found with a randomised range finder.

A random basis, some directions wider than the components asked for, is multiplied by the covariance again and again. Each product is one pass over all rows, which are centred before they are multiplied, and its small projection (Rayleigh-Ritz) gives the components as far as the basis holds them. When their residuals say that the passes to come would not settle them, the basis is widened, in the end to all dimensions, where one pass gives all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions of the first basis beyond the components, and how much wider each next one is.
OVER, WIDER = 16, 2
#: Passes over the rows that one basis gets.
PASSES = 6
#: A component is settled when its residual is within this share of its eigenvalue's distance from the next, or within rounding of the largest eigenvalue.
SETTLED, ROUNDING = 1e-10, 1e-14
#: Eigenvalues within this share of the trace are none: rows do not vary along them.
NOTHING = 1e-13
#: Numbers become steps of 1/64, counted from a million; what doubles don't count exactly is held at their end.
STEPS, FROM, FARTHEST = 64, 1_000_000, 2.0**52
#: Rows that are multiplied at once.
BLOCK = 8192


def steps(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch whose second column holds vectors: which rows have `width` finite numbers, and these rows as steps."""
    lists = batch.column(1)
    lists = lists.cast(pa.list_(lists.type.value_type)) if not pa.types.is_list(lists.type) else lists
    ends = lists.offsets.to_numpy()
    right = np.asarray(lists.is_valid()) & (np.diff(ends) == width)
    # values, not flatten(): offsets count from the start of what a sliced array shares.
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = values[ends[:-1][right][:, None] + np.arange(width)]
    finite = np.isfinite(found).all(1)
    right[np.flatnonzero(right)[~finite]] = False
    return right, np.clip(np.floor(STEPS * found[finite]), -FARTHEST, FARTHEST).astype(np.int64) + FROM


@dataclass(frozen=True)
class Centre:
    """The exact count of the rows, and of each dimension the sum and the sum of squares of its steps."""

    n: int
    sums: list[int]
    squares: list[int]
    most: int

    @property
    def trace(self) -> float:
        """Of the covariance; rounded only once."""
        return sum(self.n * q - s * s for s, q in zip(self.sums, self.squares, strict=True)) / self.n**2

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n times the distance of each number from its mean, exact; as Python's integers where 64 bits might not hold it."""
        return self.n * x - np.array(self.sums, np.int64) if 2 * self.n * self.most < 2**63 else self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.times_n(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of the squares of times_n; None where no 64 bits hold one."""
        far = self.times_n(x)
        if far.dtype == object or len(far) and len(self.sums) * int(np.abs(far).max()) ** 2 >= 2**63:
            return [s if s < 2**63 else None for s in (far.astype(object) ** 2).sum(1)]
        return (far**2).sum(1).tolist()


def width_of(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, of several the largest; 0 if there is none."""
    found = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return found["k"] if found else 0


def centre(rows: DataFrame, width: int) -> Centre | None:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, s, q = 0, 0, np.zeros(width, object), np.zeros(width, object)
        for b in batches:
            _, x = steps(b, width)
            for i in range(0, len(x), BLOCK):
                some = x[i : i + BLOCK]
                top = int(np.abs(some).max())
                wide = some if top * top * BLOCK < 2**63 else some.astype(object)
                n, most, s, q = n + len(some), max(most, top), s + wide.sum(0).astype(object), q + (wide * wide).sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"k": np.arange(width), "n": [n] * width, "most": [most] * width, "s": [str(v) for v in s], "q": [str(v) for v in q]}, pa.schema({"k": pa.int32(), "n": pa.int64(), "most": pa.int64(), "s": pa.string(), "q": pa.string()}))

    each = rows.mapInArrow(sums, "k int, n long, most long, s string, q string").groupBy("k")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = sorted(each.agg(F.sum("n").alias("n"), F.max("most").alias("most"), exact("s"), exact("q")).collect())
    return Centre(found[0]["n"], [int(r["s"]) for r in found], [int(r["q"]) for r in found], max(r["most"] for r in found)) if found else None


def summed(rows: DataFrame, width: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a matrix made of each block of rows. Each task sends one matrix, by its columns; they are added as they arrive."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            _, x = steps(b, width)
            for i in range(0, len(x), BLOCK):
                total = of(x[i : i + BLOCK]) + (0 if total is None else total)
        if total is not None:
            for k in range(shape[1]):
                yield pa.RecordBatch.from_pydict({"k": [k], "column": [total[:, k]]}, pa.schema({"k": pa.int32(), "column": pa.list_(pa.float64())}))

    columns = rows.mapInArrow(partial, "k int, column array<double>").groupBy("k").agg(Summarizer.sum(array_to_vector("column")).alias("column"))
    out = np.zeros(shape)
    for r in columns.collect():
        out[:, r["k"]] = r["column"].toArray()
    return out


def covariance_times(rows: DataFrame, width: int, middle: Centre, basis: np.ndarray) -> np.ndarray:
    """The covariance, which is never made, times a basis."""

    def product(x: np.ndarray) -> np.ndarray:
        c = middle.centred(x)
        return c.T @ (c @ basis)

    return summed(rows, width, basis.shape, product) / middle.n


def principal(times: Callable[[np.ndarray], np.ndarray], width: int, most: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric matrix that is known by its products."""
    random = np.random.default_rng(seed)
    wide = min(width, most + OVER)
    basis = np.linalg.qr(random.normal(size=(width, wide)))[0]
    while True:
        before = np.inf
        for turn in range(PASSES):
            product = times(basis)
            inner = basis.T @ product
            values, turned = np.linalg.eigh((inner + inner.T) / 2)
            values, turned = values[::-1], turned[:, ::-1]
            vectors = basis @ turned
            if wide == width:
                return values[:most], vectors[:, :most]
            apart = np.abs(np.diff(values[: most + 1]))
            gaps = np.minimum(apart, np.concatenate([[np.inf], apart[:-1]]))
            residuals = np.linalg.norm(product @ turned[:, :most] - vectors[:, :most] * values[:most], axis=0)
            excess = (residuals / np.maximum(SETTLED * gaps, ROUNDING * max(values[0], 0.0) + 1e-300)).max()
            if excess <= 1:
                return values[:most], vectors[:, :most]
            # Each pass divides the excess by about as much as the last one did.
            if turn and excess * (excess / before) ** (PASSES - 1 - turn) > 1:
                break
            before = excess
            basis = np.linalg.qr(product)[0]
        wide = min(width, wide * WIDER)
        basis = np.linalg.qr(np.concatenate([np.linalg.qr(product)[0], random.normal(size=(width, wide - basis.shape[1]))], 1))[0]


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """For each row of df and each of the up to `most` largest components: the row's whitened coordinate, with the component's share of all variance.

    All rows with a usable vector are fitted on and returned. Rows whose vector is null or holds null, NaN or infinite numbers are left out, and so are those of another length than the most frequent (of several, the longest). Numbers c become steps, floor(64 * c) + 1000000; beyond 2^52 steps they are held there. Columns: id_col; component, from 1, by falling variance; n, the rows fitted on; deviation, the exact sum of (n * x - sum of x)^2 (null where 64 bits don't hold it); whitened; explained; identity_error, the farthest that the covariance of `whitened` is from the identity, measured over all rows. Components along which rows do not vary are left out: there are fewer than `most` if the vectors are shorter or lie in fewer dimensions, and no rows if all vectors are equal, or with one row, or none. Repeated rows count as often as they occur; null ids stay null; other columns don't matter. Among equal variances the directions are one choice of many.

    df is read once for each pass. A task holds a block of rows and one matrix of the basis' shape; the driver holds a few of these, never rows.
    """
    rows = df.select(F.col(id_col), F.col(vector))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {OUT}"
    width = width_of(rows, vector)
    middle = centre(rows, width) if width else None
    if middle is None or not middle.trace > 0:
        return df.sparkSession.createDataFrame([], schema)
    trace = middle.trace
    values, vectors = principal(lambda basis: covariance_times(rows, width, middle, basis), width, min(most, width))
    held = values > NOTHING * trace
    values, onto = values[held], vectors[:, held] / np.sqrt(values[held])
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = middle.centred(x) @ onto
        return np.concatenate([w.T @ w, w.sum(0)[None]])

    seen = summed(rows, width, (k + 1, k), moments) / middle.n
    wrong = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())
    shares = values / trace

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right, x = steps(b, width)
            ids = b.column(0).filter(pa.array(right))
            for i in range(0, len(x), BLOCK):
                some = x[i : i + BLOCK]
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, middle.n)),
                        pa.array(middle.deviations(some), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array((middle.centred(some) @ onto).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, wrong)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(coordinates, schema)
