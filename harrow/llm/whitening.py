"""Whitening by principal components from an exact scatter: residues modulo several primes, put together by Chinese remaindering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import materialise

#: A vector's entry c becomes the whole number floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Primes lie below this, so that a block's residues can be multiplied in doubles without loss.
PRIME_BITS = 21
#: Centred residues are below 2^20, their products below 2^40, and so many of these are added up below 2^53.
BLOCK_ROWS = 1 << 12

MOMENT_SCHEMA = pa.schema([("dim", pa.int32()), *((c, pa.int64()) for c in ("n", "low", "middle", "high", "least", "most"))])
MOMENT_DDL = "dim int, n long, low long, middle long, high long, least long, most long"
RESIDUE_SCHEMA = pa.schema([("dim", pa.int32()), ("prime", pa.int64()), ("sums", pa.binary())])
RESIDUE_DDL = "dim int, prime long, sums binary"
SCATTER_SCHEMA = pa.schema([("dim", pa.int32()), ("scatter", pa.list_(pa.string()))])
SCATTER_DDL = "dim int, scatter array<string>"
SPREAD_SCHEMA = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64()))])
SPREAD_DDL = "n long, mean array<double>, spread array<double>"
WHITE_SCHEMA = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)),
    ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
])
WHITE_DDL = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Moments:
    """Number of vectors, and each dimension's exact sum, least and largest value."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]

    @property
    def widest(self) -> int:
        """Largest |n * x - S| of any vector and dimension."""
        return max(max(self.n * b - s, s - self.n * a) for s, a, b in zip(self.sums, self.least, self.most, strict=True))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit numbers where these suffice, else Python's."""
        largest = max(abs(v) for v in (*self.least, *self.most, 1))
        if self.n * largest + max(map(abs, self.sums)) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers of its entries; vectors that are null or hold null or non-finite entries go."""
    entries = F.col("embedding").cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < F.lit(math.inf)))  # NaN is above infinity
    return vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, _whole).alias("x"))


def _whole(c: Column) -> Column:
    fits = F.abs(c) < float(1 << 62) / STEPS
    return F.when(fits, F.floor(c * STEPS).cast("long") + SHIFT).otherwise(F.raise_error(F.lit("an entry's whole number doesn't fit 64 bits")).cast("long"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, size: int = BLOCK_ROWS) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield _matrix(batch.slice(at, size), dims)


def moments(fit: DataFrame, dims: int) -> Moments:
    """Sums as three parts of 21 bits, which no number of rows below 2^42 can make overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts, least, most = 0, np.zeros((3, dims), np.int64), None, None
        for x in _blocks(batches, dims):
            n += len(x)
            parts += [(x & 0x1FFFFF).sum(0), (x >> 21 & 0x1FFFFF).sum(0), (x >> 42).sum(0)]
            least = x.min(0) if least is None else np.minimum(least, x.min(0))
            most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((np.arange(dims), np.full(dims, n), *parts, least, most), MOMENT_SCHEMA.types, strict=True)], schema=MOMENT_SCHEMA)

    sums = (F.sum(c).alias(c) for c in ("n", "low", "middle", "high"))
    rows = fit.mapInArrow(run, MOMENT_DDL).groupBy("dim").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most")).collect()
    rows.sort(key=lambda r: r.dim)
    return Moments(rows[0].n, [r.low + (r.middle << 21) + (r.high << 42) for r in rows], [r.least for r in rows], [r.most for r in rows])


def primes_above(bound: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS, as many as are needed for a product above ``bound``."""
    sieve = np.ones(1 << PRIME_BITS, dtype=bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(len(sieve)) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    chosen: list[int] = []
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if math.prod(chosen) > bound:
            return chosen
        chosen.append(p)
    raise ValueError("the sums are too large for primes of this size")


def residues(x: np.ndarray, prime: int, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S modulo a prime, as doubles from -prime / 2 to prime / 2; ``sums`` are S modulo it."""
    r = (n % prime * (x % prime) - sums) % prime
    return np.where(r > prime // 2, r - prime, r).astype(np.float64)


def remaindered(parts: dict[int, np.ndarray]) -> list[int]:
    """Whole numbers of either sign from their residues by prime; they are below half the primes' product in size."""
    product = math.prod(parts)
    found = reduce(np.add, (r.astype(object) * (product // p * pow(product // p, -1, p)) for p, r in parts.items())) % product
    return [v - product if 2 * v > product else v for v in found.tolist()]


def exact_scatter(fit: DataFrame, m: Moments) -> list[list[int]]:
    """Sums of (n * x_i - S_i) * (n * x_j - S_j) over all vectors, exact.

    For each prime a task multiplies its blocks' residues as matrices and reduces the sums; so a task gives a matrix of residues
    for each prime, whatever its rows. Tasks are at most as many as Spark's number of shuffle partitions. One group for each row of
    the matrix adds up the tasks' residues and puts the primes' sums together by Chinese remaindering.
    """
    dims = len(m.sums)
    primes = primes_above(2 * m.n * m.widest**2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = {p: np.array([s % p for s in m.sums], np.int64) for p in primes}
        scatter = {p: np.zeros((dims, dims), np.int64) for p in primes}
        for x in _blocks(batches, dims):
            for p in primes:
                r = residues(x, p, m.n, shifts[p])
                scatter[p] = (scatter[p] + (r.T @ r).astype(np.int64)) % p
        for p, sums in scatter.items():
            if sums.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array([p] * dims, pa.int64()), pa.array([row.tobytes() for row in sums], pa.binary())], schema=RESIDUE_SCHEMA)

    def together(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {p: np.zeros(dims, np.int64) for p in primes}
        for batch in batches:
            for p, sums in zip(batch.column("prime").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                parts[p] = (parts[p] + np.frombuffer(sums, np.int64)) % p
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([[str(v) for v in remaindered(parts)]], pa.list_(pa.string()))], schema=SCATTER_SCHEMA)

    few = fit.coalesce(max(1, int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = {r.dim: [int(v) for v in r.scatter] for r in few.mapInArrow(run, RESIDUE_DDL).groupBy("dim").applyInArrow(together, SCATTER_DDL).collect()}
    return [rows.get(i) or [0] * dims for i in range(dims)]


@dataclass(frozen=True)
class Whitener:
    """What whitens a vector: its moments, a column for each component (no variance: not a number), and explained shares."""

    m: Moments
    columns: np.ndarray
    explained: np.ndarray

    def __call__(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.m.n) @ self.columns


def whitener(scatter: list[list[int]], m: Moments, components: int) -> Whitener:
    """Components of the exact scatter: the covariance's entries are each rounded once, then its eigenvectors are found twice.

    The second time the covariance is turned into the first time's eigenvectors, where it is diagonal but for rounding, which
    takes the rounding out of them. A variance below what doubles can tell from none counts as none.
    """
    cube = m.n**3
    covariance = np.array([[v / cube for v in row] for row in scatter])
    _, first = np.linalg.eigh(covariance)
    turned = first.T @ covariance @ first
    _, second = np.linalg.eigh((turned + turned.T) / 2)
    vectors, _ = np.linalg.qr(first @ second)
    values = np.einsum("ij,ik,kj->j", vectors, covariance, vectors)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    trace = sum(row[i] for i, row in enumerate(scatter)) / cube
    some = values > trace * len(covariance) * np.finfo(float).eps
    columns = np.where(some, vectors / np.sqrt(np.where(some, values, 1.0)), np.nan)
    return Whitener(m, columns, np.where(some, values / (trace or 1.0), 0.0))


def identity_error(fit: DataFrame, white: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over the fit list; 0 without components."""
    kept = ~np.isnan(white.columns[0])
    dims, k = white.columns.shape[0], int(kept.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (0, np.zeros(k), np.zeros((k, k)))
        for x in _blocks(batches, dims):
            w = white(white.m.deviations(x))[:, kept]
            held = merged_spread(held, (len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((held[0], held[1].tolist(), held[2].ravel().tolist()), SPREAD_SCHEMA.types, strict=True)], schema=SPREAD_SCHEMA)

    if not k:
        return 0.0
    few = fit.coalesce(max(1, int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = [(r.n, np.array(r["mean"]), np.array(r.spread).reshape(k, k)) for r in few.mapInArrow(run, SPREAD_DDL).collect()]
    n, _, spread = reduce(merged_spread, parts)
    return float(np.abs(spread / n - np.eye(k)).max())


def merged_spread(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred products of two parts together."""
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row per usable vector and component.

    Vectors that are null or hold null, NaN or infinite entries are left out. Entries become whole numbers x; the fit list has each
    distinct vector x once, however many copies there are, and gives n and the sums S. ``deviation``: exact sum of (n * x - S)^2.
    ``whitened``: x - S / n on the component, over the root of its variance. Components are numbered from 1 by falling variance,
    equal ones in any order, at most as many as there are dimensions; one without variance has a null ``whitened`` and
    explains 0. So a single distinct vector gives nulls, and an error of 0.

    Repeated rows give their rows each; a null vec_id is kept; an empty table, or one without usable or with only empty vectors,
    gives no rows; other columns are left out. Vectors of different lengths are an error, as is an entry of 2^56 or more.

    Copies are dropped by Spark before and after the shuffle, so none is a hot key. The scatter is summed in each task and is of
    the size of the dimensions squared, as is what reaches the driver; no row does.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors)
    fit = materialise(rows.select("x").distinct(), "fit-list")
    least, most = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not most:
        return spark.createDataFrame([], WHITE_DDL)
    if least != most:
        raise ValueError(f"vectors have {least} to {most} entries")
    m = moments(fit, most)
    white = whitener(exact_scatter(fit, m), m, min(components, most))
    error = identity_error(fit, white)
    k = white.columns.shape[1]
    narrow = most * m.widest**2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                y = m.deviations(_matrix(batch, most))
                squares = np.einsum("ij,ij->i", y, y) if narrow and y.dtype != object else np.array([sum(int(v) ** 2 for v in row) for row in y], object)
                places = pa.array(np.repeat(np.arange(len(y)), k))
                whitened = white(y).ravel()
                columns = [
                    batch.column("vec_id").take(places), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(len(places), m.n), pa.int64()),
                    pa.array(list(map(Decimal, squares.tolist())), pa.decimal128(38, 0)).take(places), pa.array(whitened, pa.float64(), mask=np.isnan(whitened)),
                    pa.array(np.tile(white.explained, len(y)), pa.float64()), pa.array(np.full(len(places), error), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=WHITE_SCHEMA)

    return rows.mapInArrow(run, WHITE_DDL)
