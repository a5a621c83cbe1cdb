"""Operator 13: whitening of vectors by an exact integer scatter and its eigenvectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows whose products are added up at once: with limbs of 20 bits all sums stay below 2^53, so that they are exact in doubles.
BLOCK, LIMB = 4096, 20
#: Bits of the parts in which sums of any size travel; 2^30 tasks may be added up in a bigint.
PART = 32


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their entries as doubles) by length, of the vectors that are not null and hold neither nulls nor non-finite entries."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    flat = column.flatten()  # without the entries of null lists
    values = np.asarray(flat.cast(pa.float64()).fill_null(math.nan)) if len(flat) else np.zeros(0)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:-1]
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.nonzero(sizes == size)[0]
        x = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(1)
        if good.any():
            yield rows[good], x[good]


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * c): SHIFT is left out, as it cancels in all that is centred. 64-bit where all fit, else Python's integers."""
    y = np.floor(x * SCALE)
    if np.abs(y).max(initial=0) < 2.0**53:
        return y.astype(np.int64)
    return np.array([[math.floor(SCALE * int(c)) if abs(c) >= 2.0**53 else math.floor(c * SCALE) for c in row] for row in x.tolist()], dtype=object)


def exact_scatter(y: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(sums, cross products) of rows of whole numbers as Python integers, by products of 20-bit limbs in doubles, which hold them exactly."""
    n, d = y.shape
    sums, cross = [0] * d, [[0] * d for _ in range(d)]
    if y.dtype == object or int(np.abs(y).max(initial=0)) >= 1 << 60:
        for row in y.tolist():
            for i, a in enumerate(row):
                sums[i] += a
                for j in range(i, d):
                    cross[i][j] += a * row[j]
    else:
        total = np.zeros(d, object)
        products: dict[int, np.ndarray] = {}
        for at in range(0, n, BLOCK):
            part = y[at : at + BLOCK]
            size, sign = np.abs(part), np.sign(part)
            limbs = []
            while size.any() or not limbs:
                limbs.append((sign * (size & ((1 << LIMB) - 1))).astype(np.float64))
                size >>= LIMB
            for a, p in enumerate(limbs):
                total += p.sum(0).astype(np.int64).astype(object) << (LIMB * a)
                for b, q in enumerate(limbs):
                    made = (p.T @ q).astype(np.int64).astype(object)
                    products[a + b] = products[a + b] + made if a + b in products else made
        sums = total.tolist()
        whole = sum((m * (1 << (LIMB * k)) for k, m in products.items()), np.zeros((d, d), object))
        cross = whole.tolist()
    return sums, cross


def _parts(value: int) -> Iterator[tuple[int, int]]:
    """A number as (place, signed part of PART bits)."""
    sign, rest, place = (-1, -value, 0) if value < 0 else (1, value, 0)
    while rest:
        yield place, sign * (rest & ((1 << PART) - 1))
        rest >>= PART
        place += 1


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, i, j, place, value) of a task: its number of vectors (i and j -1), sums (j -1) and cross products (i <= j), in parts."""
    held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for _, x in _vectors(batch.column(0)):
            n, d = x.shape
            sums, cross = exact_scatter(_whole(x))
            m, s, c = held.get(d, (0, np.zeros(d, object), np.zeros((d, d), object)))
            held[d] = m + n, s + np.array(sums, object), c + np.array(cross, object)
    rows = []
    for d, (n, s, c) in held.items():
        rows += [(d, -1, -1, *p) for p in _parts(n)]
        rows += [(d, i, -1, *p) for i in range(d) for p in _parts(int(s[i]))]
        rows += [(d, i, j, *p) for i in range(d) for j in range(i, d) for p in _parts(int(c[i, j]))]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["dim", "i", "j", "place", "value"])


@dataclass
class Fit:
    """Of the vectors of one length: how many, their exact sums without the shift, eigenvalues in falling order, eigenvectors as columns, shares of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    error: float | None = None


def decompose(n: int, sums: list[int], cross: list[list[int]], components: int) -> Fit:
    """The leading components of (n XtX - S St) / n^2. That is formed in whole numbers; each entry is rounded once."""
    d = len(sums)
    whole = [[n * cross[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    cov = np.array([[v / (n * n) for v in row] for row in whole])
    trace = sum(whole[i][i] for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    values = np.where(values > d * np.finfo(float).eps * max(values[0], 0), values, 0.0)  # what is left of no variance is rounding
    flip = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return Fit(n, sums, values, vectors * flip, values / trace if trace > 0 else np.zeros(len(order)))


def fit(vectors: DataFrame, components: int) -> dict[int, Fit]:
    """A fit for each length of vectors; what reaches the driver is about d^2 / 2 numbers for a length d, whatever the number of rows."""
    found = vectors.mapInArrow(lambda b: trimmed(_scatter(b)), "dim int, i int, j int, place int, value bigint").groupBy("dim", "i", "j", "place").agg(F.sum("value").alias("value"))
    n: dict[int, int] = {}
    made: dict[int, tuple[list[int], list[list[int]]]] = {}
    for r in found.collect():
        s, c = made.setdefault(r.dim, ([0] * r.dim, [[0] * r.dim for _ in range(r.dim)]))
        value = r.value << (PART * r.place)
        if r.i < 0:
            n[r.dim] = n.get(r.dim, 0) + value
        elif r.j < 0:
            s[r.i] += value
        else:
            c[r.i][r.j] += value
    return {d: decompose(n[d], s, c, components) for d, (s, c) in made.items()}


def _centred(f: Fit, x: np.ndarray) -> np.ndarray:
    """n * x - S in whole numbers; 64-bit where that holds them."""
    y = _whole(x)
    if y.dtype != object and (int(np.abs(y).max(initial=0)) + 1) * f.n < 1 << 62 and max(map(abs, f.sums)) < 1 << 62:
        return y * f.n - np.array(f.sums, np.int64)
    return y.astype(object) * f.n - np.array(f.sums, object)


def _project(f: Fit, z: np.ndarray) -> np.ndarray:
    """Whitened values; NaN for components without variance."""
    x = (z / f.n).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(f.values > 0, (x @ f.vectors) / np.sqrt(f.values), np.nan)


def _moments(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, i, j, value): sums (j -1) and second moments of whitened values, a task's rows centred on their own mean before multiplying."""
    held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for _, x in _vectors(batch.column(0)):
            f = fits[x.shape[1]]
            w = _project(f, _centred(f, x))[:, f.values > 0]
            n, mean = len(w), w.mean(0)
            c = (w - mean).T @ (w - mean)
            if x.shape[1] in held:
                m, before, old = held[x.shape[1]]
                gap = mean - before
                held[x.shape[1]] = m + n, before + gap * (n / (m + n)), old + c + np.outer(gap, gap) * (m * n / (m + n))
            else:
                held[x.shape[1]] = n, mean, c
    rows = []
    for d, (n, mean, c) in held.items():
        k = len(mean)
        rows += [(d, i, -1, float(n * mean[i])) for i in range(k)]
        rows += [(d, i, j, float(c[i, j] + n * mean[i] * mean[j])) for i in range(k) for j in range(i, k)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.float64()], strict=True)], ["dim", "i", "j", "value"])


def measure(vectors: DataFrame, fits: dict[int, Fit]) -> None:
    """Give each fit the largest absolute entry of its whitened values' covariance minus the identity, as the data have it."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)
    sums = vectors.mapInArrow(lambda b: trimmed(_moments(b, shared.value)), "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    got = {(r.dim, r.i, r.j): r.value for r in sums.collect()}
    for d, f in fits.items():
        k = int((f.values > 0).sum())
        mean = np.array([got[d, i, -1] / f.n for i in range(k)])
        f.error = max((abs(got[d, i, j] / f.n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k)), default=0.0)


def _emit(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        for rows, x in _vectors(batch.column(0)):
            f = fits[x.shape[1]]
            for at in range(0, len(rows), 512):  # so many rows become as many times the components
                z = _centred(f, x[at : at + 512])
                w = _project(f, z)
                n, k = w.shape
                big = z.astype(object) if z.dtype == object or float(np.abs(z.astype(np.float64)).max()) ** 2 * z.shape[1] >= 2.0**62 else z
                far = (big * big).sum(1).tolist()
                fits_long = [v if v < 1 << 63 else None for v in far]
                every = lambda v, kind: pa.array(v, kind).take(pa.array(np.repeat(np.arange(n), k)))
                whitened = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(rows[at : at + 512], k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, f.n, np.int64)), every(fits_long, pa.int64()),
                     whitened, pa.array(np.tile(f.explained, n)), pa.array(np.full(n * k, f.error)), every(list(map(str, far)), pa.string())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) for each usable vector and component.

    Tasks add up whole numbers: entries without the shift, which all that is centred is free of, their sums and cross products, in parts of 32 bits that Spark
    sums by place. The driver gets these alone, some d^2 / 2 numbers, forms n XtX - S St in whole numbers of any size, rounds each entry once
    and decomposes by eigh. A second pass measures the covariance of what comes out, a third writes it. Nothing is kept between passes but the fit.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; repeated rows and ids count each time; a null id stays null. Vectors of different
    length are whitened apart. Components without variance (fewer different vectors than components) have explained 0 and whitened null. deviation is null
    where a bigint cannot hold it; deviation_exact has it as digits at any size. No usable row: an empty result. Other columns are not read.
    """
    plain = rows.select(F.col(vector).alias("vector"), F.col(vec_id).alias("vec_id"))
    only = plain.select("vector")
    fits = fit(only, components)
    measure(only, fits)
    shared = rows.sparkSession.sparkContext.broadcast(fits)
    kind = dict(plain.dtypes)["vec_id"]
    return plain.mapInArrow(lambda b: trimmed(_emit(b, shared.value)), f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
