"""Whitening of embeddings from exact polarised covariances.

A component c counts as the whole number x = floor(scale * c) + offset. The fit
list holds each distinct vector of these once. Two passes over it add whole
numbers only: first the number of vectors and the sum of each dimension, then,
with z = x less the whole number next to its mean, the squares of z for every
dimension and of the sum of two z for every pair of dimensions. What the whole
number next to the mean leaves of the centring, less than one half, is made good
exactly. Polarisation then gives every covariance without a product of two
dimensions: 2 cov(i, j) = var(i + j) - var(i) - var(j). Rounding begins when the
finished fractions are put together as a matrix for ``eigh``.

Each task adds its rows to one sum for each dimension or pair; the driver gets
one number for each. Sums are Python's whole numbers where 64 bits might not do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keep

LONG = 1 << 63
# Whole numbers up to here are vectors; beyond, floor(scale * c) + offset would not be a long.
LARGEST = float(1 << 62)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _fits(rows: int, largest: int) -> bool:
    """Whether ``rows`` squares of sums of two numbers up to ``largest`` can be added in 64 bits."""
    return rows * (2 * largest + 1) ** 2 < LONG


def _exact(values: np.ndarray, subtract: list[int]) -> np.ndarray:
    """``values`` less one number for each column, as Python's whole numbers where 64 bits might not do for their squares' sum."""
    high = max([abs(int(values.max(initial=0))), abs(int(values.min(initial=0)))]) + max(map(abs, subtract), default=0)
    if high < LONG:
        centred = values - np.array(subtract, np.int64)
        if _fits(len(values), int(np.abs(centred).max(initial=0))):
            return centred
    return values.astype(object) - np.array(subtract, object)


def _added(df: DataFrame, width: int, sums: Callable[[np.ndarray], list[int]], column: str = "x") -> list[int]:
    """Exact sums over all rows: each task adds its batches, Spark adds the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch.column(column), width))
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int32()), "value": [str(v) for v in total]})

    parts = df.select(column).mapInArrow(run, "place int, value string")
    rows = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).orderBy("place").collect()
    return [int(r.value) for r in rows]


def polarised_covariance(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, C) of the vectors ``x``: the covariance of dimensions i and j, with divisor n, is C[i][j] / n^3.

    C[i][j] is the sum of (n x_i - S_i) (n x_j - S_j) over all vectors, a whole number.
    """

    def plain(x: np.ndarray) -> list[int]:
        values = x if _fits(len(x), int(np.abs(x).max(initial=0))) else x.astype(object)
        return [len(x), *map(int, values.sum(axis=0))]

    n, *sums = _added(fit, width, plain) or [0] * (width + 1)
    if not n:
        return 0, sums, []
    means = [(2 * s + n) // (2 * n) for s in sums]
    rest = [n * m - s for m, s in zip(means, sums, strict=True)]

    def squares(x: np.ndarray) -> list[int]:
        z = _exact(x, means)
        out = []
        for i in range(width):
            pair = z[:, i:] + z[:, i : i + 1]
            out += map(int, (pair * pair).sum(axis=0))
        return out

    added = iter(_added(fit, width, squares))
    # The sum of (n (z_i + z_j) + r_i + r_j)^2; as n z + r adds up to 0, the mixed terms together are -n (r_i + r_j)^2.
    pair_squares = [[0] * width for _ in range(width)]
    for i in range(width):
        for j in range(i, width):
            pair_squares[i][j] = pair_squares[j][i] = n * n * next(added) - n * (rest[i] + rest[j]) ** 2
    # On the diagonal the pair is 2 z_i, so its sum of squares is four times the dimension's own.
    own = [pair_squares[i][i] // 4 for i in range(width)]
    both = [
        [own[i] if i == j else (pair_squares[i][j] - own[i] - own[j]) // 2 for j in range(width)] for i in range(width)
    ]
    return n, sums, both


@dataclass
class Components:
    """Unit eigenvectors (columns) by falling eigenvalue."""

    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def components(n: int, both: list[list[int]], most: int) -> Components:
    """The leading components of the covariance ``both`` / n^3; those without variance are left out.

    Eigenvalues are taken anew from the exact fractions as the variance along each eigenvector, so that small ones beside
    large ones are right too.
    """
    width = len(both)
    matrix = np.array([[v / n**3 for v in row] for row in both], float).reshape(width, width)
    values, vectors = np.linalg.eigh(matrix)
    trace = sum(both[i][i] for i in range(width))
    floor = max(values, default=0.0) * width * np.finfo(float).eps
    kept = [k for k in range(width - 1, -1, -1) if values[k] > floor][:most]
    refined = []
    for k in kept:
        v = [int(round(c)) for c in np.ldexp(vectors[:, k], 60).tolist()]
        along = sum(a * sum(b * c for b, c in zip(row, v, strict=True)) for a, row in zip(v, both, strict=True))
        refined.append((along, sum(a * a for a in v), k))
    refined.sort(key=lambda r: r[0] / r[1], reverse=True)
    return Components(
        vectors[:, [k for *_, k in refined]],
        np.array([along / (length * n**3) for along, length, _ in refined]),
        np.array([along / (length * trace) for along, length, _ in refined]),
    )


def _projector(n: int, sums: list[int], found: Components) -> Callable[[np.ndarray], np.ndarray]:
    """Whitened components of rows of ``x``; x - S / n is formed from a whole part and a fraction, without rounding x."""
    means = [s // n for s in sums]
    fractions = np.array([(s - n * m) / n for s, m in zip(sums, means, strict=True)])
    scaled = found.vectors / np.sqrt(found.values)
    return lambda x: (_exact(x, means).astype(float) - fractions) @ scaled


def _identity_error(fit: DataFrame, width: int, n: int, project: Callable[[np.ndarray], np.ndarray], count: int) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count))
        for batch in batches:
            if batch.num_rows:
                white = project(_matrix(batch.column("x"), width))
                total[:count] += white.T @ white
                total[count] += white.sum(axis=0)
        flat = total.ravel()
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(flat)), pa.int32()), "value": flat})

    parts = fit.select("x").mapInArrow(run, "place int, value double")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    total = np.array([r.value for r in rows]).reshape(count + 1, count) / n
    mean = total[count]
    return float(np.abs(total[:count] - np.outer(mean, mean) - np.eye(count)).max())


def whiten(
    vectors: DataFrame,
    most: int = 16,
    *,
    scale: int = 64,
    offset: int = 1_000_000,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Whitened leading components of every vector, with the fit's own figures.

    Returns ``key``, component (from 1), n (vectors in the fit list), deviation (the sum over dimensions of (n x - S)^2,
    decimal), whitened, explained (a component's part of all variance) and identity_error (one value).

    Rows whose vector is null or has a null or non-finite component are left out; a null key is kept. Repeated and equal
    vectors count once in the fit and each gets its rows. Vectors of each length are a fit of their own. Components without
    variance are left out, so a single vector, equal vectors, empty vectors and no rows give no rows. A component whose whole
    number is beyond 2^62 ends the job with an error. Other columns are not read.
    """

    def scaled(c: Column) -> Column:
        return c.cast("double") * F.lit(float(scale))

    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    large = F.raise_error(F.lit("whiten: a component is too large for a whole number of 64 bits")).cast("long")
    whole = F.transform(
        vector, lambda c: F.when(F.abs(scaled(c)) < F.lit(LARGEST), F.floor(scaled(c)) + F.lit(offset)).otherwise(large)
    )
    valid = vectors.filter(F.col(vector).isNotNull()).filter(finite)
    rows = keep(valid.select(F.col(key).alias("id"), whole.alias("x"), F.size(vector).alias("width")), "whole-vectors")
    out = None
    for width in sorted(r.width for r in rows.filter("width > 0").select("width").distinct().collect()):
        own = rows.filter(F.col("width") == width)
        part = _whitened(own, width, most).withColumnRenamed("id", key)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return _none(rows).withColumnRenamed("id", key)
    return out


def _none(rows: DataFrame) -> DataFrame:
    empty = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
    return rows.select("id", *(F.lit(None).cast(t).alias(c) for c, t in empty.items())).limit(0)


def _whitened(rows: DataFrame, width: int, most: int) -> DataFrame:
    fit = keep(rows.select("x").distinct(), "fit-list")
    n, sums, both = polarised_covariance(fit, width)
    found = components(n, both, most)
    count = len(found.values)
    if not count:
        return _none(rows)
    project = _projector(n, sums, found)
    error = _identity_error(fit, width, n, project, count)
    means = [s // n for s in sums]
    rest = [n * m - s for m, s in zip(means, sums, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), width)
            z = _exact(x, means)
            if not _fits(width, n * (int(np.abs(z).max()) + 1)):
                z = z.astype(object)
            centred = z * n + np.array(rest, z.dtype)
            deviation = [str(v) for v in (centred * centred).sum(axis=1)]
            again = np.repeat(np.arange(batch.num_rows), count)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").take(pa.array(again)),
                    "component": pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()),
                    "deviation": pa.array(deviation).take(pa.array(again)),
                    "whitened": project(x).ravel(),
                }
            )

    kind = rows.schema["id"].dataType.simpleString()
    done = rows.select("id", "x").mapInArrow(run, f"id {kind}, component int, deviation string, whitened double")
    shares = F.array(*(F.lit(float(e)) for e in found.explained))
    return done.select(
        "id",
        "component",
        F.lit(n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
