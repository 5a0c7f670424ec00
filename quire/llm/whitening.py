"""Whitening of embeddings by matrix-free block Lanczos.

Entries c become whole numbers x = floor(64 c) + 1000000.  Their covariance V is never gathered:
the driver holds a basis and asks for V times a block of vectors, which every task answers for
its rows as Xc'(Xc B), centred before multiplying, and Spark adds the answers up by dimension.
The basis grows by the residual of each block, orthogonalised twice against all that is there;
directions that break down are replaced by random ones.  Ritz pairs count as converged when
their residuals |V y - e y| vanish in double precision.  Sums and deviations are whole numbers
of any size, and the trace of V is the sum of the deviations.

The driver holds the basis (dimensions x basis vectors) and blocks of it travel with the tasks:
both are bounded by the square of the dimension, not by the rows.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; shorter
vectors count as followed by zeros up to the longest; entries beyond 2**40 count as 2**40 (with
their sign); components without variance are left out, so that a table of no, one or equal
vectors has no rows; equal eigenvalues have any of their eigenvectors; repeated rows and rows
without an id are rows of their own; other columns are ignored; a deviation beyond a long is
given as the largest long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Residual, against the largest eigenvalue, at which a pair has converged; variances below as much a dimension are rounding.
TOLERANCE = 1e-13
#: Largest entry that is told apart, and rows that a task multiplies at once.
LARGEST, ROWS = 2.0**40, 4096
_LONG = (1 << 63) - 1


class Whitening(NamedTuple):
    """What was fitted: rows, exact sums of x, eigenvectors as columns, their eigenvalues, the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def quantised(vectors: DataFrame, name: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x): the rows without null or non-finite entries, x without the shift."""
    c = F.col(f"`{column}`").cast("array<double>")
    whole = F.transform(c, lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v)) * SCALE))
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(c.isNotNull() & fine).select(F.col(f"`{name}`").alias("id"), whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as whole numbers, filled up with zeros; `SHIFT` is not in them."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part, _matrix(part.column(part.num_columns - 1), width)


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S/n as whole parts and remainders."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in double precision: the whole part of the mean is taken off exactly."""
    whole, rest = _mean(n, sums)
    return (x - whole) - rest / n


def _shares(rows: DataFrame, width: int, columns: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of make(block), a matrix of (any number of rows, `columns`); a row a task and matrix row is shuffled."""
    names = [f"v{k}" for k in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, width):
            part = make(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(total[:, k]) for k in range(columns))], ["i", *names])

    parts = rows.select("x").mapInArrow(run, "i long, " + ", ".join(f"{v} double" for v in names))
    found = parts.groupBy("i").agg(*(F.sum(v).alias(v) for v in names)).orderBy("i").collect()  # a row a dimension
    return np.array([[r[v] for v in names] for r in found]).reshape(len(found), columns)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of x by dimension."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not width:
        return n, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x in _blocks(batches, width):
            # high and low halves, so that no sum of a block leaves a long
            high, low = (x >> 20).sum(0).tolist(), (x & 0xFFFFF).sum(0).tolist()
            total = [t + (h << 20) + v for t, h, v in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array([str(t) for t in total])], ["i", "s"])

    parts = rows.select("x").mapInArrow(run, "i long, s string")
    found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # a row a dimension
    return n, [int(r["s"]) for r in found]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over the dimensions of (n x - S)^2."""
    whole, rest = _mean(n, sums)
    off = x - whole
    reach = n * (int(np.abs(off).max(initial=0)) + 1)
    if reach * reach * max(1, x.shape[1]) <= _LONG:
        return ((off * n - rest) ** 2).sum(1).tolist()
    return ((off.astype(object) * n - rest.astype(object)) ** 2).sum(1).tolist()


def _total_deviation(rows: DataFrame, n: int, sums: list[int]) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in _blocks(batches, len(sums)):
            total += sum(_deviations(x, n, sums))
        # in parts of 60 bits: the exact total may be beyond every decimal
        parts = [total >> 60 * k & (1 << 60) - 1 for k in range(max(1, -(-total.bit_length() // 60)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.int64())], ["i", "s"])

    found = rows.select("x").mapInArrow(run, "i long, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for 60 bits
    return sum(int(r["s"]) << 60 * r["i"] for r in found)


def _orthogonal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal directions of `block` that are not in the basis; those not longer than `least` are left out."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    new = left[:, size > least]
    new = new - basis @ (basis.T @ new)
    return np.linalg.qr(new)[0] if new.shape[1] else new


def lanczos(apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, of a symmetric operator and their eigenvectors as columns.

    One call of `apply` a block.  The projection is taken from the basis and its images, which are
    kept, so that residuals are true ones and blocks put in after a breakdown need no care.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, width)
    block = np.linalg.qr(rng.standard_normal((width, wanted)))[0]
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    while True:
        image = apply(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        inner = basis.T @ images
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        ritz = basis @ vectors
        scale = max(float(np.abs(values).max(initial=0)), 1e-300)
        residuals = np.linalg.norm(images @ vectors - ritz * values, axis=0)
        room = width - basis.shape[1]
        if not room:
            return values, ritz
        block = _orthogonal(image, basis, tolerance * scale)[:, :room]
        # an invariant subspace can miss eigenvectors: it is left by random directions
        if block.shape[1] < min(wanted, room):
            fresh = rng.standard_normal((width, min(wanted, room) - block.shape[1]))
            block = np.hstack([block, _orthogonal(fresh, np.hstack([basis, block]), 1e-8)])
        elif basis.shape[1] > wanted and (residuals <= tolerance * scale).all():
            return values, ritz


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of rows from `quantised`."""
    n, sums = _sums(rows)
    if not sums:
        return Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    width = len(sums)

    def image(block: np.ndarray) -> np.ndarray:
        def share(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ block)

        return _shares(rows, width, block.shape[1], share) / n

    total = _total_deviation(rows, n, sums)
    if not total:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    values, vectors = lanczos(image, width, components)
    real = values > values[0] * width * TOLERANCE
    return Whitening(n, sums, vectors[:, real], values[real], total / n**3)


def _projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    return _centred(x, w.n, w.sums) @ (w.vectors / np.sqrt(w.values))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows, minus the identity."""
    k = len(w.values)
    if not k:
        return 0.0
    mean = _shares(rows, len(w.sums), k, lambda x: _projected(x, w).sum(0, keepdims=True)) / w.n

    def share(x: np.ndarray) -> np.ndarray:
        y = _projected(x, w) - mean
        return y.T @ y

    return float(np.abs(_shares(rows, len(w.sums), k, share) / w.n - np.eye(k)).max())


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """(id, deviation, whitened): for rows from `quantised`, with an entry for every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, len(w.sums)):
            deviation = pa.array([min(d, _LONG) for d in _deviations(x, w.n, w.sums)] if w.sums else [0] * len(x), pa.int64())
            flat = _projected(x, w) if w.sums else np.zeros((len(x), 0))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], ["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows = written(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "whitening")
    w = fitted(rows)
    error = identity_error(rows, w)
    shares = F.array(*(F.lit(float(e / w.trace)) for e in w.values)).cast("array<double>")
    each = whitened(rows, w).select("id", "deviation", F.posexplode("whitened").alias("k", "y"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
        F.col("y").alias("whitened"), F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
