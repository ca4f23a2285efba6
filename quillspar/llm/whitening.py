"""Embedding whitening on exact integers: digit-slice GEMM for the covariance, then eigenvectors of the merged matrix.

An entry c becomes the integer x = floor(256 c), held to the range of a long. Rows whose vector is null or holds a null or
a non-finite entry are left out. Vectors shorter than the longest are continued by zeros, so every other row stays. The
fit list has each distinct x once: n vectors with sums S. All centred vectors are kept as the integers n x - S; a block of
them is cut into signed digits of DIGIT bits, the products of two digit matrices are sums below 2^53 and so exact in
float64 BLAS, and the products are put together as big integers. Tasks' matrices are added digit by digit; only the
dims x dims sum comes to the driver (memory there grows with dims^2, not with rows). Directions without variance are no
components: a table whose vectors are all alike, or an empty one, gives no rows. Null ids and repeated rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.llm.common import column, light_batches, quoted
from quillspar.session import drop_table, write_table

SCALE, COMPONENTS = 256, 4
#: Digits are below 2^(DIGIT - 1) in size: products of two, added over BLOCK rows, stay below 2^52.
DIGIT, BLOCK, BLOCK_BYTES = 20, 1 << 14, 8 << 20
#: Bits of a piece of a matrix cell on its way to the sum over tasks.
PIECE = 60


def whole(vector: Column) -> Column:
    """Whether a vector is there with all entries finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(finite(c), F.lit(False))), F.lit(False))


def integers(vector: Column, dims: int, scale: int = SCALE) -> Column:
    """The vector as integers, continued by zeros to `dims` entries."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return F.when(F.size(x) < dims, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(x)))).otherwise(x)


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Bounded tables of rows with their column x as an integer matrix."""
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dims, 1))))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            table = pa.Table.from_batches([batch.slice(at, most)])
            yield table, pc.list_flatten(column(table, "x")).to_numpy(zero_copy_only=False).reshape(-1, dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S without rounding: 64-bit integers while they suffice, else Python's."""
    far = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max((abs(s) for s in sums), default=0)
    if far < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of DIGIT bits, lowest first, as float64 matrices."""
    half, out = 1 << DIGIT - 1, []
    while not out or y.any():
        low = ((y + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
    return out


def product(y: np.ndarray) -> np.ndarray:
    """y transposed times y as a matrix of Python integers, exact for at most BLOCK rows."""
    parts, out = digits(y), np.zeros((y.shape[1], y.shape[1]), object)
    for a, left in enumerate(parts):
        for b in range(a, len(parts)):
            slice_ = (left.T @ parts[b]).astype(np.int64).astype(object) << DIGIT * (a + b)
            out += slice_ if a == b else slice_ + slice_.T
    return out


def pieces(value: int) -> list[int]:
    half, out = 1 << PIECE - 1, []
    while value or not out:
        low = ((value + half) & ((1 << PIECE) - 1)) - half
        out.append(low)
        value = (value - low) >> PIECE
    return out


def added(rows: DataFrame) -> dict[int, int]:
    """Sums by cell of rows (cell, piece, value) that tasks gave: one number a cell on the driver."""
    out: dict[int, int] = {}
    for r in rows.groupBy("cell", "piece").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect():
        out[r.cell] = out.get(r.cell, 0) + (int(r.value) << PIECE * r.piece)
    return out


_PIECES = pa.schema([("cell", pa.int64()), ("piece", pa.int32()), ("value", pa.int64())])


def _dealt(values: Iterator[int]) -> pa.RecordBatch:
    rows = [(cell, k, p) for cell, v in enumerate(values) for k, p in enumerate(pieces(int(v)))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def sums_of(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and S of the fit list; n is counted as one more cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(dims, object), 0
        for _, x in blocks(batches, dims):
            high, low = x >> 32, x & 0xFFFFFFFF
            total += (high.sum(0).astype(object) << 32) + low.sum(0).astype(object)
            seen += len(x)
        if seen:
            yield _dealt([*total, seen])

    found = added(fit.mapInArrow(run, "cell long, piece int, value long"))
    return found.get(dims, 0), [found.get(i, 0) for i in range(dims)]


def gram(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum over the fit list of the outer products of n x - S, in whole numbers."""
    dims = len(sums)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches, dims):
            part = product(centred(x, n, sums))
            total = part if total is None else total + part
        if total is not None:
            yield _dealt(total[upper])

    found = added(fit.mapInArrow(run, "cell long, piece int, value long"))
    out = np.zeros((dims, dims), object)
    out[upper] = [found.get(k, 0) for k in range(len(upper[0]))]
    return out + np.triu(out, 1).T


def _longdouble(value: Fraction) -> np.longdouble:
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


def eigen(exact: np.ndarray, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of exact / divisor, largest first.

    LAPACK's vectors are refined twice in extended precision, as rounding in them grows when eigenvalues lie close.
    """
    a = np.array([[_longdouble(Fraction(int(v), divisor)) for v in row] for row in exact], np.longdouble)
    x = np.linalg.eigh(a.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):
        short, inner = np.eye(len(a), dtype=np.longdouble) - x.T @ x, x.T @ a @ x
        values = np.diag(inner) / (1 - np.diag(short))
        gaps = values[None, :] - values[:, None]
        near = np.abs(gaps) <= 2 * (np.linalg.norm((inner - np.diag(values)).astype(np.float64), 2) + np.linalg.norm(a.astype(np.float64), 2) * np.linalg.norm(short.astype(np.float64), 2))
        x = x + x @ np.where(near, short / 2, (inner + values[None, :] * short) / np.where(near, 1, gaps))
    x = x / np.sqrt((x * x).sum(0))
    values = np.diag(x.T @ a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: the fit list's n and sums, and per component the scaled direction and its share of variance."""

    n: int
    sums: list[int]
    directions: np.ndarray  # dims x components, divided by the root of the eigenvalue
    explained: list[float]

    @property
    def dims(self) -> int:
        return len(self.sums)


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """From the written fit list (column x, each vector once)."""
    n, sums = sums_of(fit, dims)
    exact = gram(fit, n, sums)
    values, vectors = eigen(exact, n**3) if n and dims else (np.zeros(0), np.zeros((dims, 0)))
    keep = int((values > max(values.max(initial=0), 0) * dims * 1e-15).sum()) if len(values) else 0
    keep = min(keep, components)
    trace = float(Fraction(int(sum(np.diag(exact))), max(n, 1) ** 3))
    return Whitening(n, sums, vectors[:, :keep] / np.sqrt(values[:keep]), [float(v / trace) for v in values[:keep]])


def project(rows: DataFrame, model: Whitening, names: list[str]) -> DataFrame:
    """`names` of rows (which also hold x), with deviation (null beyond a long) and z, the whitened vector."""
    bound = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, x in blocks(batches, model.dims):
            y = centred(x, model.n, model.sums)
            far = int(np.abs(y).max(initial=0)) if y.size else 0
            squares = (y * y).sum(1).tolist() if far * far * model.dims <= bound else [int(v) for v in (y.astype(object) ** 2).sum(1)]
            z = (y / model.n).astype(np.float64) @ model.directions
            offsets = pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
            deviation = pa.array([v if v <= bound else None for v in squares], pa.int64())
            yield from pa.table([*(column(table, c) for c in names), deviation, listed], names=[*names, "deviation", "z"]).to_batches()

    kinds = dict(rows.dtypes)
    return rows.select(*names, "x").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "deviation long, z array<double>"]))


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, measured over the whole list."""
    k = len(model.explained)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    if not cells:
        return None
    z = project(fit, model, [])
    found = z.agg(*[F.covar_pop(z["z"][i], z["z"][j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, cells, strict=True))


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component from 1, n, deviation, whitened, explained, identity_error) for each row with a whole vector."""
    light_batches(vectors.sparkSession)
    rows = vectors.select(quoted(key).alias("key"), quoted(vector).alias("vector")).filter(whole(F.col("vector")))
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = rows.select("key", integers(F.col("vector"), dims).alias("x"))
    if dims:
        fit = write_table(rows.select("x").distinct(), "fit")
        model = fit_whitening(fit, dims, components)
        error = identity_error(fit, model)
        drop_table(fit)
    else:
        model, error = Whitening(1, [], np.zeros((0, 0)), []), None
    if not model.explained:
        return rows.filter("false").select(F.col("key").alias(key), *[F.lit(None).cast(kind).alias(c) for c, kind in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    each = project(rows, model, ["key"]).select("key", "deviation", F.posexplode("z").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, model.explained)), F.col("at") + 1)
    return each.select(F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
