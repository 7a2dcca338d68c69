"""Whitening of embeddings by shifted CholeskyQR over a table of vectors.

Entries become whole numbers, so counts and sums are exact. Each pass is one job: every task multiplies its
centred rows through the inverses of the triangular factors found so far and adds up their Gram matrix, Spark
sums those of all tasks, and the driver factors one matrix of dimensions x dimensions. The first factor is taken
with a shift that keeps it positive definite however alike the dimensions are; passes go on until the rows are
orthogonal to rounding. The composed factors' singular values and right vectors are those of the rows.

What reaches the driver are matrices of dimensions x dimensions; rows stay where they are.

Defined cases: rows whose vector is null, or holds a null, a NaN, an infinity or an entry of 2**40 or more in size
(for which sums could leave exact numbers) are dropped, as are those of another length than most (of lengths
equally common the greatest counts); null and repeated ids, and repeated vectors, are rows of their own and all
count; a direction without spread is no component, so vectors that are all equal, or no vectors, give no rows; a
deviation beyond 64 bits is null; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimful.llm.common import discard, written

SCALE, OFFSET = 64, 1_000_000
TOO_LARGE = 2.0**40
MOST_COMPONENTS = 32
MOST_PASSES = 5
#: Singular values below this share of the greatest are no spread.
NO_SPREAD = 1e-10

Rows = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fitted whole vectors; the components as columns, by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total_variance: float


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that count."""
    entries = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & (F.size(entries) > 0) & F.forall(entries, lambda c: F.coalesce(F.abs(c) < TOO_LARGE, F.lit(False)) & ~F.isnan(c))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return rows.where(F.size("x") == lengths[0]["length"]) if lengths else rows


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("x"), np.int64)
                part = [int(s) for s in (x.sum(axis=0) if len(x) < 1 << 16 else x.astype(object).sum(axis=0))]
                n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if sums:
            ordered = pa.array(range(len(sums)), pa.int32())
            yield pa.RecordBatch.from_arrays([ordered, pa.array([n] * len(sums), pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["dimension", "n", "total"])

    found = rows.select("x").mapInArrow(run, "dimension int, n long, total decimal(38,0)").groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dimension").collect()
    return (int(found[0]["n"]) if found else 0), [int(r["total"]) for r in found]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: of 64 bits where they suffice, of Python's whole numbers else."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(n: int, sums: list[int]) -> Rows:
    return lambda x: deviations(x, n, sums).astype(np.float64) / n


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular matrix, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def gram(rows: DataFrame, column: str, kind: type, prepared: Rows) -> np.ndarray:
    """The sum over all rows of each prepared row's outer product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                y = prepared(matrix(batch.column(0), kind))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], ["i", "line"])

    lines = rows.select(column).mapInArrow(run, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "part"))
    cells = lines.where("j >= i").groupBy("i", "j").agg(F.sum("part").alias("cell")).collect()
    size = max((r["i"] for r in cells), default=-1) + 1
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["cell"]
    return out


def factor(products: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix of n rows, with a shift where asked for or needed."""
    d = len(products)
    shift = 11 * (n * d + d * (d + 1)) * 2.0**-53 * max(np.linalg.norm(products, 2), np.finfo(float).tiny)
    for s in ([] if shifted else [0.0]) + [shift * 4.0**k for k in range(32)]:
        try:
            return np.linalg.cholesky(products + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    raise ArithmeticError("the Gram matrix has no factor")


def fit(rows: DataFrame, most: int = MOST_COMPONENTS) -> Whitening | None:
    """From (x array<long>) of whole(); None where nothing spreads. Reads rows once for each pass."""
    n, sums = exact_sums(rows)
    if not n:
        return None
    factors: list[np.ndarray] = []
    start = centred(n, sums)

    def orthogonalised(x: np.ndarray) -> np.ndarray:
        y = start(x)
        for upper in factors:
            y = solved(y, upper)
        return y

    products = gram(rows, "x", np.int64, orthogonalised)
    if not np.trace(products) > 0:
        return None
    while len(factors) < MOST_PASSES and np.abs(products - np.eye(len(products))).max() > 1e-13 * len(products):
        factors.append(factor(products, n, shifted=not factors))
        products = gram(rows, "x", np.int64, orthogonalised)

    # What is left of the last Gram matrix (the identity but for rounding and directions without spread) goes in front.
    values, vectors = np.linalg.eigh(products)
    composed = np.sqrt(np.clip(values, 0, None))[:, None] * vectors.T
    for upper in reversed(factors):
        composed = composed @ upper
    _, spread, right = np.linalg.svd(composed)
    kept = int((spread > NO_SPREAD * spread[0]).sum())
    variances = spread**2 / n
    return Whitening(n, sums, right[: min(kept, most)].T.copy(), variances[: min(kept, most)], float(variances.sum()))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation long, whitened array<double>) of rows (vec_id, x); deviation is the exact sum of (n * x - sums) ** 2."""
    n, sums = model.n, model.sums
    scaled = model.components / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                apart = deviations(matrix(batch.column("x"), np.int64), n, sums)
                wide = apart.dtype == object or int(np.abs(apart).max()) ** 2 * apart.shape[1] >= 1 << 62
                squares = [s if s < 1 << 63 else None for s in (apart.astype(object) ** 2).sum(axis=1)] if wide else (apart**2).sum(axis=1)
                white = (apart.astype(np.float64) / n) @ scaled
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(squares, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int) -> float:
    """The largest absolute entry of the covariance of `whitened` minus the identity."""
    means = white.select(F.posexplode("whitened").alias("k", "w")).groupBy("k").agg(F.avg("w").alias("mean")).orderBy("k").collect()
    mean = np.array([r["mean"] for r in means])
    covariance = gram(white, "whitened", np.float64, lambda w: w - mean) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each vector and component."""
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(whole(vectors, id_col, vector_col), "whole-vectors")
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], schema)
    white = written(whiten(rows, model), "whitened")
    discard([rows])
    error = identity_error(white, model.n)
    shares = F.array(*(F.lit(float(v / model.total_variance)) for v in model.variances))
    flat = white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return flat.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
