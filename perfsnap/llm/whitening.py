"""Principal components of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never multiplied into a covariance. A start vector v is
sent through alternating products: u = Xv, row by row where the rows lie, and
Xᵀu, summed over the tasks; every step reads the rows once and brings one vector
of a row's width to the driver. The u are never stored: each is a combination X p
of the rows, so its p, v and Xᵀu, all as short as a row, are kept and fully
reorthogonalised. They make X V = U B with a small upper bidiagonal B, whose
singular vectors and values are the components and deviations.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsnap.llm.common import ship
from perfsnap.session import written

ship(sys.modules[__name__])

# Contract values: entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
# Whole numbers beyond this are not exact in a double.
LARGEST = 2**53
CONVERGED = 1e-14
# Share of the variance below which a direction counts as none: what rounding leaves.
NOTHING = 1e-14


def whole_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): vectors as whole numbers, without those that are null, empty or hold
    null or non-finite entries. Repeated rows stay, rows without a key too."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    large = F.raise_error(F.lit(f"an entry times {SCALE} is beyond 2^53")).cast("long")
    whole = F.transform(c, lambda v: F.when(F.abs(v) < LARGEST / SCALE, F.floor(v * SCALE) + SHIFT).otherwise(large))
    return embeddings.where(good & (F.size(vector) > 0)).select(F.col(key), whole.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal length cannot be whitened together")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """Element sums of what ``partial`` makes of the batches of each task, an array of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += partial(matrix(b.column(0)))
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, largest = 0, None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0))
            if low is None:
                low, high = np.zeros(x.shape[1], "int64"), np.zeros(x.shape[1], "int64")
            if len(low) != x.shape[1]:
                raise ValueError("vectors of unequal length cannot be whitened together")
            # two halves, so that no sum passes a long
            low, high, n = low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0), n + b.num_rows
        if n:
            yield pa.record_batch([pa.array(np.arange(len(low))), pa.array(np.full(len(low), n)), pa.array(low), pa.array(high)], names=["at", "n", "low", "high"])

    parts = rows.select("x").mapInArrow(run, "at long, n long, low long, high long")
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]).orderBy("at").collect()
    if not sums:
        return 0, []
    if len({r["n"] for r in sums}) > 1:
        raise ValueError("vectors of unequal length cannot be whitened together")
    return sums[0]["n"], [int(r["low"]) + (int(r["high"]) << 32) for r in sums]


def centring(n: int, sums: list[int]):
    """Rows minus the mean, whole part first, so that no digit of a row is lost."""
    whole = np.array([s // n for s in sums], dtype="int64")
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole) - rest


def bidiagonalise(rows: DataFrame, centre, d: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as rows, singular values, squared norm of the rows), largest first.

    At most ``d`` steps; fewer once the wanted components no longer move, which is
    looked at only where vectors are more than four times as wide as components
    are wanted. A step that finds nothing new goes on from a random direction.
    """
    random = np.random.default_rng(seed)
    norm = 0.0

    def there_and_back(q: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
        def partial(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.append(c.T @ (c @ q), (c * c).sum() if first else 0.0)

        out = summed(rows, partial, d + 1)
        return out[:-1], out[-1]

    def apart(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        if others:
            m = np.array(others)
            for _ in range(2):
                v = v - m.T @ (m @ v)
        return v

    def fresh(vs: list[np.ndarray]) -> np.ndarray:
        v = apart(random.standard_normal(d), vs)
        return v / np.linalg.norm(v)

    vs, ps, ys = [fresh([])], [], []  # v, p with u = X p, and Xᵀu
    alpha, beta = [], []
    while True:
        j = len(vs) - 1
        q = vs[j] - (beta[j - 1] * ps[j - 1] if j else 0.0)
        y, squares = there_and_back(q, j == 0)
        norm = squares if j == 0 else norm
        if ps:  # Uᵀ(Xq) = Pᵀ Xᵀ X q
            for _ in range(2):
                c = np.array(ps) @ y
                q, y = q - np.array(ps).T @ c, y - np.array(ys).T @ c
        a2 = float(q @ y)
        if a2 > NOTHING * norm:
            a = a2**0.5
            p, y = q / a, y / a
        else:
            a, p, y = 0.0, np.zeros(d), np.zeros(d)
        alpha.append(a)
        ps.append(p)
        ys.append(y)
        if len(vs) == d:
            break
        z = apart(y - a * vs[j], vs)
        b = float(np.linalg.norm(z))
        if d > 4 * wanted and len(vs) >= wanted and b > 0:
            left, values, _ = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
            if (b * np.abs(left[-1, :wanted]) <= CONVERGED * values[0]).all():
                break
        scale = max(max(alpha), 1e-300)
        if b > 1e-13 * scale:
            beta.append(b)
            v = apart(z / b, vs)
            vs.append(v / np.linalg.norm(v))
        else:
            beta.append(0.0)
            vs.append(fresh(vs))
    _, values, right = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
    return right @ np.array(vs), values, norm


def whiten(spark: SparkSession, embeddings: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): every vector
    along the ``components`` strongest principal components, each scaled to variance 1.

    ``deviation`` is the exact sum over dimensions of (n x - S)²; an error if it
    passes a long. ``explained`` is a component's share of the variance,
    ``identity_error`` how far the covariance of ``whitened`` is from the identity.
    Vectors left out: see ``whole_vectors``; of unequal length: an error. Rows
    that repeat are vectors of their own, equal vectors get equal rows. Only
    components with variance count, so vectors that are all alike, a single
    vector or an empty table give no rows. Other columns are not read.
    """
    schema = whole_vectors(embeddings, key, vector).schema
    out = f"{key} {schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(whole_vectors(embeddings, key, vector), "vectors")
    n, sums = column_sums(rows)
    if not n:
        return spark.createDataFrame([], out)
    d, centre = len(sums), centring(n, sums)
    found, values, norm = bidiagonalise(rows, centre, d, components)
    kept = [k for k in range(min(components, len(values))) if values[k] ** 2 > NOTHING * norm]
    if not kept:
        return spark.createDataFrame([], out)
    axes = found[kept].T / (values[kept] / n**0.5)
    explained = values[kept] ** 2 / norm
    k = len(kept)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ axes
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    moments = summed(rows, spread, k + k * k)
    mean = moments[:k] / n
    error = float(np.abs(moments[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    totals = np.array(sums, dtype=object)

    def deviations(x: np.ndarray) -> np.ndarray:
        reach = n * int(np.abs(x).max()) + max(abs(s) for s in sums)
        if d * reach * reach < 2**63:
            gap = n * x - totals.astype("int64")
            return (gap * gap).sum(axis=1)
        gap = np.abs(centre(x)).max() * n + 1
        if d * gap * gap * 1.0001 < 2**63 and reach < 2**63:
            gaps = n * x - totals.astype("int64")
            return (gaps * gaps).sum(axis=1)
        exact = ((n * x.astype(object) - totals) ** 2).sum(axis=1)
        if max(exact) >= 2**63:
            raise OverflowError("a deviation is beyond a long")
        return exact.astype("int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                x = matrix(b.column(1))
                m = len(x)
                whitened = centre(x) @ axes
                ids = b.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.record_batch([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(deviations(x), k)),
                    pa.array(whitened.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)
