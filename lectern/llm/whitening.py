"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The rows become integers and are centred on their exact mean.  The recurrence alternates two distributed
products, u = X v and z = X' u, in one pass over the written rows that sends home sums of the size of
a vector.  Both families of Lanczos vectors are reorthogonalised in full, twice: the right ones on
the driver, the left ones by z' v for the older z and by the dot products measured in the pass.  A
left vector has one entry per row of the table; it is kept as u = X w, so what is stored and sent is
w, one number per dimension.  The singular vectors of the small bidiagonal matrix give the components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import Scratch

#: x = floor(SCALE * c) + SHIFT; the shift cancels in every result.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no exact integer form.
TOO_LARGE = 2.0**53 / SCALE
#: Relative to the norm of the rows: a vector this short has broken off; a triplet this close stands.
_TINY, _STANDS = 1e-13, 1e-15


@dataclass
class Whitening:
    """What a fit leaves: exact counts and sums, components as columns by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def basis(self) -> np.ndarray:
        """Dimension x component; centred rows times this are white."""
        return self.vectors / np.sqrt(self.values)


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, f): f = floor(SCALE * c) of the vectors that can be whitened."""
    c = F.col(vector_col).cast("array<double>")
    fit = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < TOO_LARGE))
    whole = F.transform(c, lambda e: F.floor(e * SCALE).cast("long"))
    return vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(fit).select(
        F.col(id_col).alias("id"), whole.alias("f"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums_over(rows: DataFrame, width: int, partial) -> np.ndarray:
    """Sum of ``partial(matrix)`` (a vector) over all rows: one small vector per task, added up in Spark."""

    def add(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + partial(_matrix(batch, width))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({"pos": np.arange(len(total), dtype=np.int32), "value": total})

    parts = rows.select("f").mapInArrow(add, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    got = sorted(parts.collect())  # as many rows as the vector has entries
    return np.array([r["value"] for r in got])


def bidiagonalise(rows: DataFrame, mean: np.ndarray, norm: float, count: int, seed: int = 7):
    """Lanczos vectors (right ones as columns), diagonals and superdiagonals, until ``count`` triplets stand.

    Stops once the first ``count`` residuals are at rounding level or the space is used up.  Where an
    invariant subspace ends early a new start orthogonal to it goes on with a zero between.
    """
    d = len(mean)
    random = np.random.default_rng(seed)
    right, left, turned, alphas, betas = [], [], [], [], []

    def fresh():
        v = random.standard_normal(d)
        for _ in range(2):
            for q in right:
                v = v - (q @ v) * q
        return v / np.linalg.norm(v)

    v = fresh()
    while True:
        right.append(v)
        known, back = np.array(left).reshape(-1, d).T, np.array(turned).reshape(-1, d).T  # W and X'XW, d x k
        w = v - known @ (back.T @ v)  # the dot products of X v with the left vectors are v' X' u

        def alternate(x, w=w, known=known):
            centred = x - mean
            u = centred @ w
            return np.concatenate([[u @ u], centred.T @ u, (centred @ known).T @ u])

        got = sums_over(rows, d, alternate)
        alpha = np.sqrt(max(got[0], 0.0))
        if alpha <= _TINY * norm:  # X v lies in the span of the left vectors already
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            rest = got[1 + d:]  # what is left of the other left vectors, as found in the rows
            w, z = (w - known @ rest) / alpha, (got[1:1 + d] - back @ rest) / alpha
        alphas.append(alpha)
        left.append(w)
        turned.append(z)
        for _ in range(2):
            for q in right:
                z = z - (q @ z) * q
        beta = np.linalg.norm(z)
        if len(right) == d:
            break
        if beta <= _TINY * norm:
            beta, v = 0.0, fresh()
        else:
            v = z / beta
            small = np.diag(alphas) + np.diag(betas, 1)
            p, _, _ = np.linalg.svd(small)
            if len(right) >= count and np.all(beta * np.abs(p[-1, :count]) <= _STANDS * norm):
                break
        betas.append(beta)
    return np.array(right).T, np.array(alphas), np.array(betas)


def fit_whitening(rows: DataFrame, count: int) -> Whitening | None:
    """Mean and the first ``count`` components of integer rows; None without rows.

    Components without variance (their eigenvalue is at rounding level) are left out.
    """
    exact = rows.select(F.posexplode("f").alias("pos", "f")).groupBy("pos").agg(
        F.sum(F.col("f").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()  # a row per dimension
    if not exact:
        return None
    exact.sort(key=lambda r: r["pos"])
    n, sums = exact[0]["n"], [int(r["s"]) for r in exact]
    mean = np.array([s / n for s in sums])
    square = float(sums_over(rows, len(sums), lambda x: np.array([np.square(x - mean).sum()]))[0])
    if square == 0.0:
        return Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    right, alphas, betas = bidiagonalise(rows, mean, np.sqrt(square), min(count, len(sums)))
    _, sigma, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1))
    values = np.square(sigma) / n
    held = min(count, int((values > (_TINY * 100) * square / n).sum()))
    vectors = right @ turned.T[:, :held]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return Whitening(n, sums, values[:held], vectors, square / n)


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), centred first."""
    d, k, n, mean, basis = len(fitted.sums), len(fitted.values), fitted.n, fitted.mean, fitted.basis
    centre = sums_over(rows, d, lambda x: ((x - mean) @ basis).sum(axis=0)) / n

    def products(x):
        y = (x - mean) @ basis - centre
        return (y.T @ y).ravel()

    return float(np.abs(sums_over(rows, d, products).reshape(k, k) / n - np.eye(k)).max())


def deviations(f: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; None beyond 63 bits.  The shift of x cancels."""
    rough = np.square(n * f.astype(np.float64) - np.array(sums, dtype=np.float64)).sum(axis=1)
    large = n * float(np.abs(f).max(initial=0)) + max(abs(s) for s in sums)
    if large < 2**62 and (rough < 2**61).all():
        return np.square(n * f - np.array(sums, dtype=np.int64)).sum(axis=1).tolist()
    exact = [sum((n * int(e) - s) ** 2 for e, s in zip(row, sums)) for row in f]
    return [e if e < 2**63 else None for e in exact]


def whiten(
    vectors: DataFrame, count: int = 32, id_col: str = "vec_id", vector_col: str = "embedding",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Left out are vectors that are null or empty or hold a null, non-finite or huge (2^47 and more)
    entry, and vectors shorter than the longest, which lack entries.  Components without variance
    are left out: with fewer than ``count`` dimensions of variance there are fewer.  Repeated rows count
    and come back as often as they occur, ids may be null.  Other columns are not read.  An empty
    table gives an empty result.  ``deviation`` is null where it passes 63 bits.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "whiten")
    found = integer_rows(vectors, id_col, vector_col)
    every = scratch.keep(found, "all")
    width = every.agg(F.max(F.size("f"))).first()[0] or 0
    rows = every.filter(F.size("f") == width)
    fitted = fit_whitening(rows, count)
    held = 0 if fitted is None else len(fitted.values)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not held:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(rows, fitted)
    n, sums, mean, basis = fitted.n, fitted.sums, fitted.mean, fitted.basis

    def project(batches):
        for batch in batches:
            f = _matrix(batch, width)
            white = (f - mean) @ basis
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(deviations(f, n, sums), pa.int64()),
                pa.FixedSizeListArray.from_arrays(white.ravel(), held).cast(pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "white"])

    told = rows.mapInArrow(project, f"vec_id {kind}, deviation long, white array<double>")
    explained = F.array(*[F.lit(float(e) / fitted.trace) for e in fitted.values])
    return told.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
