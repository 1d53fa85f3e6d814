"""Whitening of embeddings: leading eigenvectors of their covariance by a Jacobi-Davidson method without the matrix.

The covariance V is only ever applied: one distributed job multiplies the centred fit list by a few columns and back. The
driver holds the search space, a few dozen columns as long as a vector, whatever the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import drop, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
#: Bytes of one block of the fit list.
BLOCK = 4 << 20
#: Columns searched besides the wanted ones, columns at which the search space is restarted.
GUARD, WIDEST = 8, 72
#: An inner MINRES ends after INNER steps, or with its residual at CUT of what it was.
INNER, CUT = 3, 0.1
#: A residual is at double precision below this many units of rounding of the largest eigenvalue.
UNITS = 64


@dataclass
class Model:
    """What one fit found: components are rows, by falling eigenvalue; ``s`` sums the fit list, ``n`` counts it."""

    n: int
    s: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    products: int


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(256 c) of each entry, of the rows whose vector is not null, not empty and holds only finite entries."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.coalesce((F.size(v) > 0) & finite, F.lit(False)))
    return rows.select(F.col(vec_id).alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(SCALE))).alias("x"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _blocks(fit: DataFrame, dim: int) -> DataFrame:
    """(m, x): the fit list as rows of bytes, m vectors each."""
    rows = max(1, BLOCK // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            cut = [x[i : i + rows] for i in range(0, len(x), rows)]
            yield pa.RecordBatch.from_arrays([pa.array([len(c) for c in cut], pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], names=["m", "x"])

    return fit.mapInArrow(pack, "m long, x binary")


def _summed(blocks: DataFrame, dim: int, each: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """The sum over all blocks of ``each`` (a matrix of m vectors -> an array of any shape), entry by entry.

    A task adds its blocks up; the tasks' arrays are added by a grouping, so the driver receives one array.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column("x"):
                part = each(np.frombuffer(b.as_buffer(), dtype=np.int64).reshape(-1, dim))
                total = part if total is None else total + part
        if total is not None:
            flat = [str(v) for v in total.ravel()] if kind != "double" else total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(flat, pa.float64() if kind == "double" else pa.string())], names=["i", "v"])

    parts = blocks.mapInArrow(partial, "i int, v " + ("double" if kind == "double" else "string"))
    rows = parts.groupBy("i").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def _exactly(x: np.ndarray, square: bool = False) -> np.ndarray:
    """Column sums (of squares) in whole numbers, with Python's integers where 64 bits might not do."""
    most = int(max(abs(int(x.max())), abs(int(x.min()))))
    y = x if (most * most if square else most) * len(x) < 1 << 62 else x.astype(object)
    return (y * y if square else y).sum(axis=0).astype(object)


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """The columns of ``block`` made orthogonal to ``against`` and each other; those that vanish are left out."""
    kept: list[np.ndarray] = [] if against is None else list(against.T)
    first = len(kept)
    for t in block.T:
        size = np.linalg.norm(t)
        if not size > 0:
            continue
        t = t / size
        for _ in range(3):
            if kept:
                q = np.stack(kept, axis=1)
                t = t - q @ (q.T @ t)
        size = np.linalg.norm(t)
        if size > 1e-10:
            t = t / size
            if kept:
                t = t - q @ (q.T @ t)
            kept.append(t / np.linalg.norm(t))
    return np.stack(kept[first:], axis=1) if len(kept) > first else np.zeros((len(block), 0))


def corrections(apply: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, spaces: list[np.ndarray], r: np.ndarray, steps: int, cut: float) -> np.ndarray:
    """MINRES for (I - QQ')(V - theta I)(I - QQ') t = -r, one equation a column, in step, so that each step is one product.

    ``spaces`` holds each equation's Q: the locked vectors and its own Ritz vector. An equation rests once its residual is
    ``cut`` of what it was.
    """
    k = r.shape[1]

    def project(x: np.ndarray) -> np.ndarray:
        return np.stack([x[:, i] - spaces[i] @ (spaces[i].T @ x[:, i]) for i in range(k)], axis=1)

    v = project(-r)
    beta = np.linalg.norm(v, axis=0)
    start = beta.copy()
    live = beta > 0
    v = v / np.where(live, beta, 1)
    before, x = np.zeros_like(v), np.zeros_like(v)
    w, w2 = np.zeros_like(v), np.zeros_like(v)
    phi, dbar, eps, cs, sn = beta.copy(), np.zeros(k), np.zeros(k), -np.ones(k), np.zeros(k)
    beta = np.zeros(k)
    for _ in range(steps):
        if not live.any():
            break
        p = np.zeros_like(v)
        p[:, live] = apply(v[:, live])
        p = project(p - theta * v) - beta * before
        alpha = np.sum(v * p, axis=0)
        p = project(p - alpha * v)
        later = np.linalg.norm(p, axis=0)
        # One more Givens rotation of the tridiagonal problem.
        old, delta = eps, cs * dbar + sn * alpha
        gbar = sn * dbar - cs * alpha
        eps, dbar = sn * later, -cs * later
        gamma = np.hypot(gbar, later)
        safe = live & (gamma > 1e-300)
        g = np.where(safe, gamma, 1)
        cs, sn = np.where(safe, gbar / g, cs), np.where(safe, later / g, sn)
        tau, phi = cs * phi, sn * phi
        now = (v - old * w2 - delta * w) / g
        w2, w = w, now
        x = np.where(safe, x + tau * now, x)
        before, v, beta = v, p / np.where(later > 0, later, 1), later
        live = safe & (later > 1e-14 * np.abs(theta).max()) & (np.abs(phi) > cut * start)
    return x


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors as columns, residuals) of the ``wanted`` largest eigenvalues of the symmetric operator ``apply``.

    Ritz vectors are locked from the largest on, once their residual is at double precision or, being near it, no longer
    falls. Where the search space fills all dimensions the Ritz step is exact, so the loop ends whatever the spectrum.
    """
    wanted = min(wanted, dim)
    width = min(dim, wanted + GUARD)
    random = np.random.default_rng(seed)
    locked, values, residuals = np.zeros((dim, 0)), [], []
    space = orthonormal(random.standard_normal((dim, width)))
    image = apply(space)
    best, stale, scale = np.inf, 0, 0.0
    while True:
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, moved = space @ s, image @ s
        scale = max(scale, float(np.abs(theta).max()) if len(theta) else 0.0)
        if scale == 0.0:  # nothing varies
            rest = wanted - locked.shape[1]
            return np.append(values, np.zeros(rest)), np.hstack([locked, ritz[:, :rest]]), np.append(residuals, np.zeros(rest))
        r = moved - theta * ritz
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        tol = UNITS * np.finfo(float).eps * scale
        full = space.shape[1] + locked.shape[1] == dim
        stale = stale + 1 if size[0] >= best / 2 else 0
        best = min(best, size[0])
        done = 0
        while locked.shape[1] < wanted and done < len(theta) and (size[done] <= tol or (done == 0 and size[0] <= 1e-12 * scale and (stale >= 3 or full))):
            locked = np.hstack([locked, ritz[:, done : done + 1]])
            values.append(theta[done])
            residuals.append(size[done])
            done += 1
            best, stale = np.inf, 0
        if locked.shape[1] == wanted:
            return np.array(values), locked, np.array(residuals)
        ritz, moved, theta, r, size = ritz[:, done:], moved[:, done:], theta[done:], r[:, done:], size[done:]
        if full and done == 0:
            # Rounding of the images, not of the space, is what is left: take them anew.
            space = orthonormal(ritz, locked)
            image = apply(space)
            continue
        if ritz.shape[1] > WIDEST:
            ritz, moved = ritz[:, : 2 * width], moved[:, : 2 * width]
        space, image = ritz, moved
        k = min(width, len(theta))
        spaces = [np.hstack([locked, ritz[:, i : i + 1]]) for i in range(k)]
        t = corrections(apply, theta[:k], spaces, r[:, :k], INNER, CUT)
        # Random columns stand in for corrections that the space already holds.
        fresh = orthonormal(np.hstack([t, random.standard_normal((dim, k))]), np.hstack([locked, space]))[:, :k]
        if fresh.shape[1]:
            space, image = np.hstack([space, fresh]), np.hstack([image, apply(fresh)])


def fit(vectors: DataFrame, components: int = 4) -> Model | None:
    """The model of the distinct x of ``vectors`` (vec_id, x), all of one length; None where there are none."""
    spark = vectors.sparkSession
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    dim = int(first.d)
    blocks, path = written(_blocks(vectors.select("x").distinct(), dim))
    n = int(blocks.agg(F.sum("m")).first()[0])
    s = [int(v) for v in _summed(blocks, dim, _exactly, "decimal(38,0)")]
    squares = sum(int(v) for v in _summed(blocks, dim, lambda x: _exactly(x, True), "decimal(38,0)"))
    trace = float((Fraction(squares) - Fraction(sum(v * v for v in s), n)) / n)
    mean = np.array([float(Fraction(v, n)) for v in s])
    used = [0]

    def apply(q: np.ndarray) -> np.ndarray:
        used[0] += 1

        def times(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return np.array(_summed(blocks, dim, times)).reshape(dim, q.shape[1]) / n

    values, u, residuals = jacobi_davidson(apply, dim, components)
    # Directions in which nothing varies cannot be scaled to one.
    some = values > 1e-13 * trace
    values, u, residuals = values[some], u[:, some], residuals[some]
    order = np.argsort(-values, kind="stable")
    values, u, residuals = values[order], u[:, order], residuals[order]
    error = 0.0
    if len(values):
        white = u / np.sqrt(values)
        at = np.array(_summed(blocks, dim, lambda x: ((x - mean) @ white).sum(axis=0))) / n

        def spread(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ white - at
            return w.T @ w

        error = float(np.abs(np.array(_summed(blocks, dim, spread)).reshape(len(values), -1) / n - np.eye(len(values))).max())
    drop(spark, path)
    return Model(n, s, values, u.T, trace, residuals, error, used[0])


def _projected(rows: DataFrame, model: Model) -> DataFrame:
    """(vec_id, w, deviation): coordinates on the components over the root of their eigenvalues, and the exact deviation."""
    s, n, white = model.s, model.n, model.components.T / np.sqrt(model.values)
    top = max(map(abs, s))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), len(s))
            most = max(abs(int(x.max())), abs(int(x.min()))) if len(x) else 0
            fits = len(s) * (n * most + top) ** 2 < 1 << 62
            moved = (n * x - np.array(s)) if fits else n * x.astype(object) - np.array(s, dtype=object)
            deviation = (moved * moved).sum(axis=1)
            w = (moved / n).astype(np.float64) @ white
            out = [int(d) if d < 1 << 63 else None for d in deviation]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(w), pa.list_(pa.float64())), pa.array(out, pa.int64())], names=["vec_id", "w", "deviation"])

    return rows.mapInArrow(project, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, w array<double>, deviation long")


def whitened(vectors: DataFrame, components: int = 4, vec_id: str | Column = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, residual.

    Entries c become x = floor(256 c); the fit list is each distinct x once, n vectors with sums S, V its covariance (divisor
    n). Components are unit eigenvectors of V, numbered from 1 by falling eigenvalue e, of either sign; whitened is x - S/n on
    the component over sqrt(e), explained is e / trace(V), residual |Vu - eu| / e, identity_error the largest entry of the
    covariance of whitened less the identity. deviation is the exact sum of (n x - S)^2, null beyond 63 bits.

    Rows whose vector is null, empty or holds null or non-finite entries give no rows; nor do those of another length than
    most vectors (of several such lengths the longest). Directions without variance are no components, so equal vectors, one
    vector and an empty table give no rows. Equal eigenvalues give any orthonormal pair. Repeated rows and ids are kept, a
    null id stays null; other columns are not read.
    """
    x = integer_vectors(vectors, vec_id, vector)
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = x.where(F.size("x") == lengths[0].d) if lengths else x.limit(0)
    model = fit(rows, components)
    if model is None or not len(model.values):
        empty = "vec_id, 0 AS component, 0L AS n, 0L AS deviation, 0D AS whitened, 0D AS explained, 0D AS identity_error, 0D AS residual"
        return x.limit(0).selectExpr(*empty.split(", "))
    per = F.array(*(F.struct(F.lit(e / model.trace).alias("explained"), F.lit(float(r / e)).alias("residual")) for e, r in zip(map(float, model.values), model.residuals, strict=True)))
    out = _projected(rows, model).select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("w"), per.alias("p"))).alias("k", "z"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("z.w").alias("whitened"), F.col("z.p.explained").alias("explained"), F.lit(model.identity_error).alias("identity_error"), F.col("z.p.residual").alias("residual"))
