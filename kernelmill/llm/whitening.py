"""Whitening of embeddings by components of their covariance, found by QDWH spectral divide and conquer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import dense, quantized
from .util import release, small_batches, written

#: Numbers of a piece of a sum, and groups that pieces are first added up in.
PIECE, GROUPS = 12_000, 256
#: Sums of doubles are exact below this many.
EXACT = 2**53
EPS = float(np.finfo(float).eps)


# -- the spectral divide and conquer: on one matrix, whose size is the vectors' length whatever their number --------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by dynamically weighted Halley steps: by QR at first, by solves once they are well conditioned."""
    scale = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    x, low, one = a / scale, 1e-15, np.eye(len(a))
    for _ in range(40):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        f = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        g = (f - 1) ** 2 / 4
        h = f + g - 1
        if h > 100:
            q, _ = np.linalg.qr(np.concatenate([np.sqrt(h) * x, one]))
            new = g / h * x + (f - g / h) / np.sqrt(h) * q[: len(a)] @ q[len(a) :].T
        else:
            inner = np.linalg.solve(one + h * (x.T @ x), x.T).T
            new = g / h * x + (f - g / h) * inner
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (f + g * low**2) / (1 + h * low**2))
        if moved < (5 * EPS) ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """(orthonormal basis, number of its first columns that span the eigenvalues above the shift, what is left between both parts)."""
    n = len(a)
    above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2  # the spectral projector
    k = int(round(np.trace(above)))
    if not 0 < k < n:
        return np.eye(n), k, np.inf
    start = above @ rng.standard_normal((n, k))
    for _ in range(2):  # steps of subspace iteration
        basis, _ = np.linalg.qr(start, mode="complete")
        start = above @ basis[:, :k]
    return basis, k, float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, unit eigenvectors as columns) of a symmetric matrix.

    The polar factor of v less a shift gives the projector on the eigenvalues above it; both invariant subspaces are split again
    until they have one dimension, or are multiples of the identity. The entry of largest size of a vector is positive.
    """
    rng, whole = np.random.default_rng(0), float(np.linalg.norm(v))
    values, vectors = np.empty(len(v)), np.empty_like(v, dtype=float)
    todo, done = [((v + v.T) / 2, np.eye(len(v)))], 0
    while todo:
        a, basis = todo.pop()
        n = len(a)
        if n == 0:
            continue
        diagonal = np.diag(a)
        if n == 1 or np.linalg.norm(a - diagonal.mean() * np.eye(n)) <= 4 * EPS * whole:
            values[done : done + n], vectors[:, done : done + n] = diagonal, basis
            done += n
            continue
        best = None
        # the mean of the eigenvalues always lies between two of them; the median parts more evenly
        for shift in (np.median(diagonal), diagonal.mean(), *rng.uniform(diagonal.min(), diagonal.max(), 6), *(diagonal.mean() + whole * EPS * 10.0 ** np.arange(1, 8))):
            found = _split(a, float(shift), rng)
            if best is None or found[2] < best[2]:
                best = found
            if found[2] <= 10 * EPS * whole:
                break
        q, k, left = best
        if not np.isfinite(left):  # eigenvalues that no shift tells apart in double precision
            values[done : done + n], vectors[:, done : done + n] = diagonal, basis
            done += n
            continue
        for part in (q[:, :k], q[:, k:]):
            own = part.T @ a @ part
            todo.append(((own + own.T) / 2, basis @ part))
    vectors, _ = np.linalg.qr(vectors)  # orthonormal to the last digit
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(v))]
    return values[order], vectors * np.where(largest < 0, -1.0, 1.0)


# -- sums over the vectors -------------------------------------------------------------------------------------------


def _pieces(flat: np.ndarray) -> pa.RecordBatch:
    at = range(0, len(flat), PIECE)
    part = TaskContext.get().partitionId()
    cols = [pa.array(range(len(at)), pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array([flat[a : a + PIECE].tobytes() for a in at], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["piece", "part", "data"])


_PIECES = "piece int, part int, data binary"


def _added(parts: DataFrame, kind: type) -> np.ndarray:
    """The sum of flat arrays that tasks give in pieces: in groups of tasks first, then whole. Its size is bounded by the vectors' length."""

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, kind) for x in t["data"].to_pylist()], axis=0, dtype=kind)
        return pa.table({"piece": t["piece"][:1], "part": t["part"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    grouped = parts.withColumn("part", F.pmod("part", F.lit(GROUPS))).groupBy("piece", "part").applyInArrow(add, _PIECES)
    found = {r["piece"]: np.frombuffer(r["data"], kind) for r in grouped.groupBy("piece").applyInArrow(add, _PIECES).collect()}
    return np.concatenate([np.empty(0, kind), *[found[p] for p in sorted(found)]])


@dataclass
class Whitening:
    """n vectors of x = floor(scale * entry) + shift; low: whole numbers at most the means, rest: S - n * low, so that S = n * low + rest."""

    n: int
    low: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float
    shift: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def _source(vectors: DataFrame, vector: str, *carry: str) -> DataFrame:
    small_batches(vectors.sparkSession)
    return vectors.select(F.struct(*[vectors[c] for c in carry]).alias("row") if carry else F.lit(0).alias("row"), vectors[vector].cast("array<double>").alias("v"))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> Whitening:
    """The mean and the first components of the covariance (divisor n) of all vectors without null, NaN or infinite entries.

    Two passes: sums of whole numbers, which are exact, then sums of products of x less the whole part of its mean, exact too; what is
    left of the mean is less than one. Tasks add up first, their sums are added in two levels; the driver holds one matrix. Of vectors of
    different lengths, those of the most common one are fitted (of equal counts, the longest). Components of no variance are
    left out; an empty table has none.
    """
    src = _source(vectors, vector)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for m, rows, x in dense(b.column(1)):
                own = total.setdefault(m, [0, np.zeros(m, np.int64)])
                own[0] += len(rows)
                own[1] += (quantized(x, scale) + shift).sum(axis=0)
        lens = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lens, pa.int32()), pa.array([total[m][0] for m in lens], pa.int64()), pa.array([total[m][1].tolist() for m in lens], pa.list_(pa.int64()))], names=["len", "n", "s"]
        )

    found = written(src.mapInArrow(sums, "len int, n long, s array<long>"), "whitening-sums")
    size = found.groupBy("len").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("len")).first()
    if size is None:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift)
    d, n = size["len"], size["n"]
    s = np.zeros(d, np.int64)
    for r in found.where(F.col("len") == d).select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect():
        s[r["i"]] = r["s"]
    low, rest = s // n, s % n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), np.int64)
        for b in batches:
            for m, _, x in dense(b.column(1)):
                if m == d:
                    total += _square(quantized(x, scale) + (shift - low))
        yield _pieces(total.reshape(-1))

    square = _added(src.mapInArrow(products, _PIECES), np.int64).reshape(d, d).astype(object)
    exact = n * square - np.outer(rest.astype(object), rest.astype(object))
    v = np.array([[x / (n * n) for x in row] for row in exact], float).reshape(d, d)
    values, vectors_ = eigen(v)
    keep = values[:components] > max(d, 1) * EPS * max(float(values[0]) if d else 0.0, 0.0)
    k = int(keep.sum())
    return Whitening(n, low, rest, values[:k], vectors_[:, :k], float(np.trace(v)), scale, shift)


def _square(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers, exactly: by doubles as far as they are exact, a few rows at a time where they need be."""
    most = int(np.abs(y).max(initial=0)) ** 2
    if most >= 2**62 // max(1, len(y)):
        raise ValueError("sums of products are too large for 64-bit integers")
    step = max(1, EXACT // max(most, 1))
    out = np.zeros((y.shape[1], y.shape[1]), np.int64)
    for a in range(0, len(y), step):
        z = y[a : a + step]
        out += (z.astype(float).T @ z.astype(float)).astype(np.int64) if most < EXACT else z.T @ z
    return out


def _deviations(y: np.ndarray, w: Whitening) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of each vector, exactly; y: x less w.low. None where it is beyond a 64-bit integer."""
    if not len(y):
        return []
    rest, n = int((w.rest.astype(object) ** 2).sum()), w.n
    if np.abs(y).max(initial=0) ** 2 * y.shape[1] < 2**62 and n * int(np.abs(y).max(initial=0)) * y.shape[1] < 2**62:
        squares, cross = (y * y).sum(axis=1).tolist(), (y @ w.rest).tolist()
    else:
        big = y.astype(object)
        squares, cross = (big * big).sum(axis=1).tolist(), (big @ w.rest.astype(object)).tolist()
    exact = (n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, cross))
    return [x if x < 2**63 else None for x in exact]


def whiten(vectors: DataFrame, w: Whitening, vector: str = "embedding", carry: list[str] | None = None) -> tuple[DataFrame, float | None]:
    """(struct `row` of the carried columns, deviation, whitened array of one value for each component; the identity error).

    deviation: the sum over dimensions of (n x - S)^2, exactly; null where it is beyond 64 bits. The error is the largest absolute entry of the
    covariance of the whitened values less the identity, as measured on them; null if there are none. Vectors that were not fitted (null, with
    null, NaN or infinite entries, of another length) have no row. The model is broadcast: components times length. One narrow pass.
    """
    kept = vectors.columns if carry is None else list(carry)
    src, k = _source(vectors, vector, *kept), len(w.values)
    kind = src.schema["row"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        turn = w.vectors / np.sqrt(w.values)
        for b in batches:
            for m, rows, x in dense(b.column(1)):
                if m == len(w.low) and w.n:
                    y = quantized(x, w.scale) + (w.shift - w.low)
                    z = (y - w.rest / w.n) @ turn
                    cols = [b.column(0).take(pa.array(rows)), pa.array(_deviations(y, w), pa.int64()), pa.array(z.tolist(), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "deviation", "whitened"])
        release()

    out = written(src.mapInArrow(run, f"row {kind}, deviation long, whitened array<double>"), "whitened")
    if not w.n or not k:
        return out, None

    def second(mean: np.ndarray | None):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if mean is None else k * k)
            for b in batches:
                z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += z.sum(axis=0) if mean is None else ((z - mean).T @ (z - mean)).reshape(-1)
            yield _pieces(total)

        return add

    z = out.select("whitened")
    mean = _added(z.mapInArrow(second(None), _PIECES), np.float64) / w.n
    cov = _added(z.mapInArrow(second(mean), _PIECES), np.float64).reshape(k, k) / w.n
    return out, float(np.abs(cov - np.eye(k)).max())
