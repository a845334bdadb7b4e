"""Embedding whitening by FEAST contour integration.

Vectors become whole numbers x = floor(256 * c). The fit list has each distinct x once; it is made by one shuffle of packed
vectors, equal ones merged before. Its sums, its covariance (centred before multiplying) and the check of the result
are sums of one small matrix a task, added up by cell. Only matrices of (dimensions x dimensions) reach the driver.

There the largest eigenvalues are found by FEAST. Inertia counts (the signs of the pivots of a symmetric factorisation of
V - aI say how many eigenvalues lie above a) bisect the axis until an interval holds the wanted ones. In that interval a
contour integral of (zI - V)^-1 Y, by Gauss-Legendre quadrature of complex shifted solves, projects a block of vectors onto the
interval's eigenvectors; Rayleigh-Ritz on the projected block gives pairs, and the two steps repeat until the residuals are
at the level of rounding. The number of pairs in the interval must equal the inertia count, or the work starts again with a
larger block; so none is missed.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out; so are rows whose length is not
the one that most rows have (ties: the shorter). Entries beyond +-2**52 (after scaling) count as that bound. Components with
no variance (an eigenvalue that rounding can't tell from 0) can't be whitened and are left out; with none left the result is
empty. Equal eigenvalues: any orthonormal basis of their space, the same for all rows. ``deviation`` is null where it
exceeds a long. Repeated rows and null ids each get their rows; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

COMPONENTS = 4
SCALE = 256
NODES = 8  # of the quadrature, on half of the circle
ROUNDS = 40
BATCH = 1024
_MOST = float(1 << 52)


# ---- vectors as whole numbers


def _whole(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(SCALE * values.astype(np.float64), -_MOST, _MOST)).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """The vector in the least of 2, 4 or 8 bytes an entry; equal vectors have equal bytes."""
    top = max(-int(x.min()), int(x.max()) + 1)
    return x.astype("<i2" if top <= 1 << 15 else "<i4" if top <= 1 << 31 else "<i8").tobytes()


def _matrix(packed: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(packed), d), np.int64)
    for k, p in enumerate(packed):
        out[k] = np.frombuffer(p, f"<i{len(p) // d}")
    return out


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, d, x): the usable rows, vectors packed."""
    rows = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    rows = rows.filter(F.forall("v", lambda c: F.coalesce((c >= F.lit(-1.7976931348623157e308)) & (c <= F.lit(1.7976931348623157e308)), F.lit(False))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = _whole(lists.flatten().to_numpy(zero_copy_only=False)), lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            x = [_packed(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(x, pa.binary())], ["vec_id", "d", "x"])

    return rows.mapInArrow(work, "vec_id bigint, d int, x binary")


# ---- sums over the fit list


def _summed(fit: DataFrame, f, width: int) -> np.ndarray:
    """The sum of f(packed vectors) (a matrix of so many columns) over batches of the fit list: a matrix a task, then rows of it are added up by
    their number, and by slot before so that no task gets a row of every task."""

    def one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = f(batch.column(0).slice(k, BATCH).to_pylist())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "v"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(v.as_py()) for v in table.column("v"))
        return pa.table({"slot": pa.array([0], pa.int32()), "i": pa.array([key[-1].as_py()], pa.int32()), "v": pa.array([whole.tobytes()], pa.binary())})

    rows = fit.select("x").mapInArrow(one_each, "i int, v binary").select(F.pmod(F.spark_partition_id(), F.lit(64)).alias("slot"), "i", "v")
    for by in (["slot", "i"], ["i"]):
        rows = rows.groupBy(*by).applyInArrow(added, "slot int, i int, v binary")
    found = {r.i: np.frombuffer(r.v) for r in rows.select("i", "v").collect()}
    return np.stack([found[i] for i in sorted(found)]) if found else np.zeros((0, width))


def fit_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The length of the fit list and its exact sums by dimension: numbers too large for a long are added up as two halves."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = _matrix(batch.column(0).slice(k, BATCH).to_pylist(), d)
                n += len(part)
                total = [t + int(s) for t, s in zip(total, part.sum(axis=0), strict=True)]
        rows = [(-1, n), *enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([s >> 32 for _, s in rows], pa.int64()), pa.array([s & 0xFFFFFFFF for _, s in rows], pa.int64())], ["i", "high", "low"])

    rows = fit.select("x").mapInArrow(halves, "i int, high bigint, low bigint").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = {r.i: (r.high << 32) + r.low for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    d, mean = len(sums), np.array([s / n for s in sums])

    def products(packed: list[bytes]) -> np.ndarray:
        centred = _matrix(packed, d) - mean
        return centred.T @ centred

    v = _summed(fit, products, d) / n
    return (v + v.T) / 2


# ---- FEAST


def inertia_above(v: np.ndarray, a: float) -> int:
    """How many eigenvalues of the symmetric matrix v lie above a: positive pivots of v - aI = P L D L' P', where D has pivots of one and of two rows
    (complete pivoting: growth is bounded, and the signs are those of the eigenvalues)."""
    m = v - a * np.eye(len(v))
    above, edge = 0, (1 + math.sqrt(17)) / 8
    while len(m):
        if len(m) == 1:
            return above + int(m[0, 0] > 0)
        diagonal = np.abs(np.diag(m))
        k, off = int(diagonal.argmax()), np.abs(m - np.diag(np.diag(m)))
        i, j = np.unravel_index(off.argmax(), off.shape)
        if diagonal[k] == 0 and off[i, j] == 0:
            return above
        pivot = [k] if diagonal[k] >= edge * off[i, j] else [int(i), int(j)]
        block = m[np.ix_(pivot, pivot)]
        above += int(block[0, 0] > 0) if len(pivot) == 1 else 1  # a block of two has one sign of each
        rest = np.delete(np.arange(len(m)), pivot)
        side = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        m = (m + m.T) / 2
    return above


def contour(v: np.ndarray, low: float, high: float, y: np.ndarray) -> np.ndarray:
    """The spectral projection of y for the interval, by quadrature over the circle on it: the lower half adds the conjugate."""
    node, weight = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for t, w in zip(node, weight, strict=True):
        turn = np.exp(1j * math.pi / 2 * (1 - t))
        z = centre + radius * turn
        out += (w / 2 * (radius * turn * np.linalg.solve(z * np.eye(len(v)) - v, y.astype(complex)))).real
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs of v in the interval, by falling eigenvalue. count: what inertia says."""
    d, size = len(v), min(len(v), count + max(3, count // 2))
    scale = max(np.abs(v).sum(axis=1).max(), np.finfo(float).tiny)
    while True:
        y = np.random.default_rng(seed).normal(size=(d, size))
        values, vectors, inside, best = np.zeros(0), y, np.zeros(0, bool), math.inf
        for _ in range(ROUNDS):
            q, r = np.linalg.qr(contour(v, low, high, vectors))
            values, turn = np.linalg.eigh(q.T @ v @ q)
            vectors = q @ turn
            residual = np.linalg.norm(v @ vectors - vectors * values, axis=0)
            inside = (values > low) & (values <= high) & (residual < 1e-6 * scale)
            worst = residual[inside].max(initial=0.0) if inside.sum() == count else math.inf
            if worst <= 1e-15 * scale or best < 1e-12 * scale and worst >= best / 2:
                break
            best = min(best, worst)
        if inside.sum() == count and worst < (1e-13 if size < d else 1e-10) * scale:
            order = np.argsort(-values[inside], kind="stable")
            return values[inside][order], vectors[:, inside][:, order]
        if size == d:
            raise ArithmeticError(f"{int(inside.sum())} pairs in ({low}, {high}], {count} by inertia")
        size, seed = min(d, 2 * size), seed + 1


def top_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues that rounding can tell from 0, and their unit eigenvectors as columns."""
    d = len(v)
    bound = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    floor = bound * d * np.finfo(float).eps
    if not bound:
        return np.zeros(0), np.zeros((d, 0))
    high = bound * (1 + 1e-9)
    least, most = floor, high  # as many as wanted lie above least, fewer above most
    if (whole := inertia_above(v, floor)) > k:
        for _ in range(200):
            mid = math.sqrt(least * most) if most > 4 * least else (least + most) / 2
            n = inertia_above(v, mid)
            if n >= k:
                least, whole = mid, n
            else:
                most = mid
            if whole == k and inertia_above(v, least * 0.999) == k or most - least <= 1e-9 * most:
                break
    values, vectors = np.zeros(0), np.zeros((d, 0))
    edges = [least, high]
    while edges[-1] > 4 * edges[-2]:  # circles of like sizes: an interval of many magnitudes is cut
        edges.insert(-1, math.sqrt(edges[-1] * edges[-2]))
        edges.sort()
        if len(edges) > 64:
            break
    counts = [inertia_above(v, e) for e in edges[:-1]] + [0]
    for i in range(len(edges) - 1, 0, -1):
        if n := counts[i - 1] - counts[i]:
            e, u = feast(v, edges[i - 1], edges[i], n)
            values, vectors = np.concatenate([values, e]), np.concatenate([vectors, u], axis=1)
    vectors, _ = np.linalg.qr(vectors) if len(values) else (vectors, None)
    return values[:k], vectors[:, :k]


# ---- the operator


def fit_whitening(vectors: DataFrame, k: int = COMPONENTS) -> dict:
    """vectors: (vec_id, d, x). The model: n, sums, mean, components (columns), eigenvalues, trace, identity_error."""
    scratch = Scratch(vectors.sparkSession, "fit-list")
    common = vectors.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return {"d": 0, "n": 0, "eigenvalues": np.zeros(0)}
    fit = scratch.put(vectors.filter(F.col("d") == common.d).select("x").distinct())
    n, sums = fit_sums(fit, common.d)
    v = covariance(fit, n, sums)
    e, u = top_components(v, k)
    model = {"d": common.d, "n": n, "sums": sums, "mean": np.array([s / n for s in sums]), "eigenvalues": e, "components": u, "trace": float(np.trace(v)), "identity_error": 0.0}
    if len(e):
        moments = _summed(fit, lambda packed: (lambda w: np.vstack([w.T @ w, w.sum(axis=0)]))(whitened(packed, model)), len(e)) / n
        model["identity_error"] = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(e))).max())
    scratch.drop_all()
    return model


def whitened(packed: list[bytes], model: dict) -> np.ndarray:
    return (_matrix(packed, model["d"]) - model["mean"]) @ model["components"] / np.sqrt(model["eigenvalues"])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2: modulo 2**64 where the result is below 2**63, which a sum of doubles tells with room to spare."""
    about = ((n * x.astype(np.float64) - np.array(sums, np.float64)) ** 2).sum(axis=1)
    wrap = lambda values: np.array([v & (1 << 64) - 1 for v in values], np.uint64)
    off = np.uint64(n & (1 << 64) - 1) * x.astype(np.uint64) - wrap(sums)
    exact = (off * off).sum(axis=1, dtype=np.uint64).tolist()
    near = 1 << 62
    out: list[int | None] = []
    for k, (rough, value) in enumerate(zip(about.tolist(), exact, strict=True)):
        if rough >= near:  # by whole numbers of any size
            value = sum((n * int(c) - s) ** 2 for c, s in zip(x[k], sums, strict=True))
        out.append(value if value < 1 << 63 else None)
    return out


def whiten(vectors: DataFrame, model: dict) -> DataFrame:
    """vectors: (vec_id, d, x). One row for each vector and component."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # dimensions x components numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        c = len(m["eigenvalues"])
        for batch in batches:
            for k in range(0, batch.num_rows if c else 0, BATCH):
                part = batch.slice(k, BATCH)
                packed = part.column(1).to_pylist()
                w, off = whitened(packed, m), deviations(_matrix(packed, m["d"]), m["n"], m["sums"])
                rows = len(packed) * c
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i in part.column(0).to_pylist() for _ in range(c)], pa.int64()), pa.array(np.tile(np.arange(1, c + 1), len(packed)), pa.int32()), pa.array(np.full(rows, m["n"]), pa.int64()),
                    pa.array([i for i in off for _ in range(c)], pa.int64()), pa.array(w.ravel(), pa.float64()), pa.array(np.tile(m["eigenvalues"] / m["trace"], len(packed)), pa.float64()), pa.array(np.full(rows, m["identity_error"]), pa.float64()),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.filter(F.col("d") == model["d"]).select("vec_id", "x").mapInArrow(work, schema)


def whitening_report(embeddings: DataFrame) -> DataFrame:
    """The contract's columns for each usable row and component."""
    vectors = whole_vectors(embeddings)
    return whiten(vectors, fit_whitening(vectors))
