"""Operator 13, embedding whitening through a bidiagonal qd solver.

Vectors become whole numbers x = floor(scale * component).  The fit list holds each different x
once; its n and its sums S per dimension are exact.  Blockwise QR reduces its centred rows: a
task folds its rows into one triangular factor block by block, and factors are stacked and reduced
again in groups of FAN until one R is left, with R'R = n V.  R is brought to bidiagonal form by
Householder reflections; dqds (the differential qd algorithm with shifts) finds the squared
singular values with high relative accuracy; for the largest ones a twisted factorisation of
B'B - s2 I gives the vector of B, and the reflections carry it back to a unit eigenvector of V.
The covariance itself is never formed, so small components lose no digits to squaring.

A row is whitened by (x - S/n) . v / sqrt(e).  ``identity_error`` is measured, not
assumed: the whitened fit list's own covariance, from per-task means and centred products.

Scale: one shuffle makes the fit list distinct (a hot vector is one row a task); every other
pass reads it or the input where it lies and returns one d x d factor or a few numbers a task.
The driver gets S (d numbers), one R (d x d) and the 4 x 4 covariance; tasks get S and the directions.

Cases: vectors that are null, empty, or hold a null or non-finite component take no part.
Vectors of different lengths are different spaces, each whitened by itself (n is then that of the
length).  Components beyond the rank (singular value up to d * 2**-52 of the largest) do not exist:
a single or constant vector gives no rows.  Equal eigenvalues: any orthonormal basis of their
space.  Repeated rows and null ids are rows of their own.  Components beyond a long are clipped to
it; a deviation beyond a long is null.  No rows: no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import query, stored, table

SCALE = 256
COMPONENTS = 4
FAN = 16  # triangular factors reduced by one task
EPS = 2.0**-52


# --- the solver: d x d, numpy -------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and superdiagonal of U'RV, and the reflections that make V."""
    a, n, right = r.astype(float).copy(), len(r), []
    for k in range(n):
        h = reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * h, h @ a[k:, k:])
        if k < n - 2:
            h = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ h, 2 * h)
            right.append((k + 1, h))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def reflector(x: np.ndarray) -> np.ndarray:
    """Unit h (or zeros) with x - 2 h (h.x) a multiple of the first unit vector."""
    top = np.abs(x).max(initial=0.0)
    if top == 0.0:
        return np.zeros(len(x))
    h = x / top
    h[0] += math.copysign(np.linalg.norm(h), h[0])
    return h / np.linalg.norm(h)


def sweep(q: list[float], e: list[float], s: float):
    """One dqds transform by the shift ``s``: (q, e, d) or None when s lies above an eigenvalue."""
    d, qq, ee, ds = q[0] - s, [], [], []
    for k in range(len(e)):
        if not d >= 0.0:
            return None
        ds.append(d)
        qq.append(d + e[k])
        if qq[k] == 0.0:
            return None
        t = q[k + 1] / qq[k]
        ee.append(e[k] * t)
        d = d * t - s
    if not d >= 0.0:
        return None
    return [*qq, d], ee, [*ds, d]


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal matrix with diagonal ``a`` (no zeros)
    and superdiagonal ``b``."""
    out, small = [], (10 * EPS) ** 2
    todo = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while len(q) > 1:
            if e[-1] <= small * (sigma + q[-1]):
                out.append(sigma + q.pop())
                e.pop()
                continue
            cut = next((k for k in range(len(e)) if e[k] <= small * (sigma + min(q[k], q[k + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            step = sweep(q, e, 0.0)
            if step is None:  # an eigenvalue of 0 beside the shift made so far
                step = [max(x, small * (sigma + max(q))) for x in q], e, q
            q, e, d = step
            # 1 / sum(1 / d) is never above the smallest eigenvalue, min(d) never below it
            top = min(d)
            if top > 0.0:
                safe = (1.0 - 8 * EPS) / sum(1.0 / x for x in d)
                for s in (top * (1.0 - 1e-3), math.sqrt(safe * top), safe):
                    step = sweep(q, e, s) if sigma + s > sigma else None
                    if step is not None:
                        q, e, sigma = step[0], step[1], sigma + s
                        break
        out += [sigma + x for x in q]
    return np.sort(np.array(out))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, s2: float) -> np.ndarray:
    """Unit vector of B'B for the eigenvalue ``s2``: B'B - s2 I factored from both ends, joined
    where the twist is smallest."""
    n, tiny = len(a), 1e-290 + s2 * 1e-30
    d, low = (a * a).tolist(), (b / a[:-1]).tolist()
    guard = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)
    s, down = [-s2], []
    for k in range(n - 1):
        plus = guard(d[k] + s[k])
        down.append(d[k] * low[k] / plus)
        s.append(down[k] * low[k] * s[k] - s2)
    p, up = [0.0] * n, [0.0] * (n - 1)
    p[-1] = d[-1] - s2
    for k in range(n - 2, -1, -1):
        t = d[k] / guard(d[k] * low[k] * low[k] + p[k + 1])
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - s2
    gamma = np.abs(np.array([x + y + s2 for x, y in zip(s, p, strict=True)]))
    r = int(np.argmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest squared singular values of R (fewer beyond its rank) and their unit right
    vectors as columns."""
    size = np.abs(r).max(initial=0.0)
    if size == 0.0 or not len(r):
        return np.zeros(0), np.zeros((len(r), 0))
    a, b, right = bidiagonal(r / size)
    top = np.abs(np.concatenate([a, b])).max()
    a = np.where(np.abs(a) < 1e-20 * top, 1e-20 * top, a)  # far below rounding; keeps quotients finite
    s2 = dqds(a, b)
    s2 = s2[: min(k, int((s2 > (len(r) * EPS) ** 2 * s2[0]).sum()))]
    z = np.zeros((len(r), len(s2)))
    for j, x in enumerate(s2):
        z[:, j] = orthogonal(twisted(a, b, x), z[:, :j], a, b, x)
    for first, h in reversed(right):
        z[first:] -= np.outer(2 * h, h @ z[first:])
    return s2 * size * size, z


def orthogonal(v: np.ndarray, before: np.ndarray, a: np.ndarray, b: np.ndarray, s2: float) -> np.ndarray:
    """``v`` made orthogonal to the columns found before; in a tight cluster the twisted vectors
    may coincide, then inverse iteration inside the space that is left gives the next one."""
    rest = v - before @ (before.T @ v)
    if np.linalg.norm(rest) < 0.9:
        t = np.diag(a * a) + np.diag(np.append(0.0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
        t -= s2 * (1 + 4 * EPS) * np.eye(len(a))
        rest = np.cos(np.arange(1.0, len(a) + 1))
        for _ in range(4):
            rest -= before @ (before.T @ rest)
            rest = np.linalg.lstsq(t, rest / np.linalg.norm(rest), rcond=EPS * EPS)[0]
            rest -= before @ (before.T @ rest)
    rest -= before @ (before.T @ rest)
    return rest / np.linalg.norm(rest)


# --- the data ------------------------------------------------------------------------------

def whole_vectors(df: DataFrame, vector: str, scale: int, *columns) -> DataFrame:
    """``columns`` and x of the usable rows."""
    ok = (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return df.where(ok).select(*columns, x.alias("x"))


def matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1)


def dimension_sums(fit: DataFrame) -> list[int]:
    """Exact sums per dimension."""

    def run(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) >= 2**62:
                x = x.astype(object)
            s = [int(v) for v in x.sum(axis=0)]
            total = s if total is None else [a + b for a, b in zip(total, s, strict=True)]
        total = total or []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total], pa.string())], names=["i", "s"])

    parts = fit.select("x").mapInArrow(run, "i int, s string")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows)]


class Centre:
    """x - S/n, the whole part of the mean taken off in whole numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = [s // n for s in sums]
        self.rest = np.array([(s - b * n) / n for s, b in zip(sums, self.base, strict=True)])
        self.far = max(map(abs, self.base)) >= 2**62

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.far or np.abs(x.astype(float)).max(initial=0.0) >= 2**62:
            x = x.astype(object)
        return (x - np.array(self.base, dtype=x.dtype)).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact; None beyond a long."""
        about = ((float(self.n) * x.astype(float) - np.array([float(s) for s in self.sums])) ** 2).sum(axis=1)
        wrap = np.array([s % 2**64 for s in self.sums], dtype=np.uint64)
        v = np.uint64(self.n % 2**64) * x.view(np.uint64) - wrap
        out = (v * v).sum(axis=1, dtype=np.uint64).tolist()  # exact modulo 2**64
        for i in np.flatnonzero(about > 9.2e18).tolist():
            exact = sum((self.n * int(c) - s) ** 2 for c, s in zip(x[i], self.sums, strict=True))
            out[i] = exact if exact < 2**63 else None
        return out


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, d x d."""
    r = np.linalg.qr(rows, mode="r")
    d = rows.shape[1]
    return r if len(r) == d else np.concatenate([r, np.zeros((d - len(r), d))])


def reduced(fit: DataFrame, centre: Centre, d: int) -> np.ndarray:
    """The triangular factor of all centred rows."""
    step = max(1024, 4 * d)

    def fold(batches):
        r = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0))
            for i in range(0, len(x), step):
                r = triangle(np.concatenate([r, centre(x[i : i + step])]))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["slot", "r"])

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["slot"].to_pylist(), t["r"].to_pylist(), strict=True))
        r = triangle(np.concatenate([np.frombuffer(x).reshape(d, d) for _, x in rows]))
        return pa.table({"slot": [rows[0][0] // FAN], "r": pa.array([r.tobytes()], pa.binary())})

    parts = stored(fit.select("x").mapInArrow(fold, "slot long, r binary"), "whiten-factors")
    while parts.count() > 1:
        parts = stored(parts.groupBy(F.expr(f"slot div {FAN}")).applyInArrow(join, "slot long, r binary"), "whiten-factors")
    return np.frombuffer(parts.first()["r"]).reshape(d, d)


def covariance_gap(fit: DataFrame, centre: Centre, w: np.ndarray) -> float:
    """Largest entry of |covariance of the whitened fit list - I|."""
    k = w.shape[1]

    def run(batches):
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = centre(matrix(batch.column(0))) @ w
            if not len(y):
                continue
            at, off = y.mean(axis=0), y.mean(axis=0) - mean
            c = y - at
            m2 += c.T @ c + np.outer(off, off) * (n * len(y) / (n + len(y)))
            mean += off * (len(y) / (n + len(y)))
            n += len(y)
        i, j = (v.ravel() for v in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, np.full(k * k, n), mean[i], mean[j], m2.ravel())], names=["i", "j", "n", "mi", "mj", "m2"])

    parts = stored(fit.select("x").mapInArrow(run, "i long, j long, n long, mi double, mj double, m2 double"), "whiten-check")
    means = parts.groupBy("i").agg((F.sum(F.col("mi") * F.col("n")) / F.sum("n")).alias("m"))
    mean = dict(means.collect())
    at = lambda c: F.element_at(F.array(*[F.lit(mean[i]) for i in range(k)]), (F.col(c) + 1).cast("int"))
    off = F.sum(F.col("n") * (F.col("mi") - at("i")) * (F.col("mj") - at("j")))
    cov = parts.groupBy("i", "j").agg(((F.sum("m2") + off) / F.sum("n")).alias("c"))
    return float(cov.agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0])


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per usable row and component: key, component, n, deviation, whitened, explained,
    identity_error."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, vector, scale, F.col(key).alias("k"))
    fit_all = stored(whole_vectors(vectors, vector, scale).distinct().withColumn("d", F.size("x")), "whiten-fit")
    out = spark.createDataFrame([], schema)
    for d, n in sorted(tuple(r) for r in fit_all.groupBy("d").count().collect()):
        fit = fit_all.where(F.col("d") == d)
        centre = Centre(n, dimension_sums(fit))
        r = reduced(fit, centre, d)
        s2, v = directions(r, components)
        if len(s2):
            w = v * np.sqrt(n / s2)
            gap = covariance_gap(fit, centre, w)
            out = out.unionByName(projected(rows.where(F.size("x") == d), centre, w, s2 / float((r * r).sum()), gap, schema, key))
    return out


def projected(rows: DataFrame, centre: Centre, w: np.ndarray, explained: np.ndarray, gap: float, schema: str, key: str) -> DataFrame:
    k = w.shape[1]

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            again = pa.array(np.repeat(np.arange(len(x)), k))
            y = centre(x) @ w
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, centre.n)),
                pa.array(centre.deviations(x), pa.int64()).take(again), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, gap)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("k", "x").mapInArrow(run, schema)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened onto their first four components."""
    return whiten(table(spark, sf_dir, "embeddings"))
