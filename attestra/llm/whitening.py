"""Embedding whitening with eigenvectors found by spectral divide and conquer.

Spark makes three passes over the vectors: exact integer sums, the covariance of the centred vectors, and
the projection. In between the driver splits one matrix of the vectors' width (never more): a shifted
covariance's polar factor, found by the dynamically weighted Halley iteration in QR form, is plus one on
eigenvalues above the shift and minus one below, so half of it plus one is the projector on the upper
invariant subspace. Bases of it and of its complement turn the matrix into two smaller ones, which are
split in turn until they are single components; the lower part is only looked at if the upper one has too
few. The whitening matrix (width times components) then goes to all tasks.

An entry c becomes the integer floor(64 c) + 1,000,000, kept within 2^62. All covariances divide by n and
are centred before they are multiplied.

Dropped: vectors that are null or hold a null or non-finite entry; also, if vectors of several lengths are
there, all but those of the most frequent length (the longer of two). Components with no variance (at most
width * 2^-52 of the greatest eigenvalue) can't be whitened and are left out, so a table of equal vectors,
of empty ones or of none gives no rows. ``deviation`` is null where the exact value is beyond a long. Rows
without an id, repeated rows and ties are rows like others; equal eigenvalues share an arbitrary basis of
their space, the same for all rows; columns other than the two named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.session import cut_lineage

BATCH = 8192
LIMIT = float(1 << 62)
EPS = float(np.finfo(float).eps)


# --- the decomposition, one matrix of the vectors' width ---------------------------------------


def polar_factor(a: np.ndarray, least: float = 1e-17) -> np.ndarray:
    """The symmetric orthogonal polar factor of a symmetric matrix, by QR-based weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low, eye = least, np.eye(n)
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        alpha = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, eye]))
        new = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (alpha + beta * square) / (1 + gamma * square))
        if low > 1 - 8 * EPS and moved <= EPS ** (1 / 3):
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces above and below the shift, or None if the shift does not part them."""
    n = len(a)
    sign = polar_factor(a - shift * np.eye(n))
    upper = (sign + np.eye(n)) / 2
    k = int(round(np.trace(upper)))
    if not 0 < k < n or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-8 * n:
        return None
    start = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(3):
        start, _ = np.linalg.qr(upper @ start)
    whole, _ = np.linalg.qr(start, mode="complete")
    return whole[:, :k], whole[:, k:]


def components(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    floor = 4 * len(a) * EPS * max(float(np.linalg.norm(a)), np.finfo(float).tiny)
    found: list[np.ndarray] = []
    waiting = [np.eye(len(a))]  # subspaces in falling order of their eigenvalues, the next one last
    while waiting and len(found) < count:
        basis = waiting.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        n, mean = len(part), float(np.trace(part)) / max(1, len(part))
        if n == 1 or np.linalg.norm(part - mean * np.eye(n)) <= floor:
            found.extend(basis.T)
            continue
        spread = float(np.linalg.norm(part - mean * np.eye(n))) / np.sqrt(n)
        shifts = [float(np.median(np.diag(part))), mean, *[mean + s * spread * f for f in (0.05, 0.15, 0.3) for s in (1, -1)]]
        halves = next((h for h in (_split(part, s) for s in shifts) if h is not None), None)
        if halves is None:
            found.extend(basis.T)  # a cluster too tight to part: any basis of it is as good
            continue
        waiting += [basis @ halves[1], basis @ halves[0]]
    vectors = np.array(found[: max(count, 0)]).T if found else np.zeros((len(a), 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], vectors[:, order]


# --- passes over the vectors --------------------------------------------------------------------


@dataclass
class Whitening:
    """A fit: n vectors with sums per dimension, eigenvalues of the components, their vectors, the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return np.asarray(lists.flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(64 * values.astype(float)), -LIMIT, LIMIT - 2048).astype(np.int64) + 1_000_000


def _centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - S / n without loss: the whole part of the mean is taken off in integers."""
    whole, rest = np.divmod(sums, n)
    return (x - whole).astype(float) - rest / n


def kept(table: DataFrame, key: str, column: str) -> DataFrame:
    """(key, vector) of the rows that take part."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.where(F.col(column).isNotNull() & finite).select(key, F.col(column).cast("array<double>").alias(column))
    size = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size(column) == (size[0] if size else 0)).where(F.size(column) > 0)


def _totals(parts: DataFrame) -> np.ndarray:
    """Sums of (i, j, value) rows as a matrix: at most width times width numbers reach the driver."""
    rows = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toLocalIterator()
    cells = [(r[0], r[1], r[2]) for r in rows]
    if not cells:
        return np.zeros((0, 0))
    out = np.zeros((1 + max(c[0] for c in cells), 1 + max(c[1] for c in cells)), np.array([c[2] for c in cells[:1]]).dtype)
    for i, j, value in cells:
        out[i, j] = value
    return out


def _cells(total: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    i, j = np.indices(total.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel(), kind)], ["i", "j", "value"])


def integer_sums(rows: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Number of vectors and the exact sum of their integers per dimension."""

    def work(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _integers(_matrix(batch, column))
                part = np.append(x.sum(axis=0), len(x))
                total = part if total is None else total + part
        if total is not None:
            yield _cells(total[None, :], pa.int64())

    out = _totals(rows.mapInArrow(work, "i int, j int, value bigint"))
    return (int(out[0, -1]), out[0, :-1].astype(np.int64)) if out.size else (0, np.zeros(0, np.int64))


def covariance(rows: DataFrame, column: str, n: int, centre) -> np.ndarray:
    """Covariance, divisor n, of the rows' vectors as ``centre`` gives them; a task sends one matrix."""

    def work(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = centre(_matrix(batch, column))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield _cells(total, pa.float64())

    out = _totals(rows.mapInArrow(work, "i int, j int, value double")) / n
    return (out + out.T) / 2


def fit(rows: DataFrame, column: str, count: int) -> Whitening | None:
    """Fit on all of ``rows`` (as ``kept`` gives them); None if there are none."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    n, sums = integer_sums(rows, column)
    if not n:
        return None
    matrix = covariance(rows, column, n, lambda v: _centred(_integers(v), sums, n))
    values, vectors = components(matrix, min(count, len(sums)))
    good = values > len(sums) * EPS * max(float(values.max(initial=0.0)), np.finfo(float).tiny)
    return Whitening(n, sums, values[good], vectors[:, good], float(np.trace(matrix)))


def _deviation(x: np.ndarray, sums: np.ndarray, n: int) -> pa.Array:
    """Sum over dimensions of (n x - S)^2: exact modulo 2^64, null where it does not fit."""
    whole, rest = np.divmod(sums, n)
    off = (x - whole) * n - rest
    about = ((_centred(x, sums, n) * n) ** 2).sum(axis=1)
    return pa.array((off * off).sum(axis=1), mask=about > 0.999 * 2.0**63)


def transform(rows: DataFrame, key: str, column: str, model: Whitening) -> DataFrame:
    """(key, deviation, whitened): the components' scores of every row, as one array."""
    sent = model.vectors / np.sqrt(model.values)
    n, sums = model.n, model.sums
    kind = rows.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(_matrix(batch, column))
            scores = _centred(x, sums, n) @ sent
            cuts = np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(key), _deviation(x, sums, n), pa.ListArray.from_arrays(pa.array(cuts), pa.array(scores.ravel()))], [key, "deviation", "whitened"])

    return rows.mapInArrow(work, f"`{key}` {kind}, deviation bigint, whitened array<double>")


def identity_error(done: DataFrame, n: int) -> float:
    """Largest entry, without sign, of the whitened vectors' covariance less the identity."""

    def work(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch, "whitened").sum(axis=0)
                total = part if total is None else total + part
        if total is not None:
            yield _cells(total[None, :], pa.float64())

    mean = _totals(done.select("whitened").mapInArrow(work, "i int, j int, value double"))[0] / n
    matrix = covariance(done.select("whitened"), "whitened", n, lambda v: v - mean)
    return float(np.abs(matrix - np.eye(len(matrix))).max())


def whiten(table: DataFrame, key: str = "vec_id", column: str = "embedding", count: int = 32) -> DataFrame:
    """One row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = kept(table, key, column)
    model = fit(rows, column, count)
    kind = table.schema[key].dataType.simpleString()
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    done = cut_lineage(transform(rows, key, column, model))
    error = identity_error(done, model.n)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    flat = done.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(
        key,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
