"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed: it is applied to a thin block Q as
a pass over the data, V Q = sum of (x - mean) ((x - mean)' Q) / n. Every pass reads the
packed vectors (written once) and adds up a width x block matrix in each task; beyond
``FEW`` tasks Spark sums those by entry first. The driver holds a few such matrices.

* A short Lanczos run gives the lower end of the spectrum.
* Each round a Chebyshev polynomial of degree ``DEGREE``, scaled at the greatest
  eigenvalue, is applied to the block by its three-term recurrence. It stays below 1 on
  the unwanted part of the spectrum, from the lower end to the block's least Ritz
  value, and grows steeply above it.
* QR makes the block orthonormal, Rayleigh-Ritz on it gives eigenvalues and vectors,
  and V X - X e their residuals. The last columns of the block are drawn anew each
  round, so that no direction can be left out by an unlucky start.
* The result is certified: the residuals of all wanted components are at rounding level
  (``CERTAIN`` times the greatest eigenvalue) and no longer fall, and a Lanczos run on what
  is orthogonal to them finds no eigenvalue above the last wanted one. Otherwise the
  rounds go on; after ``ROUNDS`` the operator stops with an error.

Vectors are centred before they are multiplied: the whole part of the mean is taken off in
integers, its fraction in double. Exact sums (``deviation``) are integers.

Defined results: null vectors, and those with null or non-finite components, take no part.
Missing components of a shorter vector count as 0. A direction without variance (an
eigenvalue below ``NOTHING`` times the greatest) has no component, so equal vectors, a single
vector and an empty table give no rows. A deviation that doesn't fit a long is null. Repeated
rows and null ids each get their rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .vectors import NO_ID, blocks, unpacked

COMPONENTS = 32
#: What is added to every integer.
SHIFT = 1_000_000
DEGREE = 10
ROUNDS = 40
#: Columns of the block beyond the wanted ones, and those of them that are drawn anew.
GUARD, FRESH = 12, 2
LANCZOS = 12
#: Partial sums of so many tasks go straight to the driver; those of more are added up by Spark first.
FEW = 32
CERTAIN, NOTHING = 1e-12, 1e-12


class Centred:
    """The packed vectors with their exact sums; ``apply`` is one pass over them."""

    def __init__(self, packed: DataFrame):
        self.rows = packed.select("n", "width", "size", "data")
        self.tasks = self.rows.rdd.getNumPartitions()

        def sums(stream):
            total, n = np.zeros(0, object), 0
            for batch in stream:
                for x in _matrices(batch):
                    if x.shape[1] > len(total):
                        total = np.concatenate([total, np.zeros(x.shape[1] - len(total), object)])
                    total[: x.shape[1]] += x.sum(0).astype(object)
                    n += len(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array([str(v) for v in (n, *total)])], names=["dim", "total"])

        got = self.rows.mapInArrow(sums, "dim bigint, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        got = {r.dim: int(r.total) for r in got.collect()}  # one row a dimension
        self.n, self.width = got.pop(-1, 0), len(got)
        plain = [got[d] for d in range(self.width)]
        self.sums = [s + self.n * SHIFT for s in plain]  # of the shifted integers
        self.whole = np.array([s // self.n for s in plain], np.int64) if self.n else np.zeros(0, np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in plain]) if self.n else np.zeros(0)

    def _pass(self, part, width: int) -> np.ndarray:
        """Sum over the data of part(y), a (rows, width) matrix, y the centred vectors of a block."""
        centred = self.centred

        def run(stream):
            total = None
            for batch in stream:
                for x in _matrices(batch):
                    got = part(centred(x))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

        got = self.rows.mapInArrow(run, "i bigint, x double")
        if self.tasks > FEW:
            got = got.groupBy("i").agg(F.sum("x").alias("x"))
        got = got.toArrow()  # at most FEW matrices
        return np.bincount(got.column("i").to_numpy(), weights=got.column("x").to_numpy()).reshape(-1, width)

    @property
    def centred(self):
        whole, rest, width = self.whole, self.rest, self.width

        def of(x):
            y = np.zeros((len(x), width), np.int64)
            y[:, : x.shape[1]] = x
            return (y - whole) - rest

        return of

    def apply(self, q: np.ndarray) -> np.ndarray:
        """V q, one pass."""
        return self._pass(lambda y: y.T @ (y @ q), q.shape[1]) / self.n

    def trace(self) -> float:
        return float(self._pass(lambda y: (y * y).sum(0)[None, :], self.width).sum() / self.n)


def _matrices(batch):
    for n, width, size, data in zip(*(batch.column(c).to_pylist() for c in ("n", "width", "size", "data"))):
        yield unpacked(n, width, size, data).astype(np.int64)


def lanczos(apply, width: int, steps: int, rng, beside: np.ndarray | None = None) -> tuple[float, float]:
    """(lower, upper) bounds of the spectrum from a few steps, on what is orthogonal to ``beside``."""
    away = (lambda v: v) if beside is None else (lambda v: v - beside @ (beside.T @ v))
    steps = min(steps, width - (0 if beside is None else beside.shape[1]))
    basis, along, next_to = [], [], []
    v = away(rng.standard_normal(width))
    v /= np.linalg.norm(v)
    left = 0.0
    for _ in range(steps):
        basis.append(v)
        w = away(apply(away(v)[:, None])[:, 0])
        along.append(float(v @ w))
        for _ in range(2):  # full reorthogonalisation
            w = away(w - np.array(basis).T @ (np.array(basis) @ w))
        left = float(np.linalg.norm(w))
        if left <= 1e-12 * max(along):
            left = 0.0
            break
        next_to.append(left)
        v = w / left
    off = next_to[: len(along) - 1]
    e, s = np.linalg.eigh(np.diag(along) + np.diag(off, 1) + np.diag(off, -1))
    return float(e[0] - left * abs(s[-1, 0])), float(e[-1])


def chebyshev(apply, x: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The filter polynomial of V on x: at most 1 between low and high, scaled at top."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (top - middle)
    first = sigma
    y = (apply(x) - middle * x) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        x, y = y, (apply(y) - middle * y) * (2 * following / half) - (sigma * following) * x
        sigma = following
    return y


class NotCertified(RuntimeError):
    pass


def eigenpairs(apply, width: int, wanted: int, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 0):
    """(values, vectors, certificate) of the greatest eigenvalues of a positive matrix given by ``apply``."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, width)
    m = min(width, wanted + GUARD)
    q, _ = np.linalg.qr(rng.standard_normal((width, m)))
    low = max(0.0, lanczos(apply, width, LANCZOS, rng)[0]) if m < width else 0.0
    before = np.inf
    for number in range(rounds):
        w = apply(q)
        h = q.T @ w
        e, s = np.linalg.eigh((h + h.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        x, top = q @ s, max(float(e[0]), 0.0)
        residual = float(np.linalg.norm(w @ s[:, :wanted] - x[:, :wanted] * e[:wanted], axis=0).max())
        if top == 0.0:
            return e[:0], x[:, :0], {"rounds": number, "residual": 0.0}
        if m == width or (residual <= CERTAIN * top and residual > before / 4):
            real = e[:wanted] > NOTHING * top
            values, vectors = e[:wanted][real], x[:, :wanted][:, real]
            # without a certificate of completeness a missed direction goes into the block
            missed = m < width and real.all() and lanczos(apply, width, LANCZOS, rng, vectors)[1] > e[wanted - 1] * (1 + 1e-9)
            if not missed:
                return values, vectors, {"rounds": number, "residual": residual / top}
        before = residual
        if m == width:
            break
        high = float(e[-1])
        if number and FRESH < m - wanted:
            x[:, m - FRESH:] = rng.standard_normal((width, FRESH))
            high = float(e[m - FRESH - 1])
        low = min(low, high)
        if high - low < 1e-3 * top:  # a flat rest: any interval that holds it will do
            low = max(0.0, high - 1e-3 * top)
            high = max(high, low + 1e-9 * top)
        q, _ = np.linalg.qr(chebyshev(apply, x, low, high, top, degree))
    raise NotCertified(f"residual {before:.3g} after {rounds} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component."""
    packed = stored(blocks(vectors, id_col, vec_col))
    data = Centred(packed)
    if data.n:
        values, axes, _ = eigenpairs(data.apply, data.width, components)
    else:
        values, axes = np.zeros(0), np.zeros((0, 0))
    if len(values):
        w = axes / np.sqrt(values)
        error = float(np.abs(w.T @ data.apply(w) - np.eye(len(values))).max())
        explained = values / data.trace()
    n, sums, centred, k = data.n, np.array(data.sums, object), data.centred, len(values)

    def project(stream):
        for batch in stream:
            for x, ids in zip(_matrices(batch), batch.column("ids").to_pylist()):
                if not k:
                    continue
                ids = np.frombuffer(ids, "<i8")
                z = centred(x) @ w
                for low in range(0, len(ids), 512):
                    own = slice(low, low + 512)
                    deviation = np.repeat(np.array(deviations(x[own], n, sums), object), k)
                    m = len(ids[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[own], k), mask=np.repeat(ids[own] == NO_ID, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                         pa.array(np.full(m * k, n)), pa.array(deviation.tolist(), pa.int64()), pa.array(z[own].ravel()),
                         pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return packed.select("n", "width", "size", "data", "ids").mapInArrow(
        project, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Exact sum over the dimensions of (n * (x + SHIFT) - sum)**2 of each row; None beyond a long."""
    width = len(sums)
    most = n * (int(np.abs(x).max(initial=0)) + SHIFT) + max(map(abs, sums), default=0)
    if most < 1 << 62:  # the differences fit a long; their squares may not
        y = np.full((len(x), width), SHIFT, np.int64)
        y[:, : x.shape[1]] += x
        y = n * y - sums.astype(np.int64)
        if width * float(np.abs(y).max(initial=0)) ** 2 < 2.0**62:
            return (y * y).sum(1).tolist()
        y = y.astype(object)
    else:
        y = np.full((len(x), width), SHIFT, object)
        y[:, : x.shape[1]] += x.astype(object)
        y = n * y - sums
    return [v if v < 1 << 63 else None for v in (y * y).sum(1).tolist()]
