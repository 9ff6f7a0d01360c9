import numpy as np
import pytest

from fleetlens.llm import whitening as W
from fleetlens.llm.queries import QUERIES

from .helpers import SF

SCHEMA = "vec_id long, embedding array<double>"


def reference(x, k):
    """(deviation, whitened up to signs, explained) by a full eigendecomposition."""
    x = np.array([[int(v) + W.SHIFT for v in row] for row in np.floor(64 * np.asarray(x, float))], object)
    n, sums = len(x), x.sum(0)
    dev = ((n * x - sums) ** 2).sum(1)
    y = ((n * x - sums) / n).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum())) if e[0] > 0 else 0
    return dev, y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def table(df):
    rows = sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))
    ids = sorted({r[0] for r in rows})
    k = len(rows) // len(ids) if ids else 0
    return ids, np.array([r[4] for r in rows]).reshape(len(ids), k), np.array([r[5] for r in rows][:k]), [r[3] for r in rows[::max(k, 1)]], rows


def assert_whitened(df, x, k=32, atol=1e-9):
    ids, got, explained, dev, rows = table(df)
    want_dev, want, share = reference(x, k)
    assert got.shape == want.shape
    assert dev == want_dev.tolist()
    assert {r[2] for r in rows} == {len(x)} and len({r[6] for r in rows}) == 1 and rows[0][6] <= 1e-9
    sign = np.sign((got * want).sum(0))
    assert np.allclose(got * sign, want, atol=atol)
    assert np.allclose(explained, share, rtol=1e-9)


@pytest.mark.parametrize("width,spread", [(64, "flat"), (64, "steep"), (20, "flat"), (90, "steep"), (1, "flat")])
def test_against_a_full_decomposition(spark, width, spread):
    rng = np.random.default_rng(width)
    x = rng.standard_normal((700, width)) * (0.93 ** np.arange(width) * 3 if spread == "steep" else 1.0) + rng.standard_normal(width)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(6)
    assert_whitened(W.whiten(df), x)


def test_far_mean_does_not_cost_digits(spark):
    x = np.random.default_rng(5).standard_normal((300, 50)) / 8 + 1e7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    assert_whitened(W.whiten(df), x)


def test_spark_adds_up_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "FEW", 0)
    x = np.random.default_rng(6).standard_normal((200, 50))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(7)
    assert_whitened(W.whiten(df), x)


def test_filter_damps_the_unwanted_part():
    e = np.linspace(1.0, 3.0, 80)
    y = W.chebyshev(lambda q: e[:, None] * q, np.ones((80, 1)), 1.0, 2.5, 3.0, 10)[:, 0]
    assert abs(y[-1] - 1) < 1e-9 and np.abs(y[e <= 2.5]).max() < 1e-3


def test_eigenpairs_of_near_and_equal_eigenvalues():
    rng = np.random.default_rng(0)
    u, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    e = np.concatenate([[5.0, 5.0, 5.0], np.linspace(4, 3.99, 29), np.linspace(3.98, 0.1, 168)])
    v = (u * e) @ u.T
    values, vectors, told = W.eigenpairs(lambda q: v @ q, 200, 32)
    assert np.allclose(values, e[:32], rtol=1e-12) and told["residual"] < 1e-11
    assert np.allclose(vectors @ vectors.T, u[:, :32] @ u[:, :32].T, atol=1e-8)


def test_no_certificate_is_an_error():
    e = np.linspace(1, 2, 300)
    with pytest.raises(W.NotCertified):
        W.eigenpairs(lambda q: e[:, None] * q, 300, 32, degree=2, rounds=2)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [nan, 1.0, 2.0]), (102, [None, 1.0, 2.0]), (103, [inf, 0.0, 0.0])]
    x = np.random.default_rng(1).standard_normal((40, 3))
    x[:, 2] = x[:, 0]  # a direction without variance
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert_whitened(W.whiten(spark.createDataFrame(rows + bad, SCHEMA)), x)
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame(bad, SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, SCHEMA)).count() == 0
    short = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (None, [0.0, 5.0]), (0, [1.0, 2.0])], SCHEMA)
    got = W.whiten(short).collect()
    assert len(got) == 8 and sum(r.vec_id is None for r in got) == 2
    more = spark.createDataFrame([(i, v, "a", 1, b"") for i, v in rows], SCHEMA + ", n string, width int, data binary")
    assert_whitened(W.whiten(more), x)


def test_huge_components(spark):
    x = [[1e300, 0.0], [-1e300, 1.0], [5.0, 2.0]]
    got = W.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(x)], SCHEMA)).collect()
    assert got and all(np.isfinite(r.whitened) for r in got) and any(r.deviation is None for r in got)


def test_query(spark):
    df = QUERIES["op12_chebyshev_whitening"](spark, SF)
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], float)
    assert_whitened(df, x)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
