import random

import pytest

from fleetlens.llm import topk as T
from fleetlens.llm import vectors as V
from fleetlens.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

from .helpers import SF

SCHEMA = "vec_id long, embedding array<double>"


def integers(v):
    import math
    return [int(max(-V.LIMIT, min(V.LIMIT, math.floor(64 * x)))) for x in v]


def brute(rows, k=20, every=20):
    rows = [(i, integers(v)) for i, v in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = []
    for i, q in rows:
        if i is None or i % every:
            continue
        got = []
        for j, c in rows:
            if j != i:
                s = sum(a * b for a, b in zip(q, c))
                got.append((-max(-(1 << 63), min((1 << 63) - 1, s)), V.NO_ID if j is None else j))
        out += [(i, r, None if j == V.NO_ID else j, -s) for r, (s, j) in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=str)


def seen(df):
    return sorted(map(tuple, df.collect()), key=str)


def run(spark, rows, k=20, every=20, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return seen(T.exact_top_k(df, F.col("vec_id") % every == 0, k))


@pytest.mark.parametrize("share", [0.03, 0.5, 1.0])
def test_against_brute_force(spark, monkeypatch, share):
    rng = random.Random(share)
    rows = [(i, [rng.gauss(0, 0.3) if rng.random() < share else 0.0 for _ in range(24)]) for i in rng.sample(range(-4000, 4000), 500)]
    assert run(spark, rows) == brute(rows)


def test_ties_and_a_very_common_vector(spark):
    rng = random.Random(2)
    same = [0.5, -0.25, 1.0]
    rows = [(i, same if i % 3 else [rng.choice((0.5, 1.0)) for _ in range(3)]) for i in range(900)]
    assert run(spark, rows, k=7, parts=11) == brute(rows, k=7)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(T, "blocks", lambda *a: V.blocks(*a, most=16))
    monkeypatch.setattr(T, "KEPT", 2)
    assert seen(T.exact_top_k(df, F.col("vec_id") % 5 == 0, 20)) == brute(rows, every=5)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (40, []), (1, None), (2, [nan, 1.0]), (3, [inf]), (4, [None, 1.0]), (None, [3.0, 1.0]), (5, [-1.0, 0.1, 9.0]),
            (6, [1.0, 2.0]), (6, [1.0, 2.0]), (60, [1e300, -1e300]), (7, [1e300, 1e18]), (80, [1e15, 3.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []
    twice = rows + [(0, [1.0, 2.0])]  # a repeated query asks twice
    assert run(spark, twice) == sorted(brute(twice), key=str)


def test_other_columns_do_not_matter(spark):
    rows = [(i, [i / 7, 1.0], "x", 1, True, b"d") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + ", block string, row int, asks boolean, data binary")
    assert seen(T.exact_top_k(df, df["vec_id"] % 20 == 0)) == brute([r[:2] for r in rows])


def test_query_equals_sql(spark, duck):
    assert seen(QUERIES["op11_exact_topk"](spark, SF)) == sorted(duck.sql(ORACLE["op11_exact_topk"]).fetchall(), key=str)


def test_blocks_meet_blocks(spark):
    """Rows of the join are pairs of blocks; what is sorted is at most k rows a query and task."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    plan = T.exact_top_k(df, df["vec_id"] % 20 == 0)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
