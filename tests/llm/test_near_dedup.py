import random

import numpy as np

from fleetlens.llm import near_dedup as N
from fleetlens.llm.queries import ORACLE, QUERIES

from .helpers import DOCS, SF, clashing, frame, lower, words


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=85):
    sets = [(N.NO_ID if d is None else d, shingles(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= threshold * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(d, low.get(find(i), d))
    name = lambda d: "None" if d == N.NO_ID else str(d)
    return sorted((name(d), len(s), name(low[find(i)]), d == low[find(i)]) for i, (d, s) in enumerate(sets))


def seen(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def copies(rng, n, changes, length=150):
    """A text and copies of copies: similarities from nearly 1 to far below the threshold."""
    texts = [[f"w{rng.randrange(900)}" for _ in range(length)]]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(changes + 1)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(5)
    for j in (0.3, 0.7, 0.9):
        n = 2000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n: 2 * n - both]])
        r = N.registers([np.sort(a), np.sort(b), np.union1d(a, b)])
        assert (N.merge(r[0], r[1]) == r[2]).all()
        true = both / (2 * n - both)
        assert abs((r[0] == r[1]).mean() - true) < 0.12
        assert abs(N.joint_estimate(r[:1], r[1:2], np.array([1.0 * n]), np.array([1.0 * n]))[0] - true) < 0.12


def test_registers_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64) for k in (1, 2, 7, 40, 900, 0)]
    together = N.registers(sets)
    for s, r in zip(sets, together):
        assert (N.registers([s])[0] == r).all()
    assert not together[-1].any()


def test_edge_cases(spark):
    assert seen(N.near_duplicates(clashing(spark, DOCS))) == brute(DOCS)
    assert seen(N.near_duplicates(clashing(spark, DOCS), hot=3, large=3)) == brute(DOCS)
    assert N.near_duplicates(frame(spark, [])).count() == 0
    assert seen(N.near_duplicates(frame(spark, [(1, None), (2, "")]))) == brute([(1, None), (2, "")])


def test_large_group_of_copies(spark):
    rng = random.Random(11)
    texts = copies(rng, 150, 3) + copies(rng, 40, 6, 60) + ["Same TEXT over and over again"] * 60 + copies(rng, 5, 1, 6)
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts))
    want = brute(rows)
    assert seen(N.near_duplicates(frame(spark, rows).repartition(7))) == want
    assert seen(N.near_duplicates(frame(spark, rows[100:]), hot=3, large=3)) == brute(rows[100:])


def test_rows_without_an_id_and_rows_that_share_one(spark, monkeypatch):
    """Copies without an id leave one row; their texts are taken up once a row, not once a pair of rows."""
    rng = random.Random(3)
    texts = copies(rng, 60, 3, 100)
    rows = [(None, t) for t in texts] + [(None, texts[0])] * 40 + [(3, "one two three four five six"), (5, "one two three four five six"),
                                                                 (5, "another text of id five here"), (None, "seven eight nine"), (None, "seven eight nine")]
    asked = []
    real = N._full_sets
    monkeypatch.setattr(N, "_full_sets", lambda df, width: asked.append(df.count()) or real(df, width))
    got = N.near_duplicates(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows) and sum(asked) <= len(rows)
    want = brute([(i, t) for i, (_, t) in enumerate(rows)])  # by row number: as many components
    named = {100, 101, 102}
    assert sum(r.kept for r in got if r.doc_id is None) == len({c for d, _, c, _ in want if int(d) not in named})
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(3, 3, True), (5, 3, False), (5, 5, True)]
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_null_ids_do_not_multiply(spark, monkeypatch):
    asked = []
    real = N._full_sets
    monkeypatch.setattr(N, "_full_sets", lambda df, width: asked.append(df.count()) or real(df, width))
    rng = random.Random(6)
    texts = copies(rng, 800, 2, 60)
    got = N.near_duplicates(frame(spark, [(None, t) for t in texts])).collect()
    assert len(got) == 800 and sum(asked) <= 800
    assert sum(r.kept for r in got) == len({c for _, _, c, _ in brute(list(enumerate(texts)))})


def test_unlinked_variants_of_a_text_rarely_meet(spark, monkeypatch):
    """Variants that share most of a text but aren't linked: pair rows don't grow with their square."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    pairs = []
    real = N._verify
    monkeypatch.setattr(N, "_verify", lambda p, *a: pairs.append(p.count()) or real(p, *a))
    counts = []
    for m in (40, 80):
        texts = []
        for k in range(m):
            t = list(base)
            for j in rng.sample(range(150), 9):
                t[j] = f"v{k}-{j}"
            texts.append(" ".join(t))
        rows = list(enumerate(texts)) + [(1000, texts[3] + " z"), (1001, texts[4])]
        pairs.clear()
        assert seen(N.near_duplicates(frame(spark, rows), hot=3, large=3)) == brute(rows)
        counts.append(sum(pairs))
    assert counts[1] < 80 * 79 / 2 / 4


def test_a_cluster_of_many_bytes_is_worked_by_joins(spark):
    rows = list(enumerate(copies(random.Random(9), 60, 4, 120)))
    df = frame(spark, rows)
    called = []
    real = N._in_rounds
    N._in_rounds = lambda *a: called.append(1) or real(*a)
    try:
        old, N.LARGE_BYTES = N.LARGE_BYTES, 5000
        N.link_components.__defaults__ = (*N.link_components.__defaults__[:3], 5000)
        assert seen(N.near_duplicates(df)) == brute(rows) and called
    finally:
        N._in_rounds, N.LARGE_BYTES = real, old
        N.link_components.__defaults__ = (*N.link_components.__defaults__[:3], old)


def test_names_that_collide_are_made_anew(spark, monkeypatch):
    rows = list(enumerate(copies(random.Random(2), 30, 4, 60)))
    src = frame(spark, rows)
    real = N.sketch
    monkeypatch.setattr(N, "sketch", lambda df, width: real(df, width).withColumn("node", N.F.col("node") % 7))
    assert seen(N.near_duplicates(src)) == brute(rows)


def test_threshold_of_the_pipeline(spark):
    rows = list(enumerate(copies(random.Random(5), 120, 5, 80)))
    assert seen(N.near_duplicates(frame(spark, rows), 80)) == brute(rows, 80)


def test_query_equals_sql(spark, duck):
    got = seen(QUERIES["op8_setsketch_dedup"](spark, SF))
    want = duck.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({ORACLE['op8_setsketch_dedup']})").fetchall()
    assert got == sorted((str(a), b, str(c), d) for a, b, c, d in want)
