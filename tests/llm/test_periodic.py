import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fleetlens.llm import periodic as P
from fleetlens.llm.queries import ORACLE, QUERIES
from fleetlens.llm.text import U64, mix, window_hashes

from .helpers import DOCS, SF, clashing, frame, small_docs, words


def brute_runs(w, least=24, times=3):
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(doc_id, text, edit=True):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None and edit else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (str(doc_id), len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def seen(df):
    return sorted((tuple([str(r.doc_id), *[r[c] for c in COLS[1:]]]) for r in df.collect()), key=str)


def found(w, **k):
    w = np.asarray(w, np.int32)
    h, _, _ = window_hashes(mix(w.astype(U64) + U64(1)), np.array([0, len(w)]), P.overlap(**k))
    return P.document_runs(w, h, **k) if len(h) else []


def test_overlap_is_what_every_run_guarantees():
    assert P.overlap() == 16
    assert all(max(24, 3 * q) - q >= 16 for q in range(1, 500))


def nested(rng):
    """Words in which runs stand inside runs, end beside runs and share their words."""
    unit = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
    out = []
    for _ in range(rng.randrange(1, 5)):
        block = unit * rng.randrange(1, 14) + [rng.randrange(5) for _ in range(rng.randrange(4))]
        out += block * rng.randrange(1, 6)
        if rng.random() < 0.3:
            unit = [rng.randrange(4)] * rng.randrange(1, 40)
    if rng.random() < 0.5 and out:
        out[rng.randrange(len(out))] = 9
    return out[:900]


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_every_diagonal(seed):
    rng = random.Random(seed)
    some = 0
    for _ in range(60):
        w = nested(rng) if rng.random() < 0.8 else [rng.randrange(2) for _ in range(300)]
        want = brute_runs(w)
        assert found(w) == want
        some += len(want) > 1
    assert some > 10


def test_runs_of_other_lengths():
    rng = random.Random(1)
    for least, times in ((6, 3), (10, 2), (40, 4)):
        for _ in range(30):
            w = nested(rng)[:300]
            assert found(w, least=least, times=times) == brute_runs(w, least, times)


def test_long_periodic_texts_cost_few_steps(monkeypatch):
    """A million equal words, and a line a hundred thousand times, are not enumerated pair by pair."""
    asked = []
    real = P.Diagonals.likely
    monkeypatch.setattr(P.Diagonals, "likely", lambda self, i, lag, k: asked.append(len(i)) or real(self, i, lag, k))
    one = [7] * 1_000_000
    assert found(one) == [(0, 1_000_000, 1)]
    line = list(range(11)) * 100_000
    assert found(line) == [(0, 1_100_000, 11)]
    two = [7] * 300_000 + [8] + [7] * 300_000
    assert found(two) == [(0, 300_000, 1), (300_001, 300_000, 1)]
    assert sum(asked) < 40 * (len(one) + len(line) + len(two))


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in nested(rng))) for i in rng.sample(range(10**6), 120)] + [(5, "a b  a\tb\na b " * 9), (5, "a b  a\tb\na b " * 9)]
    got = seen(P.collapse_edited(frame(spark, rows).repartition(5)))
    assert got == sorted((brute(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 60


def test_edge_cases(spark):
    rows = [(i, t) for i, t in DOCS if len(words(t)) < 1000]
    assert seen(P.collapse_edited(clashing(spark, rows))) == sorted((brute(i, t) for i, t in rows), key=str)
    assert P.collapse_edited(frame(spark, [])).count() == 0
    long = frame(spark, [(1, "the end of the line " * 40_000), (2, "x " * 500_000)])
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.collapsed) for r in P.periodic_runs(long, keep_text=True).collect()}
    assert got == {1: (1, 0, 200_000, 5, "the end of the line"), 2: (1, 0, 500_000, 1, "x")}


def test_query_on_the_small_table(spark):
    docs = [(r.doc_id, r.text) for r in small_docs().itertuples() if len(words(r.text)) < 1500]
    got = {r[0]: r for r in seen(QUERIES["op13_periodic_runs"](spark, SF))}
    assert len(docs) > 150
    for i, t in docs:
        assert got[str(i)] == brute(i, t)


def test_query_equals_sql(spark, duck):
    got = seen(QUERIES["op13_periodic_runs"](spark, SF).select(*COLS))
    want = duck.sql(f"SELECT {', '.join(COLS)} FROM ({ORACLE['op13_periodic_runs']})").fetchall()
    assert got == sorted(((str(r[0]), *r[1:]) for r in want), key=str)
