import itertools
import math
import zlib
from collections import Counter

import numpy as np

from fleetlens.llm import lm as M
from fleetlens.llm.queries import QUERIES

from .helpers import DOCS, SF, clashing, frame, lower, small_docs, words

rng = np.random.default_rng(3)


def model(states=3):
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return M.Hmm(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, M.CLASSES))))


def paths(h, sym):
    """Probability of every state path of a short sequence."""
    for path in itertools.product(range(len(h.start)), repeat=len(sym)):
        p = h.start[path[0]] * h.emit[path[0], sym[0]]
        for t in range(1, len(sym)):
            p *= h.move[path[t - 1], path[t]] * h.emit[path[t], sym[t]]
        yield path, p


def test_forward_and_counts_against_all_paths():
    h = model()
    seqs = [rng.integers(0, M.CLASSES, n) for n in (1, 2, 5, 4)]
    sym, off = np.concatenate(seqs).astype(np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, M.CLASSES))
    for s, got in zip(seqs, M.log_likelihood(h, sym, off)):
        total = sum(p for _, p in paths(h, s))
        assert math.isclose(got, math.log(total), rel_tol=1e-9)
        for path, p in paths(h, s):
            start[path[0]] += p / total
            for t, i in enumerate(path):
                emit[i, s[t]] += p / total
                if t:
                    move[path[t - 1], i] += p / total
    for a, b in zip(M.expected_counts(h, sym, off), (start, move, emit)):
        assert np.allclose(a, b)


def test_blocks_of_long_sequences():
    h = model(4)
    lengths = (1, 63, 64, 65, 128, 1000, 5000)
    seqs = [rng.integers(0, M.CLASSES, n).astype(np.uint8) for n in lengths]
    off = np.concatenate([[0], np.cumsum(lengths)])
    got = M.log_likelihood(h, np.concatenate(seqs), off)
    counts = M.expected_counts(h, np.concatenate(seqs), off)
    total = np.zeros((4, M.CLASSES))
    for s, x in zip(seqs, got):
        v, out, alphas = h.start * h.emit[:, s[0]], 0.0, []
        for t in range(len(s)):
            if t:
                v = (v @ h.move) * h.emit[:, s[t]]
            out += math.log(v.sum())
            v = v / v.sum()
            alphas.append(v)
        assert math.isclose(out, x, rel_tol=1e-9)
        beta = np.ones(4)
        for t in range(len(s) - 1, -1, -1):
            g = alphas[t] * beta
            total[:, s[t]] += g / g.sum()
            beta = h.move @ (h.emit[:, s[t]] * beta)
            beta /= beta.sum()
    assert np.allclose(counts[2], total) and np.isclose(counts[1].sum(), sum(lengths) - len(lengths))


def base(rows, held):
    tokens = lambda t: [*words(lower(t)), None]
    c = Counter(x for (d, t), out in zip(rows, held) if not out for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(d), out, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
                   round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for (d, t), out in zip(rows, held))


def seen(df):
    rows = df.collect()
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in rows)
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def test_query_against_brute_force(spark):
    df = small_docs()
    rows = list(zip(df.doc_id.tolist(), df.text.tolist()))
    out = QUERIES["op10_hmm_score"](spark, SF)
    assert seen(out) == base(rows, [held(d) for d, _ in rows])
    got = out.toPandas()
    assert got.score.sum() > got.base_score.sum()  # the states say more than the words alone
    alike = got[got.held_out]
    assert alike.score.sum() > alike.base_score.sum()


def test_training_raises_likelihood(spark):
    df = small_docs()
    rows = frame(spark, list(zip(df.doc_id.tolist(), df.text.tolist())))
    scores = [M.score_documents(rows, M.F.lit(False), rounds=r).toPandas().score.sum() for r in (0, 1, 4)]
    assert scores[0] < scores[1] < scores[2]


def test_edge_cases(spark):
    assert seen(M.held_out_scores(clashing(spark, DOCS))) == base(DOCS, [held(d) for d, _ in DOCS])
    assert M.held_out_scores(frame(spark, [])).count() == 0
    only = [(1, "a b"), (2, None)]
    assert seen(M.score_documents(frame(spark, only), M.F.lit(True))) == base(only, [True, True])


def test_counts_beyond_32_bits_come_back_whole():
    import pyarrow as pa

    h, most = np.array([11, 12], np.uint64).tobytes(), np.array([0xFFFFFFFF, 5], np.uint32)
    sent = pa.table({"bucket": [0, 0, 0], "shard": [1, 2, 3], "h": [h] * 3, "counts": [M.planes(most)] * 3, "classes": [bytes([1, 2])] * 3})
    got = M._count(sent).to_pylist()
    for row in got[:3]:
        assert M.from_planes(row["counts"], np.int64).tolist() == [3 * 0xFFFFFFFF, 15]
    assert [r["tokens"] for r in got[3:]] == [3 * 0xFFFFFFFF, 15]
