import hashlib
import random

import numpy as np

from fleetlens.llm import substring_dedup as S
from fleetlens.llm.passages import NO_ID
from fleetlens.llm.queries import ORACLE, QUERIES

from .helpers import DOCS, SF, clashing, frame, words


def brute(rows, window=S.WINDOW):
    rows = [(NO_ID if d is None else d, words(t)) for d, t in rows]
    first = {}
    for d, w in rows:
        for i in range(len(w) - window + 1):
            g = tuple(w[i: i + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, w in rows:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i: i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(None if d == NO_ID else d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def seen(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def passages(rng, n):
    """Documents that share passages of many lengths, cut and glued so that they straddle."""
    vocabulary = [f"w{i}" for i in range(60)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice((5, 11, 12, 13, 14, 30, 80)))] for _ in range(25)]
    docs = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(8)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            w += rng.choice((p, p[a:], p[:a], [rng.choice(vocabulary) for _ in range(rng.randrange(9))]))
        docs.append(rng.choice((" ", "\n", " \t")).join(w))
    return docs


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    texts = passages(rng, 150)
    rows = list(zip(rng.sample(range(-500, 10**6), 150), texts)) + [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[2])]
    want = brute(rows)
    assert sum(x[2] > 0 for x in want) > 60
    assert seen(S.remove_passages(frame(spark, rows).repartition(9))) == want


def test_edge_cases(spark):
    assert seen(S.remove_passages(clashing(spark, DOCS))) == brute(DOCS)
    assert S.remove_passages(frame(spark, [])).count() == 0
    docs = clashing(spark, DOCS)
    kept = S.rewrite_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    kept = {r.doc_id: r for r in kept.collect()}
    assert kept[8].text == DOCS[9][1] and kept[6].text == "" and kept[1].text == "" and kept[8].hashes == [1]


def test_factors():
    at, ref, ref_at = np.array([3, 4, 5, 6, 20]), np.array([1, 1, 2, 2, 1]), np.array([10, 11, 0, 1, 12])
    starts, ends = S.factorize(at, ref, ref_at, 13)
    assert starts.tolist() == [3, 5, 20] and ends.tolist() == [17, 19, 33]


def test_query_equals_sql(spark, duck):
    got = seen(QUERIES["op5_substring_dedup"](spark, SF))
    want = duck.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({ORACLE['op5_substring_dedup']})").fetchall()
    assert got == sorted((str(a), b, c, d) for a, b, c, d in want)
    assert got == brute(list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())))
