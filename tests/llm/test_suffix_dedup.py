import hashlib
import random

from fleetlens.llm import suffix_dedup as S
from fleetlens.llm.passages import NO_ID
from fleetlens.llm.queries import ORACLE, QUERIES

from .helpers import DOCS, SF, clashing, frame


def brute(rows):
    rows = [(NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            g = b[i: i + 50]
            first[g] = min(d, first.get(g, d))
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i: i + 50]] < d:
                gone[i: i + 50] = b"\1" * 50
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(None if d == NO_ID else d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def seen(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def glued(rng, n):
    pool = ["".join(rng.choice("abcé 漢\n") for _ in range(rng.choice((20, 48, 49, 50, 51, 70, 300)))) for _ in range(20)]
    pool += ["=" * 60, "=" * 200, "ab" * 60, "na na " * 30]
    docs = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(7)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            t += rng.choice((p, p[a:], p[:a], "".join(rng.choice("xyz") for _ in range(rng.randrange(30)))))
        docs.append(t)
    return docs


def test_strings_against_brute_force(spark):
    rng = random.Random(4)
    texts = glued(rng, 160)
    rows = list(zip(rng.sample(range(-500, 10**6), 160), texts)) + [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[2])]
    want = brute(rows)
    assert sum(x[2] > 0 for x in want) > 80
    assert seen(S.remove_strings(frame(spark, rows).repartition(9))) == want


def test_edge_cases(spark):
    assert seen(S.remove_strings(clashing(spark, DOCS))) == brute(DOCS)
    assert S.remove_strings(frame(spark, [])).count() == 0


def test_query_equals_sql(spark, duck):
    got = seen(QUERIES["op4_suffix_dedup"](spark, SF))
    want = duck.sql(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({ORACLE['op4_suffix_dedup']})").fetchall()
    assert got == sorted((str(a), b, c, d, e) for a, b, c, d, e in want)
