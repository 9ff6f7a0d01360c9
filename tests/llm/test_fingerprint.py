import hashlib
import random

import numpy as np

from fleetlens.llm import fingerprint as P
from fleetlens.llm.queries import QUERIES

from .helpers import DOCS, SF, clashing, frame, small_docs


def expected(rows):
    """Ordered by descending (id, text); the edited text of each."""
    order = sorted(rows, key=lambda r: (P.LOWEST if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode()), reverse=True)
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        out.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), P.fingerprint(t), P.fingerprint(edited)))
    return sorted(out)


def seen(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in df.collect())


def test_sums():
    a, b = "one two three four\nsecond line here", "third line\nsecond line here"
    assert P.combine(P.fingerprint(a), P.fingerprint(b)) == P.fingerprint(a + "\n" + b)
    assert P.remove(P.fingerprint(a + "\n" + b), P.fingerprint(b)) == P.fingerprint(a)
    assert P.fingerprint("x y\nz") == P.fingerprint("z\nx y") != P.fingerprint("z\nx y\nz")
    assert P.fingerprint(None) == P.fingerprint("") and set(P.fingerprint("")) == {"0"}


def test_lanes_do_not_depend_on_the_batch():
    texts = [t.encode() for t in small_docs().text.head(40)] + [b"", b"\n\n", b" ", b"one", b"a b\nc d e f"]
    equal, near = P.vectors(texts)
    for i, t in enumerate(texts):
        e, n = P.vectors([t])
        assert (e[0] == equal[i]).all() and (n[0] == near[i]).all()


def test_likeness_follows_shared_words():
    rng = random.Random(1)
    text = [f"w{rng.randrange(5000)}" for _ in range(600)]
    other = [f"v{rng.randrange(5000)}" for _ in range(600)]
    docs = [" ".join(text), " ".join(text[:300] + other[:300]), " ".join(other)]
    e, n = P.vectors([d.encode() for d in docs])
    like = P.likeness(e[[0, 0, 0]], n[[0, 0, 0]], e, n)
    assert like[0] == 1.0 and 0.3 < like[1] < 0.7 and like[2] < 0.3


def test_edge_cases(spark):
    assert seen(P.fingerprint_edits(clashing(spark, DOCS))) == expected(DOCS)
    for rows in (DOCS[:1], DOCS[3:5], [(5, "a"), (5, "b"), (5, None)], [(None, "abcd"), (None, "xyz")]):
        assert seen(P.fingerprint_edits(frame(spark, rows))) == expected(rows)
    assert P.fingerprint_edits(frame(spark, [])).count() == 0


def test_query(spark):
    df = small_docs()
    got = QUERIES["op6_fingerprint"](spark, SF)
    assert seen(got) == expected(list(zip(df.doc_id.tolist(), df.text.tolist())))
    g = got.toPandas()
    assert (g.near_edited - g.near_next).mean() > 0.2
    same = df.merge(g, on="doc_id").groupby("text").fingerprint.nunique()
    assert (same == 1).all() and np.isclose(g.near_edited.max(), 1.0, atol=1.0)


def test_scan_equals_edits(spark):
    a = {r.doc_id: r.fingerprint for r in P.fingerprint_documents(frame(spark, DOCS[:8])).collect()}
    assert all(a[d] == P.fingerprint(t) for d, t in DOCS[:8])


def near_sums(text):
    """The near lanes in whole numbers, from one line of each kind."""
    out = np.zeros(P.NEAR)
    for line in set(text.split("\n")) - {""}:
        out += text.split("\n").count(line) * P.vectors([line.encode()])[1][0].astype(np.int32)
    return out


def test_likeness_of_a_line_repeated_very_often():
    for times in (40_000, 100_000):
        check_repeated("one line of five words", times)


def check_repeated(line, times):
    text = "\n".join([line] * times)
    edited = text[: len(text) // 2] + "\nand another end"
    e, n = P.vectors([text.encode(), edited.encode()])
    a, b = near_sums(text), near_sums(edited)
    want = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
    assert want > 0.99 and np.isclose(P.likeness(e[:1], n[:1], e[1:], n[1:])[0], want)
    assert (n[0].astype(np.int32) == a).all() and P.remove(P.combine(P.fingerprint(text), P.fingerprint(line)), P.fingerprint(line)) == P.fingerprint(text)
