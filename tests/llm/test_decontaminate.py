import random

from fleetlens.llm import decontaminate as D
from fleetlens.llm.queries import ORACLE, QUERIES

from .helpers import DOCS, SF, clashing, frame, lower
from .test_license_scan import WORD


def grams(text, item=False):
    """Runs of five words; of an item with fewer the whole sequence, of a document every shorter run."""
    w = WORD.findall(lower(text))
    if item:
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    return {tuple(w[i: i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)}


def brute(docs, items):
    def by(rows, item):
        named = [(f"none{t}" if d is None else d, t) for d, t in rows if t is not None]
        return {d: set().union(*(grams(t, item) for k, t in named if k == d)) for d, _ in named}

    name = lambda d: "None" if isinstance(d, str) else str(d)
    out = []
    have = by(items, True)
    for d, s in by(docs, False).items():
        for i, g in have.items():
            if g and 100 * len(g & s) >= 80 * len(g):
                out.append((name(d), name(i), len(g), len(g & s)))
    return sorted(out)


def seen(df):
    return sorted((str(r.doc_id), str(r.item_id), r.n_item, r.n_common) for r in df.collect())


ITEMS = "item_id long, text string"


def test_planted_items(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((4, 5, 6, 9, 12, 30, 30, 90, 400))]
    items += [(None, items[5][1]), (3, "more words of item three here"), (20, None), (21, "")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.choice((3, 40, 900)))]
        for _, t in rng.sample(items[:9], 2):
            part = t.split()
            for _ in range(rng.randrange(len(part) // 8 + 1)):
                part[rng.randrange(len(part))] = "zz"
            cut = rng.randrange(len(w))
            w[cut:cut] = part
        docs.append((i, rng.choice((" ", "\n", ", ")).join(w).title()))
    docs += DOCS + [(None, "x " + items[6][1]), (1000, items[6][1]), (1000, items[7][1])]
    want = brute(docs, items)
    assert len(want) > 60
    assert seen(D.contaminated(clashing(spark, docs), frame(spark, items, ITEMS))) == want


def test_empty(spark):
    none, one = frame(spark, [], ITEMS), frame(spark, [(1, "a b c d e f")], ITEMS)
    docs = frame(spark, DOCS)
    assert D.contaminated(frame(spark, []), one).count() == 0
    assert D.contaminated(docs, none).count() == 0
    assert D.contaminated(docs, frame(spark, [(1, "not there"), (2, " ,; "), (3, None)], ITEMS)).count() == 0


def test_short_items(spark):
    """An item of fewer than five words is found as its whole word sequence, anywhere in a text."""
    items = [(1, "alpha beta gamma delta"), (2, "alpha"), (3, "gamma, beta"), (4, "one two three four five"), (5, "beta gamma")]
    docs = [(1, "Alpha beta GAMMA delta"), (2, "x alpha, beta; gamma: delta y"), (3, "beta alpha gamma beta"), (4, "one two three four five six"),
            (5, "alpha beta gamma x delta"), (6, "alphabet"), (7, "one two three four")]
    got = seen(D.contaminated(frame(spark, docs), frame(spark, items, ITEMS)))
    assert got == brute(docs, items)
    assert {(d, i) for d, i, _, _ in got} >= {("1", "1"), ("2", "1"), ("2", "2"), ("3", "3"), ("4", "4"), ("1", "5")}
    assert not {("5", "1"), ("6", "2"), ("7", "4")} & {(d, i) for d, i, _, _ in got}


def test_rows_without_an_id_are_documents_of_their_own(spark):
    item = " ".join(f"w{i}" for i in range(20))
    half = item.split()
    docs = [(None, " ".join(half[:12])), (None, " ".join(half[8:])), (None, f"x {item} y"), (None, "clean text without it at all"), (7, " ".join(half[:12])), (7, " ".join(half[8:]))]
    got = seen(D.contaminated(frame(spark, docs), frame(spark, [(1, item), (None, item), (None, "clean text without")], ITEMS)))
    assert got == brute(docs, [(1, item), (None, item), (None, "clean text without")])
    assert [r[:2] for r in got] == [("7", "1"), ("7", "None"), ("None", "1"), ("None", "None"), ("None", "None")]


def test_every_partition_has_a_threshold_of_its_own(spark):
    rng = random.Random(1)
    items = frame(spark, [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n + 4))) for i, n in enumerate([8] * 30 + [64] * 30 + [1000] * 10)], ITEMS)
    named = D._named(items, "item_id", "item", "text")
    rows = D.index(named, [5]).collect()
    per = {}
    for r in rows:
        per.setdefault((r.part, r.item), []).append(r.hash)
        assert r.hash <= r.threshold
    assert {len(v) for (p, _), v in per.items() if p == 3} == {2}  # 8 shingles: 7 of them make 80 %, so one of any two
    assert {len(v) for (p, _), v in per.items() if p == 6} == {13}
    assert {len(v) for (p, _), v in per.items() if p == 9} == {16}
    bound = {r.part: r.threshold for r in rows}
    assert bound[9] < bound[6] < bound[3]


def test_query_equals_sql(spark, duck):
    got = seen(QUERIES["op2_decontaminate"](spark, SF))
    want = duck.sql(f"SELECT doc_id, item_id, n_item, n_common FROM ({ORACLE['op2_decontaminate']})").fetchall()
    assert got == sorted((str(a), str(b), c, d) for a, b, c, d in want) and got
    assert brute(list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())),
                 list(map(tuple, spark.read.parquet(f"{SF}/benchmark.parquet").collect()))) == got


def test_no_python_in_the_plans(spark, monkeypatch):
    """Neither in the last plan nor in those of the tables that are written before it."""
    frames = []
    real = D.stored
    monkeypatch.setattr(D, "stored", lambda df: frames.append(df) or real(df))
    frames.append(QUERIES["op2_decontaminate"](spark, SF))
    assert len(frames) == 4
    plan = "".join(df._jdf.queryExecution().executedPlan().toString() for df in frames)
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
