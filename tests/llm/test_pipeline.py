import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from fleetlens.llm import bpe

from .helpers import SF, clashing, small_docs, words
from .test_decontaminate import brute as brute_items
from .test_near_dedup import brute as brute_near
from .test_substring_dedup import brute as brute_words

LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")),
                            special_tokens={})


def brute(rows, items):
    rows = [(d, t) for d, t in rows if t and any(map(str.isalpha, t))]
    kept = {d for d, _, _, k in brute_near(rows, 80) if k}
    rows = [(d, t) for d, t in rows if str(d) in kept]
    gone = {d: (n, h) for d, _, n, h in brute_words(rows)}
    rows = [(d, t if not gone[str(d)][0] else cut(rows, d)) for d, t in rows]
    found = {d for d, _, _, _ in brute_items(rows, items)}
    out = []
    for d, t in rows:
        if str(d) not in found:
            ids = LIBRARY.encode_ordinary(t)
            out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def cut(rows, doc):
    """The kept words of one document, by definition."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            first[tuple(w[i: i + 13])] = min(d, first.get(tuple(w[i: i + 13]), d))
    w = words(dict(rows)[doc])
    gone = {j for i in range(len(w) - 12) if first[tuple(w[i: i + 13])] < doc for j in range(i, i + 13)}
    return " ".join(x for j, x in enumerate(w) if j not in gone)


def test_run_equals_brute_force(spark):
    df = small_docs()
    items = list(map(tuple, spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == brute(list(zip(df.doc_id.tolist(), df.text.tolist())), items)
    assert 0 < len(got) < len(df)


def test_stages_survive_edge_cases(spark):
    from .helpers import DOCS

    docs = clashing(spark, DOCS)
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= len(DOCS)
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == len(DOCS) and last(spark, docs.limit(0), SF).count() == 0


def _kept(spark, stage, rows):
    from .helpers import frame

    return sorted((tuple(r) for r in dict(corpus_pipeline.STAGES)[stage](spark, frame(spark, rows), SF).collect()), key=str)


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"}
    rows = [(1, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["c"]), (None, text["c"]),
            (7, text["d"]), (7, text["d"]), (7, text["e"]), (9, text["e"]), (None, None), (None, ""), (7, "")]
    want = [(1, text["a"]), (None, text["b"]), (None, text["c"]), (7, text["d"]), (7, text["e"]), (None, None), (None, ""), (7, "")]
    assert _kept(spark, "near_dedup", rows) == sorted(want, key=str)

    part = " ".join(f"p{i}" for i in range(20))
    rows = [(7, f"{part} one two"), (7, f"three four {part}"), (None, f"{part} five"), (None, f"six {part}"), (None, text["f"]), (7, "x  y")]
    got = _kept(spark, "substring_dedup", rows)
    assert len(got) == 6 and sum(part in t for _, t in got) == 1  # one row holds the passage, whichever of the two comes first
    assert next(d for d, t in got if part in t) == 7 and {(None, "five"), (None, "six"), (None, text["f"]), (7, "x  y")} <= set(got)

    half = len(item.split()) // 2 + 2
    rows = [(None, f"aa {item} bb"), (None, text["f"]), (5, f"{item}"), (5, text["g"]), (6, " ".join(item.split()[:half])),
            (6, " ".join(item.split()[half - 4:]))]
    assert _kept(spark, "decontamination", rows) == sorted([(None, text["f"]), (5, text["g"]), *rows[4:]], key=str)


def test_run_keeps_clean_rows_without_an_id(spark, tmp_path):
    """Ids gone from a third of the rows: only what is flagged for itself goes."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(got) >= 0.95 * len(whole) and sum(d is None for d in got) >= 0.8 * sum(d % 3 == 0 for d in whole)


def test_stages_keep_columns_of_any_name(spark):
    from .helpers import frame

    rows = [(1, "one two three four five six seven", "a", 5, 7), (2, "one two three four five six seven", "b", 6, 8), (None, "other words of another text", "c", None, 9)]
    docs = frame(spark, rows, "doc_id long, text string, row_key string, row int, gone int")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert sorted(map(tuple, dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()), key=str) == sorted([rows[0], rows[2]], key=str)
