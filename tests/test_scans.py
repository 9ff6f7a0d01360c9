"""Scans along long keys, rank selection, sketches, large JSON arrays."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import ranks as R
from fleetlens.operators.sequence import carry_last, running_sum
from fleetlens.sources import listings as L
from fleetlens.sources import logs as LG
from fleetlens.sources.json_array import array_elements, read_listing_array


@pytest.mark.parametrize("size", [3, 1000])
def test_last_value_is_carried_over_chunks(spark, size):
    rng = random.Random(size)
    rows = [(k, i, rng.choice([None, None, None, i])) for k in (1, 2) for i in rng.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = {(r.k, r.i): r.last for r in carry_last(df, F.col("v"), "i", F.floor(F.col("i") / size), ("k",)).collect()}
    want, last = {}, {}
    for k, i, v in sorted(rows):
        last[k] = v if v is not None else last.get(k)
        want[k, i] = last[k]
    assert got == want


def test_running_sums_over_chunks(spark):
    rows = [(k, i // 7, i, i % 5 - 1) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, c int, i int, v int")
    got = {(r.k, r.i): r.ahead for r in running_sum(df, F.col("v"), "i", ["c"], ["k"], "ahead").collect()}
    assert got == {(k, i): sum(j % 5 - 1 for j in range(i)) for k in "ab" for i in range(60)}


def test_lines_know_their_step(spark):
    text = ["before", "=== check ===", "[2024-01-01 00:00:01] INFO: a", "plain", "[2024-01-01 00:00:09] ERROR: b", "=== provision ===",
            "[2024-01-01 00:01:00] WARN: c", "=== check ===", "=== empty ==="]
    df = spark.createDataFrame([(7, i, x) for i, x in enumerate(text)], "op_id int, line_no long, line string")
    for size in (1, 2, 100):
        lines = LG.lines_in_steps(LG.parse_step_log(df), chunk_lines=size)
        got = [(r.in_step, r.step_line) for r in lines.orderBy("line_no").collect()]
        assert got == [(None, None)] + [("check", 1)] * 4 + [("provision", 5)] * 2 + [("check", 7), ("empty", 8)]
    times = {r.step_line: (r.step, r.n_lines, r.n_errors, r.n_warnings, r.seconds) for r in LG.step_times(lines).collect()}
    assert times == {None: (None, 1, 0, 0, None), 1: ("check", 4, 1, 0, 8), 5: ("provision", 2, 0, 1, 0), 7: ("check", 1, 0, 0, None), 8: ("empty", 1, 0, 0, None)}


def ranked(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1]


@pytest.mark.parametrize("kind", ["uniform", "powers", "equal", "hot", "few"])
def test_rank_selection(spark, kind):
    rng = random.Random(kind)
    draw = {"uniform": lambda: rng.uniform(-5, 5), "powers": lambda: 10 ** rng.uniform(-300, 300) * rng.choice((-1, 1)), "equal": lambda: 2.5,
            "hot": lambda: rng.choice((1.0, 1.0, 1.0, rng.random())), "few": lambda: float(rng.randrange(3))}[kind]
    rows = [(rng.choice("ab"), draw()) for _ in range(3000)] + [("c", None), ("c", float("nan")), ("d", 4.0), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double")
    ps = (0.001, 0.5, 0.999, 1.0)
    names = R.percentile_names(ps)
    for keys in (["k"], []) if kind == "uniform" else (["k"],):
        got = {(r.k if keys else None): tuple(r[n] for n in names) for r in R.rank_select(df, "v", ps, keys, cells=16, at_most=30).collect()}
        groups = {}
        for k, v in rows:
            if v is not None and math.isfinite(v):
                groups.setdefault(k if keys else None, []).append(v)
        assert got == {k: tuple(ranked(v, p) for p in ps) for k, v in groups.items()}


def test_rank_selection_counts_before_it_gathers(spark):
    """No window holds a group's values: at most a few are ranked, the rest are partial counts."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = R.rank_select(df, "v", (0.5, 0.99), at_most=100)
    plan = got._jdf.queryExecution().toString()
    assert "partial_" in plan
    assert tuple(got.first()) == (ranked([i * 7919 % 200_003 for i in range(200_000)], 0.5), ranked([i * 7919 % 200_003 for i in range(200_000)], 0.99))


def test_sketches_merge_to_the_sketch_of_the_whole(spark):
    rng = random.Random(5)
    rows = [(d, rng.choice("xy"), rng.choice([0, rng.randrange(1, 20), rng.randrange(1, 10**6), None])) for d in range(6) for _ in range(400)]
    df = spark.createDataFrame(rows, "day int, k string, v long")
    for accuracy in (0.01, 0.1):
        parts = R.sketch(df, "v", ["day", "k"], accuracy)
        merged = {r.k: (r.n, r.sketch) for r in R.merge_sketches(parts, ["k"]).collect()}
        whole = {r.k: (r.n, r.sketch) for r in R.sketch(df, "v", ["k"], accuracy).collect()}
        assert merged == whole
        for r in R.sketch_percentiles(R.merge_sketches(parts, ["k"]), (0.1, 0.5, 0.99), ["k"], accuracy).collect():
            values = [v for _, k, v in rows if k == r.k and v is not None]
            for p, got in zip((0.1, 0.5, 0.99), (r.p10, r.p50, r.p99)):
                assert abs(got - ranked(values, p)) <= accuracy * ranked(values, p) * (1 + 1e-9)


def listing(rng, n):
    odd = ['plain', 'a "quoted" one', "}],[{", '\\', '\\"}', 'x\\\\"', "ünï {漢}", '', '"}"', "line\nbreak", "tab\t]"]
    return [{"id": str(i), "name": rng.choice(odd), "status": "RUNNING", "labels": {"deployment": rng.choice(odd), rng.choice(odd) or "k": "v"},
             "network_interfaces": [{"primary_v4_address": {"address": f"10.0.0.{j}", "one_to_one_nat": None if j % 2 else {"address": rng.choice(odd)}}}
                                    for j in range(rng.randrange(4))]} for i in range(n)]


def test_large_arrays_are_read_by_many_tasks(spark, scratch):
    rng = random.Random(3)
    os.makedirs(f"{scratch}/arr")
    texts = {"a": json.dumps(listing(rng, 3000)), "b": json.dumps(listing(rng, 40), indent=3, ensure_ascii=False), "c": "[]", "d": " [ ]\n",
             "e": json.dumps(listing(rng, 900), separators=(",", ":")) + "\n"}
    for name, text in texts.items():
        with open(f"{scratch}/arr/{name}.json", "w", encoding="utf-8") as f:
            f.write(text)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        got = read_listing_array(spark, f"{scratch}/arr", L.INSTANCE_SCHEMA)
        from fleetlens.sources.json_array import _pieces
        assert _pieces(spark, f"{scratch}/arr").select("file", "block").distinct().count() > 20
        want = L.read_listing_files(spark, f"{scratch}/arr", L.INSTANCE_SCHEMA).where("name IS NOT NULL")
        cols = ["id", "name", "status", "network_interfaces", F.to_json("labels").alias("labels")]
        assert got.count() == want.count() == 3940
        assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
        numbers = array_elements(spark, f"{scratch}/arr/a.json").agg(F.min("element"), F.max("element"), F.count_distinct("element")).first()
        assert tuple(numbers) == (0, 2999, 3000)
    finally:
        spark.conf.set(key, old)


def test_array_files_are_read_once(spark, scratch):
    """The scans along a file read the written pieces, so the plan does not name the file."""
    from fleetlens.sources import json_array as JA

    with open(f"{scratch}/a.json", "w") as f:
        f.write('[{"id":"1","name":"a }],[{\\""}, {"id":"2","x":{"y":[{}]}}]')
    e = JA.array_elements(spark, f"{scratch}/a.json")
    assert [r.element for r in e.orderBy("element").collect()] == [0, 1]
    assert "a.json" not in "".join(e._jdf.inputFiles())
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 4 and "FileScan text" not in e._jdf.queryExecution().sparkPlan().toString(), plan
