"""Golden vectors (FIXTURES.md section 3) as unit tests of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators import bench as B
from fleetlens.operators import profiles as P
from fleetlens.operators import proxy as X
from fleetlens.operators import sizing as Z
from fleetlens.sources.kv import parse_kv
from fleetlens.sources import logs as LG


def test_disk_round(spark):
    rows = [(558, "network-ssd-nonreplicated"), (930, "network-ssd-io-m3"), (100, "network-ssd-io-m3"),
            (1, "network-ssd-nonreplicated"), (50, "network-ssd"), (0, "network-ssd")]
    df = spark.createDataFrame(rows, "size int, type string")
    got = [r[0] for r in df.select(S.round_disk("size", "type")).collect()]
    assert got == [558, 930, 186, 93, 50, 1]


@pytest.mark.parametrize(
    "cores,mem,data,log,log_on,expected",
    [
        (16, 64, 930, 372, True, ("56G", "4G", "790G", "334G", 16)),
        (8, 32, 930, 279, True, ("28G", "4G", "790G", "251G", 8)),
        (4, 16, 100, None, False, ("12G", "2G", "85G", "36G", 4)),
    ],
)
def test_auto_tune(spark, cores, mem, data, log, log_on, expected):
    df = spark.createDataFrame(
        [(1, "observer", cores, mem, data, log_on, log)],
        "deploy_id long, role string, cores int, memory_gb int, data_size_gb int, log_enabled boolean, log_size_gb int")
    r = P.auto_tune(df).collect()[0]
    assert (r.memory_limit, r.system_memory, r.datafile_size, r.log_disk_size, r.cpu_count) == expected


def test_image_spec_all_empty(spark):
    df = spark.createDataFrame([("", "", "")], "f string, n string, fam string")
    none = F.lit(None).cast("string")
    got = df.select(S.image_spec("f", "n", "fam", none, none, none)).collect()[0][0]
    assert got == "image-folder-id=standard-images,image-family=ubuntu-2204-lts"


def test_zone_region(spark):
    df = spark.createDataFrame([("ru-central1-a",), ("standalone",), ("",)], "z string")
    assert [r[0] for r in df.select(S.zone_region("z")).collect()] == ["ru-central1", "standalone", ""]


def test_inventory_kv_last_wins(spark):
    df = spark.createDataFrame([(1, 1, "A=1"), (1, 2, "A = 2"), (1, 3, "B=x=y"), (1, 4, "noise")],
                               "file_id int, line_no int, line string")
    got = {r.key: r.value for r in parse_kv(df).collect()}
    assert got == {"A": "2", "B": "x=y"}


def test_marker_kv_first_wins(spark):
    df = spark.createDataFrame([(1, 1, "role=a"), (1, 2, "role=b\r")], "file_id int, line_no int, line string")
    got = {r.key: r.value for r in parse_kv(df, keep="first", defaults={"role": None, "data_mount": "/ob-data"}).collect()}
    assert got == {"role": "a", "data_mount": "/ob-data"}


def test_marker_no_file_no_rows(spark):
    df = spark.createDataFrame([], "file_id int, line_no int, line string")
    assert parse_kv(df, keep="first", defaults={"role": "x"}).count() == 0


def test_host_log_name(spark):
    df = spark.createDataFrame([("vm-1.ru-central1.internal",)], "h string")
    assert df.select(S.host_log_name(F.lit("observer"), F.col("h"))).collect()[0][0] == \
        "observer-vm-1_ru-central1_internal.log"


def test_health_state_golden(spark):
    seq = [False, False, False, True, True, False, False, True, False]
    df = spark.createDataFrame([(0, i, ok) for i, ok in enumerate(seq)], "backend_id int, probe_no long, ok boolean")
    got = [r.state for r in X.health_state(df, chunk_size=2).orderBy("probe_no").collect()]
    assert got == ["up", "up", "down", "down", "up", "up", "up", "up", "up"]


def test_tx_total_golden(spark):
    ok = {"NewOrder": 394897, "Delivery": 35962, "OrderStatus": 35239, "Payment": 381490, "StockLevel": 35861}
    summary = spark.createDataFrame([(0, t, n, 5 if t == "NewOrder" else 0) for t, n in ok.items()],
                                    "run_id int, tx_type string, ok_count long, failed_count long")
    tot = summary.groupBy("run_id").agg(F.sum("ok_count").alias("ok"), F.sum("failed_count").alias("failed"))
    assert tuple(tot.collect()[0])[1:] == (883449, 5)


def test_tx_total_row_equals_sum(spark):
    from fleetlens.fixtures import fixture

    tx = fixture(spark, "/root/testdata/sf0.001", "fx_tx")
    t = B.tx_summary(tx, total=True)
    tot = {r.run_id: r.ok_count for r in t.where("tx_type = 'TOTAL'").collect()}
    parts = {r.run_id: r.s for r in t.where("tx_type <> 'TOTAL'").groupBy("run_id").agg(F.sum("ok_count").alias("s")).collect()}
    assert tot == parts


def test_tpmc_and_efficiency(spark):
    # 280421 committed new orders in the measured 600.046 s
    tx = spark.range(280421).select(F.lit(0).alias("run_id"), F.lit("NewOrder").alias("tx_type"),
                                    F.lit(True).alias("ok"))
    assert abs(B.tpmc(tx, 600.0462).collect()[0].tpmc - 28039.94) < 0.01
    runs = spark.createDataFrame([(0, 2400), (1, 3400)], "run_id int, warehouses int")
    tp = spark.createDataFrame([(0, 28039.94), (1, 39489.0)], "run_id int, tpmc double")
    eff = {r.run_id: r.efficiency_pct for r in B.efficiency(tp, runs).collect()}
    assert round(eff[0], 2) == 90.85 and round(eff[1], 2) == 90.31


def test_measured_window_bounds(spark):
    rows = [(0, dt.datetime(2024, 1, 1, 0, 4, 59), "NewOrder", True),
            (0, dt.datetime(2024, 1, 1, 0, 5, 0), "NewOrder", True),
            (0, dt.datetime(2024, 1, 1, 0, 14, 59), "NewOrder", True),
            (0, dt.datetime(2024, 1, 1, 0, 15, 0), "NewOrder", True)]
    df = spark.createDataFrame(rows, "run_id int, ts timestamp_ntz, tx_type string, ok boolean")
    w = B.measured_window(df, "2024-01-01 00:00:00", 300, 600)
    assert w.count() == 2


def test_scale_capacity_golden(spark):
    t = spark.createDataFrame([(1, 25000, 16, 64), (2, 25000, 32, 128)],
                              "target_id int, warehouses int, node_cores int, node_memory_gb int")
    cap = {r.target_id: r for r in Z.scale_capacity(t).collect()}
    assert round(cap[1].k, 2) == 10.42
    assert round(cap[1].vcpu_need) == 500 and round(cap[1].memory_need_gb) == 2000
    assert cap[1].nodes == 33 and cap[2].nodes == 18
    ceil = {r.target_id: r for r in Z.tpmc_ceiling(t).collect()}
    assert round(ceil[1].max_tpmc) == 321500 and round(ceil[1].expected_tpmc) == 289350
    bp = {r.target_id: r for r in Z.bench_params(Z.scale_capacity(t)).collect()}
    assert bp[1].partitions == 198 and bp[1].inflight == 5200
    head = {r.target_id: r for r in Z.variant_headroom(Z.scale_capacity(t)).collect()}
    assert round(head[1].cpu_headroom_pct, 1) == 5.6


# Published result lines, as parse input.
RESULT_LOG = """2026-07-21T10:17:34.248 info: === TPC-C Results ===
2026-07-21T10:17:34.248 info:   Scale: 2400 warehouses
2026-07-21T10:17:34.248 info:   Measured Duration: 600.0s (configured: 600s)
2026-07-21T10:17:34.248 info:   New-Order Throughput: 28039.94 tpmC
2026-07-21T10:17:34.248 info:   Efficiency: 90.8%
2026-07-21T10:17:34.248 info:   Total Failed: 0
2026-07-21T10:17:34.248 info:   NewOrder: OK=280421 Failed=0 p50=1665ms p90=8192ms p99=8192ms
2026-07-21T10:17:34.248 info:   Delivery: OK=25331 Failed=0 p50=2042ms p90=8192ms p99=8192ms"""


def _lines(spark, text):
    return spark.createDataFrame([(0, i, line) for i, line in enumerate(text.splitlines())],
                                 "run_id int, line_no int, line string")


def test_result_log_parse(spark):
    lines = _lines(spark, RESULT_LOG)
    tx = {r.tx_type: r for r in LG.parse_result_log(lines).collect()}
    assert tx["NewOrder"].ok_count == 280421 and tx["NewOrder"].p50 == 1665 and tx["Delivery"].p99 == 8192
    f = LG.parse_result_facts(lines).collect()[0]
    assert (f.warehouses, f.measured_s, f.tpmc, f.efficiency_pct, f.total_failed) == (2400, 600.0, 28039.94, 90.8, 0)


# A published result table, as parse input.
RESULT_TABLE = """┌─────────────┬────────┬────────┐
│ Transaction │ OK     │ Failed │ p50, ms │ p90, ms │ p99, ms │
├─────────────┼────────┼────────┤
│ NewOrder    │ 394897 │ 5      │ 1963    │ 2842    │ 3640    │
├─────────────┼────────┼────────┤
│ TOTAL       │ 883449 │ 5      │         │         │         │
└─────────────┴────────┴────────┘

warehouses: 3400
tpmC: 39489*
efficiency: 90.31%"""


def test_result_table_parse(spark):
    rows, foot = LG.parse_result_table(_lines(spark, RESULT_TABLE))
    r = {x.tx_type: x for x in rows.collect()}
    assert r["NewOrder"].p99 == 3640 and r["TOTAL"].is_total and r["TOTAL"].p50 is None
    f = {x.key: (x.value, x.starred) for x in foot.collect()}
    assert f["tpmC"] == ("39489", True) and f["warehouses"] == ("3400", False) and f["efficiency"][0] == "90.31%"


def test_approx_percentiles_within_rank_error(spark):
    """#63 against the exact values: each approximate percentile is a value whose rank is
    within n / accuracy of the wanted rank."""
    from fleetlens.fixtures import fixture

    tx = fixture(spark, "/root/testdata/sf0.01", "fx_tx")
    acc = 100
    approx = {(r.run_id, r.tx_type): r for r in B.tx_percentiles(tx, approx=True, accuracy=acc).collect()}
    vals = {}
    for r in tx.select("run_id", "tx_type", "latency_ms").collect():
        vals.setdefault((r.run_id, r.tx_type), []).append(r.latency_ms)
    for k, v in vals.items():
        v.sort()
        n = len(v)
        for p, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
            got = getattr(approx[k], name)
            lo = sum(1 for x in v if x < got)
            hi = sum(1 for x in v if x <= got)
            want = p * n
            assert lo - n / acc - 1 <= want <= hi + n / acc + 1, (k, name, got)


def test_config_get_rules(spark):
    from fleetlens.sources.config import config_get

    doc = '{"a": {"b": true, "c": null, "n": 22, "s": "x"}, "e": ""}'
    df = spark.createDataFrame([(doc,)], "doc string")
    got = df.select(*[config_get("doc", p).alias(str(i)) for i, p in
                      enumerate(["a.b", "a.c", "a..n", "a.s", "a.missing", "a.s.deeper", "e", ".a.n."])]).collect()[0]
    assert tuple(got) == ("true", "", "22", "x", "", "", "", "22")
    broken = spark.createDataFrame([('{"a":',)], "doc string").select(config_get("doc", "a").alias("x"))
    assert broken.collect()[0].x == ""


def test_yaml_rejects_and_frames(spark):
    from fleetlens.sources.config import config_frames, read_config_docs

    good = """
deployment: {name: prod}
vm_defaults: {platform: p1, data_disk: {type: t, size_gb: 5}}
vm_profiles:
  observer: {count: 3, cores: 8, data_disk: {enabled: true, mount_point: /d}}
  obproxy: {count: 0}
oceanbase: {ports: {mysql: 3306}, components: {obagent: false}, memory_limit: 9G}
ocp: {meta_tenant: {max_cpu: 4}}
"""
    docs = spark.createDataFrame([(1, good), (2, "a: 2024-13-45"), (3, "a: ["), (4, ""), (5, "- 1"), (6, None)], "deploy_id long, doc string")
    deploy, profiles, rejects = config_frames(read_config_docs(docs))
    assert {r.deploy_id for r in rejects.collect()} == {2, 3, 5}
    d = {r.deploy_id: r for r in deploy.collect()}
    assert set(d) == {1, 4, 6}
    assert (d[1].deploy_name, d[1].mysql_port, d[1].agent_component, d[1].memory_limit, d[1].meta_max_cpu, d[1].default_data_size_gb) == \
        ("prod", 3306, False, "9G", 4.0, 5)
    p = {r.role_in: r for r in profiles.collect()}
    assert (p["observer"].vm_count, p["observer"].data_mount, p["obproxy"].vm_count, p["obproxy"].cores) == (3, "/d", 0, None)


def test_merge_open_maps(spark):
    df = spark.createDataFrame([({"type": "ssd", "size": "10"}, {"size": "20", "mount": None, "extra": "y"})],
                               "b map<string,string>, o map<string,string>")
    got = df.select(S.merge_open_maps(F.col("b"), F.col("o")).alias("m")).collect()[0].m
    assert got == {"type": "ssd", "size": "20", "extra": "y"}


def test_pick_ip_order(spark):
    rows = [([("", "1.1.1.1"), ("10.0.0.2", None)],), ([(None, None), (None, "2.2.2.2")],), ([],)]
    schema = "ifs array<struct<a:string,n:string>>"
    df = spark.createDataFrame(rows, schema).select(F.transform("ifs", lambda x: F.struct(
        F.struct(x["a"].alias("address"), F.struct(x["n"].alias("address")).alias("one_to_one_nat"))
        .alias("primary_v4_address"))).alias("ifs"))
    assert [r[0] for r in df.select(S.pick_ip("ifs")).collect()] == ["1.1.1.1", "2.2.2.2", ""]


def test_audit_without_observer_profile(spark):
    dep = spark.createDataFrame([(1, "standard-v3", 100)], "deploy_id long, default_platform string, default_core_fraction int")
    prof = spark.createDataFrame([(1, "obproxy", 2, 1, 2)], "deploy_id long, role_in string, vm_count int, cores int, memory_gb int")
    issues = P.audit_profiles(prof, dep, P.alias_frame(spark), P.minimum_frame(spark)).collect()
    rules = sorted((r.role, r.rule, r.severity) for r in issues)
    assert rules == [("obproxy", "min_cores", "ERROR"), ("obproxy", "min_memory", "ERROR"),
                     ("observer", "observer_count", "WARN")]


def test_measured_window_per_run_start(spark):
    rows = [(0, dt.datetime(2024, 1, 1, 0, 4, 59)), (0, dt.datetime(2024, 1, 1, 0, 5, 0)),
            (1, dt.datetime(2024, 1, 1, 1, 5, 0)), (1, dt.datetime(2024, 1, 1, 1, 15, 0))]
    tx = spark.createDataFrame(rows, "run_id int, ts timestamp_ntz")
    starts = spark.createDataFrame([(0, dt.datetime(2024, 1, 1, 0, 0)), (1, dt.datetime(2024, 1, 1, 1, 0))],
                                   "run_id int, start timestamp_ntz")
    w = B.measured_window(tx.join(starts, "run_id"), F.col("start"), 300, 600)
    assert sorted((r.run_id, r.ts.minute) for r in w.collect()) == [(0, 5), (1, 5)]
