"""Property tests (SURVEY §5 (3))."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators import inventory as I
from fleetlens.operators import proxy as X
from fleetlens.queries import common as C
from fleetlens.fixtures import fixture

SF = "/root/testdata/sf0.001"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=20000), min_size=1, max_size=50))
def test_round_disk_properties(spark, sizes):
    df = spark.createDataFrame([(s,) for s in sizes], "s int")
    got = [r[0] for r in df.select(S.round_disk("s", F.lit("network-ssd-io-m3"))).collect()]
    for s, g in zip(sizes, got):
        base = max(1, s)
        assert g % 93 == 0 and g >= base and g - base < 93
        assert g == max(93, math.ceil(base / 93) * 93)


def test_new_plus_existing_is_desired(spark):
    desired = C.desired(spark, SF)
    listing = fixture(spark, SF, "fx_instance")
    new = I.new_vms(desired, listing).select("name")
    have = desired.join(listing.select("name"), "name", "left_semi").select("name")
    assert new.unionByName(have).distinct().count() == desired.select("name").distinct().count()
    assert new.join(have, "name").count() == 0


def test_scale_out_is_repeatable(spark):
    vms = C.desired(spark, SF).join(fixture(spark, SF, "fx_deployment").select("deploy_id", "deploy_name"), "deploy_id")
    listing = fixture(spark, SF, "fx_instance")
    a = I.scale_out(vms, listing, 2)
    b = I.scale_out(vms, listing, 2)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_health_unchanged_by_repeats(spark):
    """Probes that repeat the current state do not change it."""
    seq = [True] * 5 + [False] * 3 + [False] * 4 + [True] * 2 + [True] * 6
    df = spark.createDataFrame([(1, i, ok) for i, ok in enumerate(seq)], "backend_id int, probe_no long, ok boolean")
    states = [r.state for r in X.health_state(df, chunk_size=3).orderBy("probe_no").collect()]
    assert states[:7] == ["up"] * 7
    assert states[7:13] == ["down"] * 6
    assert states[13:] == ["up"] * 7


def test_health_chunking_does_not_matter(spark):
    probes = fixture(spark, SF, "fx_probe")
    a = X.health_state(probes, chunk_size=50).select("backend_id", "probe_no", "state")
    b = X.health_state(probes, chunk_size=10_000_000).select("backend_id", "probe_no", "state")
    assert a.exceptAll(b).count() == 0


def test_round_robin_chunking_does_not_matter(spark):
    conns = fixture(spark, SF, "fx_conn").select("conn_id", "ts")
    a = X.assign_round_robin(conns, 3, chunk=F.date_trunc("minute", "ts"))
    b = X.assign_round_robin(conns, 3, chunk=F.lit(0))
    assert a.exceptAll(b).count() == 0


def _health_reference(oks, fall=3, rise=2):
    """The state machine probe by probe (the sequential definition)."""
    state, run_val, run_len, out = "up", None, 0, []
    for ok in oks:
        run_len = run_len + 1 if ok == run_val else 1
        run_val = ok
        if not ok and run_len == fall:
            state = "down"
        elif ok and run_len == rise:
            state = "up"
        out.append(state)
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=40), min_size=1, max_size=3),
       st.integers(min_value=1, max_value=7), st.integers(min_value=1, max_value=3))
def test_health_state_matches_sequential_definition(spark, backends, chunk, gap):
    rows, want = [], {}
    for b, oks in enumerate(backends):
        nos = [i * gap for i in range(len(oks))]  # probe numbers with gaps
        rows += [(b, n, ok) for n, ok in zip(nos, oks)]
        want.update({(b, n): s for n, s in zip(nos, _health_reference(oks))})
    df = spark.createDataFrame(rows, "backend_id int, probe_no long, ok boolean")
    got = {(r.backend_id, r.probe_no): r.state for r in X.health_state(df, chunk_size=chunk).collect()}
    assert got == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=5000), min_size=1, max_size=60), st.integers(2, 5))
def test_round_robin_matches_sequential_definition(spark, seconds, n):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "conn_id long, ts timestamp_ntz")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {cid: k % n for k, (cid, _) in enumerate(order)}
    got = {r.conn_id: r.backend for r in X.assign_round_robin(df, n).collect()}
    assert got == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 10 * 86400)), min_size=1, max_size=60))
def test_idle_sessions_match_sequential_definition(spark, events):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"c{c}", t0 + dt.timedelta(seconds=s)) for c, s in events]
    want = set()
    for c in {r[0] for r in rows}:
        ts = sorted(t for k, t in rows if k == c)
        start, last, n = ts[0], ts[0], 0
        for t in ts:
            if (t - last).total_seconds() >= 86400:
                want.add((c, start, last + dt.timedelta(days=1), n))
                start, n = t, 0
            last, n = t, n + 1
        want.add((c, start, last + dt.timedelta(days=1), n))
    df = spark.createDataFrame(rows, "client_ip string, ts timestamp_ntz")
    got = {tuple(r) for r in X.idle_sessions(df).collect()}
    assert got == want


def _retry_reference(classes, max_tries=60, sleep_s=10):
    tries = 0
    for c in classes:
        if c != "rate_limited":
            return ("success" if c == "ok" else "failed", tries + 1, tries * sleep_s)
        tries += 1
        if tries >= max_tries:
            return ("gave_up", max_tries, max_tries * sleep_s)
    return ("incomplete", tries, tries * sleep_s)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["rl", "rl", "rl", "err", "ok"]), min_size=1, max_size=15),
                min_size=1, max_size=4), st.integers(1, 6))
def test_retry_outcome_matches_sequential_definition(spark, ops, max_tries):
    text = {"rl": "The limit on maximum number of active operations has exceeded", "err": "ERROR: x", "ok": "done"}
    cls = {"rl": "rate_limited", "err": "error", "ok": "ok"}
    rows = [(op, i, text[c]) for op, seq in enumerate(ops) for i, c in enumerate(seq)]
    df = spark.createDataFrame(rows, "op_id int, line_no int, line string")
    got = {r.op_id: (r.outcome, r.attempts, r.waited_s) for r in I.retry_outcome(df, max_tries=max_tries).collect()}
    want = {op: _retry_reference([cls[c] for c in seq], max_tries) for op, seq in enumerate(ops)}
    assert got == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B", " A", "role"]), st.sampled_from(["=", " = ", "", "=x="]),
                          st.sampled_from(["1", "v w", "", "\r"])), min_size=1, max_size=12))
def test_kv_parsing_matches_definitions(spark, parts):
    from fleetlens.sources.kv import parse_kv

    lines = [k + sep + v for k, sep, v in parts]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file_id int, line_no int, line string")
    last = {}
    for x in lines:  # inventory rule: split at the first '=', trim, last wins
        if "=" in x:
            k, v = x.split("=", 1)
            last[k.strip()] = v.strip()
    assert {r.key: r.value for r in parse_kv(df).collect()} == last
    defaults = {"A": "dflt", "role": None}
    first = {}
    for k in defaults:  # marker rule: CR removed, exact 'key=' prefix, first wins, else default
        first[k] = next((x.replace("\r", "")[len(k) + 1:] for x in lines if x.replace("\r", "").startswith(k + "=")),
                        defaults[k])
    got = {r.key: r.value for r in parse_kv(df, keep="first", defaults=defaults).collect()}
    assert got == first


# Hand-worked cases: profile folder, name, family, then the deployment's; the text that follows.
IMAGE_SPECS = [
    ((None, None, None, None, None, None), "image-folder-id=standard-images,image-family=ubuntu-2204-lts"),
    (("", "", "", "", "", ""), "image-folder-id=standard-images,image-family=ubuntu-2204-lts"),
    (("mine", "gold", None, "ours", "silver", "debian-12"), "image-folder-id=mine,image-name=gold"),
    ((None, "", "debian-12", "ours", "silver", None), "image-folder-id=ours,image-name=silver"),
    (("mine", None, "debian-12", "ours", "", "rocky-9"), "image-folder-id=mine,image-family=debian-12"),
    (("", None, "", "ours", None, "rocky-9"), "image-folder-id=ours,image-family=rocky-9"),
]


def test_image_spec_cases(spark):
    df = spark.createDataFrame([r for r, _ in IMAGE_SPECS], "a string, b string, c string, d string, e string, f string")
    got = [r[0] for r in df.select(S.image_spec("a", "b", "c", "d", "e", "f")).collect()]
    assert got == [text for _, text in IMAGE_SPECS]


# Hand-worked cases: cores, memory, data GB, log disk on, log GB; limit, system, datafile, log, cpus.
TUNED = [
    ((4, 16, 100, False, None), ("12G", "2G", "85G", "36G", 4)),
    ((16, 64, None, True, 279), ("56G", "4G", "85G", "251G", 16)),
    ((2, 2, 10, True, 0), ("4G", "2G", "20G", "15G", 2)),
    ((8, 33, 1000, True, 10), ("29G", "4G", "850G", "15G", 8)),
    ((1, 256, 93, None, 500), ("224G", "4G", "79G", "672G", 1)),
]


def _tuned(spark, rows):
    from fleetlens.operators import profiles as P

    df = spark.createDataFrame([(i, "observer", *r) for i, r in enumerate(rows)],
                               "deploy_id long, role string, cores int, memory_gb int, data_size_gb int, "
                               "log_enabled boolean, log_size_gb int")
    return {r.deploy_id: (r.memory_limit, r.system_memory, r.datafile_size, r.log_disk_size, r.cpu_count)
            for r in P.auto_tune(df).collect()}


def test_auto_tune_cases(spark):
    assert _tuned(spark, [r for r, _ in TUNED]) == {i: t for i, (_, t) in enumerate(TUNED)}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 1024), st.one_of(st.none(), st.integers(1, 20000)),
                          st.booleans(), st.one_of(st.none(), st.integers(0, 20000))), min_size=2, max_size=30))
def test_auto_tune_grows_with_memory(spark, rows):
    rows = sorted(((*rows[0][:1], r[1], *rows[0][2:]) for r in rows), key=lambda r: r[1])  # memory alone differs
    got = _tuned(spark, rows)
    gb = [[int(v[:-1]) for v in got[i][:4]] for i in range(len(rows))]
    assert all(a <= b for x, y in zip(gb, gb[1:]) for a, b in zip(x, y))
    assert all(limit >= 4 and 2 <= system <= 4 and data >= 20 and log >= 15 for limit, system, data, log in gb)


ROLES = ["observer", "obproxy", "configserver", "monitoring", "ocp"]
# Hand-worked configs and the issues (role, rule) that they raise.
AUDITED = [
    ({}, {("observer", "observer_count")}),
    ({"observer": {"count": 3}}, set()),
    ({"observer": {"count": 2, "cores": 2, "memory_gb": 8}},
     {("observer", "observer_count"), ("observer", "min_cores"), ("observer", "min_memory")}),
    ({"observer": {"count": 3, "data_enabled": True, "data_type": "network-ssd", "data_size_gb": 99}},
     {("observer", "min_data_disk"), ("observer", "data_disk_type")}),
    # 94 GB is rounded to two units of 93 GB before it is judged; 60 GB to one, which is too small
    ({"observer": {"count": 3, "data_enabled": True, "data_type": "network-ssd-nonreplicated", "data_size_gb": 94,
                   "log_enabled": True, "log_type": "network-ssd"}}, {("observer", "log_disk_type")}),
    ({"observer": {"count": 3, "data_enabled": True, "data_type": "network-ssd-nonreplicated", "data_size_gb": 60,
                   "log_enabled": True, "log_type": "network-ssd-io-m3"}}, {("observer", "min_data_disk")}),
    ({"observer": {"count": 3, "log_enabled": True, "log_type": "network-ssd"}}, set()),
    ({"observer": {"count": 3}, "configserver": {"cores": 1}, "monitoring": {"cores": 1}, "ocp": {"memory_gb": 2}}, set()),
    ({"observer": {"count": 3}, "configserver": {"dedicated": True, "cores": 1}, "obproxy": {"memory_gb": 3},
      "monitoring": {"enabled": True, "cores": 3}, "ocp": {"enabled": True, "memory_gb": 15}},
     {("configserver", "min_cores"), ("obproxy", "min_memory"), ("monitoring", "min_cores"), ("ocp", "min_memory")}),
]


_OPT = lambda s: st.one_of(st.none(), s)
PROFILE = st.fixed_dictionaries({}, optional={
    "count": st.integers(0, 5), "enabled": st.booleans(), "dedicated": st.booleans(),
    "cores": st.integers(1, 8), "memory_gb": st.integers(2, 32), "data_enabled": st.booleans(),
    "data_type": st.sampled_from(["network-ssd", "network-ssd-nonreplicated"]),
    "data_size_gb": st.integers(1, 300), "log_enabled": st.booleans(),
    "log_type": st.sampled_from(["network-ssd", "network-ssd-io-m3"])})


def _profile_rows(spark, configs):
    cols = ["count", "enabled", "dedicated", "cores", "memory_gb", "data_enabled", "data_type", "data_size_gb",
            "log_enabled", "log_type"]
    rows = [(d, role, role, *[p.get(c) for c in cols]) for d, cfg in enumerate(configs) for role, p in cfg.items()]
    return spark.createDataFrame(rows, "deploy_id long, role_in string, role string, vm_count int, enabled boolean, "
                                       "dedicated boolean, cores int, memory_gb int, data_enabled boolean, data_type string, "
                                       "data_size_gb int, log_enabled boolean, log_type string")


def _audited(spark, configs):
    from fleetlens.operators import profiles as P

    dep = spark.createDataFrame([(d,) for d in range(len(configs))], "deploy_id long")
    return P.audit_profiles(_profile_rows(spark, configs).drop("role"), dep, P.alias_frame(spark), P.minimum_frame(spark)).collect()


def test_profile_audit_cases(spark):
    got = {d: set() for d in range(len(AUDITED))}
    for r in _audited(spark, [c for c, _ in AUDITED]):
        got[r.deploy_id].add((r.role, r.rule))
    assert got == {d: want for d, (_, want) in enumerate(AUDITED)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(ROLES), PROFILE, max_size=5), min_size=1, max_size=12))
def test_every_issue_breaks_its_rule(spark, configs):
    import re

    for r in _audited(spark, configs):
        low = re.search(r"=(\d+) < (\d+)$", r.message)
        assert (r.severity == "ERROR") == r.rule.startswith("min_")
        if low:
            assert int(low[1]) < int(low[2])
        if r.rule != "observer_count":
            assert r.role in configs[r.deploy_id]


# Hand-worked configs and the VMs queued for a deployment named "prod".
QUEUED = [
    ({}, []),
    ({"observer": {}}, []),
    ({"observer": {"count": 2}, "obproxy": {"count": 0}}, ["observer-1", "observer-2"]),
    ({"obproxy": {"count": 1}, "configserver": {"count": 2}, "monitoring": {"count": 1}, "ocp": {"count": 1}}, ["obproxy-1"]),
    ({"configserver": {"count": 1, "dedicated": True}, "monitoring": {"count": 2, "enabled": True},
      "ocp": {"count": 1, "enabled": True}}, ["configserver-1", "monitor-1", "monitor-2", "ocp-1"]),
    ({"configserver": {"dedicated": True}, "monitoring": {"enabled": True}, "ocp": {"count": 3, "enabled": False}}, []),
]


def test_vm_queue_cases(spark):
    dep = spark.createDataFrame([(d, "prod") for d in range(len(QUEUED))], "deploy_id long, deploy_name string")
    got = {d: set() for d in range(len(QUEUED))}
    for r in I.vm_queue(dep, _profile_rows(spark, [c for c, _ in QUEUED])).collect():
        got[r.deploy_id].add(r.name)
        assert r.name == f"prod-{r.prefix}-{r.idx}"
    assert got == {d: {f"prod-{x}" for x in want} for d, (_, want) in enumerate(QUEUED)}


# Hand-worked profiles (platform, cores, memory, fraction, data GB, data type, count, enabled, dedicated) with the
# defaults of their deployment (platform, fraction), and what they resolve to.
RESOLVED = [
    ((None,) * 9, (None, None), ("standard-v3", 4, 16, 100, None, 1, True, True)),
    ((None,) * 9, ("own-v1", 20), ("own-v1", 4, 16, 20, None, 1, True, True)),
    (("v9", 8, 32, 50, 94, "network-ssd-io-m3", 0, False, False), ("own-v1", 20), ("v9", 8, 32, 50, 186, 0, False, False)),
    ((None, 2, None, None, 94, "network-ssd", 3, None, True), (None, 5), ("standard-v3", 2, 16, 5, 94, 3, True, True)),
    ((None, None, 1, None, 0, "network-ssd-io-m3", None, True, None), (None, None), ("standard-v3", 4, 1, 100, 0, 1, True, True)),
    ((None, None, None, None, 40, "", None, None, None), (None, None), ("standard-v3", 4, 16, 100, 40, 1, True, True)),
]


def test_resolve_cases(spark):
    from fleetlens.operators import profiles as P

    prof = spark.createDataFrame([(i, "observer", *p) for i, (p, _, _) in enumerate(RESOLVED)] + [(0, "nobody", *(None,) * 9)],
                                 "deploy_id long, role_in string, platform string, cores int, memory_gb int, core_fraction int, "
                                 "data_size_gb int, data_type string, vm_count int, enabled boolean, dedicated boolean")
    dep = spark.createDataFrame([(i, *d) for i, (_, d, _) in enumerate(RESOLVED)],
                                "deploy_id long, default_platform string, default_core_fraction int")
    res, rej = P.resolve_profiles(prof, dep, P.alias_frame(spark))
    got = {r.deploy_id: (r.platform, r.cores, r.memory_gb, r.core_fraction, r.data_size_gb, r.vm_count, r.enabled,
                         r.dedicated) for r in res.collect()}
    assert [(r.deploy_id, r.role_in) for r in rej.collect()] == [(0, "nobody")]
    assert got == {i: want for i, (_, _, want) in enumerate(RESOLVED)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["d1", "d2", "d3"]), st.sampled_from(["READY", "CREATING", "DELETING"]),
                          st.booleans()), min_size=0, max_size=20),
       st.sets(st.sampled_from(["d1", "d2", "d3", "d4"]), min_size=1))
def test_disk_listing_rules_match_pollers(spark, listing, wanted):
    """pending = listed rows of wanted names not READY; missing = wanted names not listed;
    state of the latest row per name; new disks = wanted minus live (not DELETING) names."""
    rows = [(i, n, s, [7] if att else []) for i, (n, s, att) in enumerate(listing)]
    disks = spark.createDataFrame(rows, "disk_id long, name string, status string, instance_ids array<long>")
    want = spark.createDataFrame([(1, w) for w in sorted(wanted)], "deploy_id long, disk_name string")
    r = I.pending_disks(disks, want).collect()
    pend = sum(1 for n, s, _ in listing if n in wanted and s != "READY")
    miss = sum(1 for w in wanted if w not in {n for n, _, _ in listing})
    assert [(x.pending, x.missing) for x in r] == [(pend, miss)]
    latest = {}
    for i, (n, s, att) in enumerate(listing):
        latest[n] = (s, att)
    states = {x.name: x.state for x in I.disk_states(disks).collect()}
    assert states == {n: ("deleting" if s == "DELETING" else "attached" if att else "orphan")
                      for n, (s, att) in latest.items()}


def _closure_reference(present, edges):
    """Longest path length from c to every d reachable over edges whose source is present."""
    out = {}

    def walk(start, node, depth):
        for c, d in edges:
            if c == node and c in present:
                out[(start, d)] = max(out.get((start, d), 0), depth)
                walk(start, d, depth + 1)

    for c in present:
        walk(c, c, 1)
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.sets(st.sampled_from(["a", "b", "c", "d", "e"]), min_size=1), min_size=1, max_size=8))
def test_dependency_closure_matches_paths(spark, sets):
    from fleetlens.operators import graph as G

    edges = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d"), ("d", "a")]
    comps = spark.createDataFrame([(i, c) for i, s in enumerate(sets) for c in sorted(s)],
                                  "deploy_id long, component string")
    e = spark.createDataFrame(edges, "component string, depends_on string")
    got = {(r.deploy_id, r.component, r.depends_on): r.depth
           for r in G.component_closure(comps, e)[0].collect()}
    want = {(i, c, d): n for i, s in enumerate(sets) for (c, d), n in _closure_reference(s, edges).items()}
    assert got == want


# Hand-worked deployments: addresses by role, then config server dedicated, monitoring VM, prometheus, grafana,
# management; the hosts of each component.
PLACED = [
    ({"observer": ["a", "b"]}, (False, False, False, False, False),
     {"oceanbase-ce": ["a", "b"], "obagent": ["a", "b"], "ob-configserver": ["a"], "obproxy-ce": ["a"]}),
    ({"observer": ["a", ""], "obproxy": ["p", "q"], "configserver": ["c"], "monitoring": ["m"], "ocp": ["o"]},
     (True, True, True, True, True),
     {"oceanbase-ce": ["a", None], "obagent": ["a", None], "ob-configserver": ["c"], "obproxy-ce": ["p", "q"],
      "prometheus": ["m"], "grafana": ["m"], "ocp-server-ce": ["o"]}),
    # no monitoring VM by profile: prometheus stays with the first observer, grafana follows the listed VM
    ({"observer": ["a"], "monitoring": ["m"]}, (True, False, True, True, True),
     {"oceanbase-ce": ["a"], "obagent": ["a"], "ob-configserver": [None], "obproxy-ce": ["a"], "prometheus": ["a"],
      "grafana": ["m"], "ocp-server-ce": [None]}),
]


def test_component_placement_cases(spark):
    from fleetlens.sinks import documents as D

    inv = [(d, role, i, ip) for d, (vms, _, _) in enumerate(PLACED) for role, ips in vms.items() for i, ip in enumerate(ips, 1)]
    inv_df = spark.createDataFrame(inv, "deploy_id long, role string, idx int, ip string")
    flags = spark.createDataFrame([(d, *f[2:]) for d, (_, f, _) in enumerate(PLACED)],
                                  "deploy_id long, prometheus boolean, grafana boolean, management boolean")
    prof = spark.createDataFrame([(d, r, f[0] if r == "configserver" else None, f[1] if r == "monitoring" else None)
                                  for d, (_, f, _) in enumerate(PLACED) for r in ("configserver", "monitoring")],
                                 "deploy_id long, role string, dedicated boolean, enabled boolean")
    got = {d: {} for d in range(len(PLACED))}
    hosts, rejects = D.component_placement(inv_df, flags, prof)
    assert hosts.where("ip IS NULL").count() == 0
    rows = [(r.idx, r.deploy_id, r.component, r.ip) for r in hosts.collect()] + [(r.idx, r.deploy_id, r.component, None) for r in rejects.collect()]
    for _, d, component, ip in sorted(rows, key=lambda r: r[:3]):
        got[d].setdefault(component, []).append(ip)
    assert got == {d: want for d, (_, _, want) in enumerate(PLACED)}
    why = {(r.deploy_id, r.component): r.reason for r in rejects.collect()}
    assert why == {(1, "oceanbase-ce"): D.NO_ADDRESS, (1, "obagent"): D.NO_ADDRESS, (2, "ob-configserver"): D.NO_ADDRESS, (2, "ocp-server-ce"): D.NO_SERVER}


def test_scrape_targets_cases(spark):
    """Deployment 0 runs prometheus with every role, 1 with one observer, 2 has it off."""
    from fleetlens.sinks import documents as D

    vms = [(0, "observer", 1, "a1"), (0, "observer", 2, "a2"), (0, "obproxy", 1, "p1"), (0, "configserver", 1, "c1"), (0, "monitoring", 1, "m1"),
           (0, "ocp", 1, "o1"), (1, "observer", 1, "b1"), (2, "observer", 1, "x1")]
    inv = spark.createDataFrame([(d, r, i, n, "", f"10.0.0.{k}") for k, (d, r, i, n) in enumerate(vms)],
                                "deploy_id long, role string, idx int, name string, zone string, ip string")
    flags = spark.createDataFrame([(0, True, True), (1, True, True), (2, False, True)], "deploy_id long, prometheus boolean, node_exporter boolean")
    got = sorted((r.deploy_id, r.job_name, r.metrics_path, r.target) for r in D.scrape_targets(inv, flags, flags.select("deploy_id")).collect())
    assert got == sorted([
        (0, "prometheus", "/metrics", "localhost:9090"),
        (0, "node_exporter", "/metrics", "a1:9100"), (0, "node_exporter", "/metrics", "a2:9100"), (0, "node_exporter", "/metrics", "p1:9100"),
        (0, "node_exporter", "/metrics", "c1:9100"), (0, "node_exporter", "/metrics", "m1:9100"),
        (0, "node", "/metrics/node/host", "a1:8088"), (0, "node", "/metrics/node/host", "a2:8088"),
        (0, "ob_basic", "/metrics/ob/basic", "a1:8088"), (0, "ob_basic", "/metrics/ob/basic", "a2:8088"),
        (0, "ob_extra", "/metrics/ob/extra", "a1:8088"), (0, "ob_extra", "/metrics/ob/extra", "a2:8088"),
        (0, "agent", "/metrics/stat", "a1:8088"), (0, "agent", "/metrics/stat", "a2:8088"),
        (1, "prometheus", "/metrics", "localhost:9090"), (1, "node_exporter", "/metrics", "b1:9100"), (1, "node", "/metrics/node/host", "b1:8088"),
        (1, "ob_basic", "/metrics/ob/basic", "b1:8088"), (1, "ob_extra", "/metrics/ob/extra", "b1:8088"), (1, "agent", "/metrics/stat", "b1:8088")])


def test_inventory_lines_of_one_deployment(spark):
    from fleetlens.sinks import documents as D

    prof = _profile_rows(spark, [{"observer": {"count": 2}, "obproxy": {"count": 1}, "configserver": {"count": 1, "dedicated": True},
                                  "monitoring": {"count": 1, "enabled": True}, "ocp": {"count": 1}}, {"observer": {"count": 2}}])
    dep = spark.createDataFrame([(0, "prod", "adm"), (1, "test", None)], "deploy_id long, deploy_name string, ssh_user string")
    inv = I.vm_queue(dep, prof).select("deploy_id", "role", "prefix", "idx", "name", F.lit("").alias("zone"),
                                       F.when((F.col("deploy_id") == 1) & (F.col("idx") == 2), F.lit(""))
                                       .otherwise(F.concat(F.lit("10.0.0."), F.col("idx").cast("string"))).alias("ip"))
    lines, rejects = D.render_inventory(inv, dep, prof)
    rows = lines.orderBy("deploy_id", "section", "idx", "kind").collect()
    assert {r.deploy_id for r in rows} == {0}  # one VM of the other has no address
    assert [r.line for r in rows] == [
        "OBSERVER_1_NAME=prod-observer-1", "OBSERVER_1_IP=10.0.0.1", "OBSERVER_2_NAME=prod-observer-2", "OBSERVER_2_IP=10.0.0.2",
        "OBPROXY_1_NAME=prod-obproxy-1", "OBPROXY_1_IP=10.0.0.1", "CONFIGSERVER_1_NAME=prod-configserver-1",
        "CONFIGSERVER_1_IP=10.0.0.1", "MONITOR_1_NAME=prod-monitor-1", "MONITOR_1_IP=10.0.0.1",
        "OBSERVER_COUNT=2", "OBPROXY_COUNT=1", "CONFIGSERVER_COUNT=1", "MONITOR_COUNT=1", "OCP_COUNT=0",
        "DEPLOY_NAME=prod", "SSH_USER=adm", "CONFIGSERVER_DEDICATED=true"]
    assert {(r.name, r.reason) for r in rejects.collect()} == {
        ("test-observer-1", "withheld: another VM of the deployment has no address"), ("test-observer-2", "no address for VM")}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20000), st.sampled_from(["CREATING", "READY", "RUNNING"])),
                min_size=1, max_size=30), st.integers(1, 30), st.integers(60, 9000))
def test_ready_after_matches_poll_loop(spark, events, poll, timeout):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(r % 2, r, i, t0 + dt.timedelta(seconds=s, microseconds=i), st_) for i, (r, s, st_) in enumerate(events)]
    df = spark.createDataFrame(rows, "deploy_id long, resource_id long, seq long, ts timestamp_ntz, status string")
    got = {r.resource_id: (r.wait_s, r.timed_out) for r in I.ready_after(df, timeout_s=timeout, poll_s=poll).collect()}
    want = {}
    for res in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == res]
        seen = min(r[3] for r in mine)
        ready = [r[3] for r in mine if r[4] in ("READY", "RUNNING", "STOPPED")]
        if not ready:
            want[res] = (None, True)
        else:
            secs = (min(ready) - seen).total_seconds()
            wait = -(-secs // poll) * poll  # rounded up to the poll step
            want[res] = (int(wait), wait > timeout)
    assert got == want


def test_server_overrides_cases(spark):
    """Zones count along the servers of a deployment; an empty address is an error row; '' is a configured user."""
    from fleetlens.sinks import documents as D

    inv = spark.createDataFrame([(0, "observer", 1, "a1", "", "10.0.0.1"), (0, "observer", 2, "a2", "", ""), (0, "observer", 3, "a3", "", "10.0.0.2"),
                                 (1, "observer", 1, "b1", "", "10.0.0.2"), (2, "observer", 1, "c1", "", "10.0.0.3")],
                                "deploy_id long, role string, idx int, name string, zone string, ip string")
    dep = spark.createDataFrame([(0, None, "adm"), (1, "ops", "root"), (2, "", "adm")], "deploy_id long, deploy_user string, ssh_user string")
    got = sorted((r.deploy_id, r.server_name, r.ip, r.zone, r.home_path) for r in D.server_overrides(inv, dep).collect())
    assert got == [(0, "server1", "10.0.0.1", "zone1", "/home/adm/observer"), (0, "server2", None, "zone2", "/home/adm/observer"),
                   (0, "server3", "10.0.0.2", "zone3", "/home/adm/observer"), (1, "server1", "10.0.0.2", "zone1", "/home/ops/observer"),
                   (2, "server1", "10.0.0.3", "zone1", "/home//observer")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "", "null", "img-a", "img-b"]),
                          st.sampled_from([None, "", "null", "fam-x", "fam-y"])), min_size=1, max_size=10),
       st.lists(st.tuples(st.sampled_from(["img-a", "img-c"]), st.sampled_from([None, "fam-x", "fam-y"]),
                          st.sampled_from([None, "fam-x", "fam-y"])), min_size=0, max_size=8))
def test_image_availability_matches_check(spark, wanted, images):
    dep = spark.createDataFrame([(d, n, f) for d, (n, f) in enumerate(wanted)],
                                "deploy_id long, image_name string, image_family string")
    img = spark.createDataFrame(images, "name string, family string, family_id string")
    got = {r.deploy_id: (r.kind, r.wanted, r.matches) for r in I.image_availability(dep, img).collect()}
    want = {}
    for d, (n, f) in enumerate(wanted):
        n = None if n in (None, "", "null") else n
        f = None if f in (None, "", "null") else f
        if n:
            want[d] = ("name", n, sum(1 for i in images if i[0] == n))
        elif f:
            want[d] = ("family", f, sum(1 for i in images if i[1] == f or i[2] == f))
    assert got == want


def test_feature_flags_cases(spark):
    """(ocp_enabled, prometheus_component, profiles) -> management, prometheus, grafana, exporter, production."""
    from fleetlens.operators import profiles as P

    cases = [
        (True, None, {"ocp": {"enabled": True}, "observer": {"count": 3}}, (True, False, False, False, True)),
        (True, None, {"ocp": {"enabled": False}, "observer": {"count": 2}}, (False, False, False, False, False)),
        (None, None, {"ocp": {"enabled": True}, "observer": {}}, (False, False, False, False, True)),
        (False, True, {"observer": {"count": 1}}, (False, True, False, True, False)),
        (None, False, {"monitoring": {"enabled": True}, "observer": {"count": 5}}, (False, True, True, True, True)),
        (None, True, {"monitoring": {}, "observer": {"count": 3}}, (False, True, False, True, True)),
        (True, None, {}, (False, False, False, False, True)),
    ]
    rows = [(d, role, p.get("count"), p.get("enabled"), p.get("dedicated")) for d, (_, _, cfg, _) in enumerate(cases) for role, p in cfg.items()]
    prof = spark.createDataFrame(rows, "deploy_id long, role_in string, vm_count int, enabled boolean, dedicated boolean")
    dep = spark.createDataFrame([(d, o, c) for d, (o, c, _, _) in enumerate(cases)], "deploy_id long, ocp_enabled boolean, prometheus_component boolean")
    resolved, _ = P.resolve_profiles(prof, dep, P.alias_frame(spark), keep_raw=True)
    got = {r.deploy_id: (r.management, r.prometheus, r.grafana, r.node_exporter, r.production_mode) for r in I.feature_flags(dep, resolved).collect()}
    assert got == {d: want for d, (_, _, _, want) in enumerate(cases)}


def test_disks_to_create_cases(spark):
    """Disks of VMs that aren't listed yet, by the role's switches, but not those that are there; a disk that is being deleted isn't."""
    prof = spark.createDataFrame([(0, "observer", 3), (1, "observer", 2), (2, "observer", 1)], "deploy_id long, role string, vm_count int")
    dep = spark.createDataFrame([(0, "p0"), (1, "p1"), (2, "p2")], "deploy_id long, deploy_name string")
    resolved = spark.createDataFrame([(0, "observer", True, "t", 1, True, "t", 1), (1, "observer", True, "t", 1, False, "t", 1), (2, "observer", False, "t", 1, False, "t", 1)],
                                     "deploy_id long, role string, data_enabled boolean, data_type string, data_size_gb int, log_enabled boolean, log_type string, log_size_gb int")
    listing = spark.createDataFrame([(1, "p0-observer-2"), (2, "p9-observer-1")], "instance_id long, name string")
    disks = spark.createDataFrame([(1, "p0-observer-1-data", "READY"), (2, "p0-observer-3-log", "DELETING"), (3, "p1-observer-2-log", "READY"),
                                   (4, "p1-observer-2-data", "DELETING"), (5, "p1-observer-2-data", "CREATING")], "disk_id long, name string, status string")
    new = I.new_vms(I.vm_queue(dep, prof), listing)
    got = {r.disk_name for r in I.disks_to_create(new, resolved, disks).collect()}
    assert got == {"p0-observer-1-log", "p0-observer-3-data", "p0-observer-3-log", "p1-observer-1-data"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.sampled_from(["RUNNING", "STOPPED", "CREATING"])),
                min_size=1, max_size=30))
def test_pending_instances_match_poller(spark, events):
    rows = [(d, d * 10 + r, i, s) for i, (d, r, s) in enumerate(events)]
    df = spark.createDataFrame(rows, "deploy_id long, resource_id long, seq long, status string")
    got = {r.deploy_id: (r.n_resources, r.pending) for r in I.pending_instances(df).collect()}
    latest = {}
    for d, res, seq, s in rows:  # rows come in seq order: the last one wins
        latest[(d, res)] = s
    want = {}
    for (d, _), s in latest.items():
        n, p = want.get(d, (0, 0))
        want[d] = (n + 1, p + (s not in ("RUNNING", "STOPPED")))
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["observer", "obproxy", "configserver", "monitoring", "ocp"]),
                          st.one_of(st.none(), st.booleans()), st.one_of(st.none(), st.booleans()),
                          st.one_of(st.none(), st.just("/mnt/d"))), min_size=1, max_size=15))
def test_role_disk_needs_match_prepare_step(spark, vms):
    inv = spark.createDataFrame([(i, role, f"vm{i}") for i, (role, *_) in enumerate(vms)],
                                "deploy_id long, role string, name string")
    res = spark.createDataFrame([(i, role, de, dm, le, None) for i, (role, de, le, dm) in enumerate(vms)],
                                "deploy_id long, role string, data_enabled boolean, data_mount string, "
                                "log_enabled boolean, log_mount string")
    got = {r.name: (r.need_data, r.data_mount, r.need_log, r.log_mount) for r in I.role_disk_needs(inv, res).collect()}
    want = {}
    for i, (role, de, le, dm) in enumerate(vms):
        if role in ("obproxy", "configserver"):
            nd, nl = False, False
        elif role == "observer":
            nd, nl = True, bool(le)
        else:
            nd, nl = bool(de), False
        mount = dm or ("/ocp-data" if role == "ocp" else "/data")
        want[f"vm{i}"] = (nd, mount if nd else None, nl, "/data/log1" if nl else None)
    assert got == want


# Hand-worked cases: name, address, zone; region, host, strict address.
ADDRESSES = [
    (("vm-1", "10.0.0.1", "ru-central1-a"), ("ru-central1", "vm-1.ru-central1.internal", "10.0.0.1")),
    (("vm-1", "", "standalone"), ("standalone", "vm-1.standalone.internal", None)),
    (("a.b", None, "a-b-c"), ("a-b", "a.b.a-b.internal", None)),
    (("vm-1", "10.0.0.1", ""), ("", "vm-1", "10.0.0.1")),
    (("vm-1", "10.0.0.1", "-y"), ("", "vm-1", "10.0.0.1")),
    (("vm-1", "10.0.0.1", "x-"), ("x", "vm-1.x.internal", "10.0.0.1")),
    (("", "10.0.0.1", "ru-central1-a"), ("ru-central1", "10.0.0.1", "10.0.0.1")),
    ((None, "", None), ("", None, None)),
]


def test_address_cases(spark):
    df = spark.createDataFrame([r for r, _ in ADDRESSES], "name string, ip string, zone string")
    got = [tuple(r) for r in df.select(S.zone_region("zone"), S.host_address("name", "ip", "zone"),
                                       S.host_address("name", "ip", "zone", strict=True)).collect()]
    assert got == [want for _, want in ADDRESSES]


def test_fleet_totals_are_dealt_before_they_are_grouped(spark):
    """The rows of one file are grouped by many tasks: no group is made before an exchange by deployment."""
    from fleetlens.fixtures import fixture
    from fleetlens.operators import profiles as P

    sf = "/root/testdata/sf0.001"
    resolved = P.resolve_profiles(fixture(spark, sf, "fx_profile"), fixture(spark, sf, "fx_deployment"), fixture(spark, sf, "fx_role_alias"))[0]
    plan = I.fleet_totals(resolved)._jdf.queryExecution().sparkPlan().toString()
    lines = plan.splitlines()
    expand = next(i for i, x in enumerate(lines) if "Expand" in x)
    assert any("hashpartitioning(deploy_id" in x or "RepartitionByExpression" in x or "Exchange hashpartitioning" in x for x in lines[expand:]), plan


def test_placement_is_worked_once_for_hosts_and_rejects(spark):
    """Both outputs read one written table: no join or group is left in their plans."""
    from fleetlens.sinks import documents as D

    inv = spark.createDataFrame([(1, "observer", 1, "10.0.0.1"), (1, "observer", 2, ""), (2, "observer", 1, "10.0.0.2")], "deploy_id long, role string, idx int, ip string")
    flags = spark.createDataFrame([(1, False, True), (2, True, False)], "deploy_id long, prometheus boolean, grafana boolean")
    prof = spark.createDataFrame([(1, "observer", None, None), (2, "observer", None, None)], "deploy_id long, role string, dedicated boolean, enabled boolean")
    hosts, rejects = D.component_placement(inv, flags, prof)
    for df in (hosts, rejects):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan, plan
    assert hosts.where("deploy_id = 1 AND component = 'oceanbase-ce'").count() == 1 and rejects.where("deploy_id = 1 AND component = 'oceanbase-ce'").count() == 1
