"""Stream = batch for the streaming forms."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.fixtures import fixture
from fleetlens.operators import bench as B
from fleetlens.operators import inventory as I
from fleetlens.operators import proxy as X
from fleetlens.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def _split_events(spark, scratch, parts=4):
    """The events table cut into several files by event order, so a stream sees several micro-batches."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    out = f"{scratch}/events_split"
    e.withColumn("_p", F.ntile(parts).over(Window.orderBy("event_id"))).repartition("_p") \
        .write.partitionBy("_p").parquet(out)
    return out, e.schema


def _stream_fx(spark, folder, schema, name, max_files=1):
    from fleetlens.fixtures import FIXTURE_SQL

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option(
        "recursiveFileLookup", "true").parquet(folder)
    return spark.sql(FIXTURE_SQL[name], events=s)


def _run(df, scratch, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", f"{scratch}/ck_{name}").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def _changes(spark, until_ms):
    """The batch form's state changes among the probes up to a time."""
    probes = fixture(spark, SF, "fx_probe").where(F.unix_millis(F.col("ts").cast("timestamp")) <= until_ms)
    w = Window.partitionBy("backend_id").orderBy("probe_no")
    return X.health_state(probes, chunk_size=100).withColumn("_prev", F.coalesce(F.lag("state").over(w), F.lit("up"))).where(
        F.col("state") != F.col("_prev")).select("backend_id", "probe_no", "ok", "state")


def _last_ms(spark):
    return fixture(spark, SF, "fx_probe").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]


def test_health_stream_equals_batch_changes(spark, scratch):
    """Without a closing row the probes of the last hour wait; with one every change is told."""
    folder, schema = _split_events(spark, scratch)
    got = _run(ST.health_stream(_stream_fx(spark, folder, schema, "fx_probe")), scratch, "health")
    changes = _changes(spark, _last_ms(spark) - 3600_000)
    assert got.count() == changes.count() > 0
    assert got.exceptAll(changes).count() == 0
    _end(spark, folder, schema)
    got = _run(ST.health_stream(_stream_fx(spark, folder, schema, "fx_probe")), scratch, "health_all")
    changes = _changes(spark, _last_ms(spark))
    assert got.count() == changes.count() > 0
    assert got.exceptAll(changes).count() == 0


def _end(spark, folder, schema):
    """A closing row as the folder's last file."""
    import time

    time.sleep(1.1)  # the file source takes files by their time
    events = spark.read.parquet(f"{SF}/events.parquet")
    ST.closing_row(events, "ts", "400 days").coalesce(1).write.parquet(f"{folder}/_p=9")


def test_health_stream_takes_files_in_any_order(spark, scratch):
    """Within the watermark the order of the files does not matter."""
    import os
    import time

    folder, schema = _split_events(spark, scratch)
    files = sorted(f"{d}/{x}" for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet"))
    now = time.time()
    assert len(files) == 4
    for f, age in zip(files, (3000, 4000, 1000, 2000)):  # the file source takes files by their time: 2, 1, 4, 3
        os.utime(f, (now - age, now - age))
    _end(spark, folder, schema)
    got = _run(ST.health_stream(_stream_fx(spark, folder, schema, "fx_probe"), watermark="16 days"), scratch, "health_any")
    changes = _changes(spark, _last_ms(spark))
    assert got.count() == changes.count() > 0
    assert got.exceptAll(changes).count() == 0


def test_readiness_stream_matches_batch(spark, scratch):
    folder, schema = _split_events(spark, scratch)
    _end(spark, folder, schema)
    for days in (1, 10, 60):
        got = _run(ST.readiness_stream(_stream_fx(spark, folder, schema, "fx_status"), timeout_s=days * 86400, forget_s=90 * 86400), scratch, f"ready{days}")
        want = I.readiness(fixture(spark, SF, "fx_status"), timeout_s=days * 86400, chunk=F.date_trunc("day", "ts"))
        assert got.count() == want.count() == 10
        assert got.exceptAll(want).count() == 0


def test_readiness_batch_by_hand(spark):
    """A status of an unready resource takes readiness back; only up to the deadline; chunks don't show."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 10, 1, 0, "CREATING"), (1, 11, 2, 5, "RUNNING"), (1, 10, 3, 9, "RUNNING"), (1, 11, 4, 12, "DELETING"),
            (2, 20, 5, 0, "CREATING"), (2, 20, 6, 70, "RUNNING"), (3, 30, 7, 3, "STOPPED"), (3, 30, 8, 4, "CREATING")]
    df = spark.createDataFrame([(d, r, q, t0 + dt.timedelta(seconds=s), x) for d, r, q, s, x in rows], "deploy_id long, resource_id long, seq long, ts timestamp_ntz, status string")
    want = [(1, 2, 0, "ready", 0, 9), (2, 1, 1, "timed_out", 0, 0), (3, 1, 0, "ready", 3, 3)]
    for unit in ("second", "hour"):
        got = I.readiness(df, timeout_s=60, chunk=F.date_trunc(unit, "ts")).orderBy("deploy_id").collect()
        assert [(r.deploy_id, r.n_resources, r.pending, r.state, (r.first_seen - t0).seconds, (r.last_seen - t0).seconds) for r in got] == want


def _statuses(spark, folder, batches):
    import os

    import pandas as pd

    for i, rows in enumerate(batches):
        os.makedirs(f"{folder}/b{i}")
        pd.DataFrame([(d, r, q, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), st) for d, r, q, s, st in rows],
                     columns=["deploy_id", "resource_id", "seq", "ts", "status"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/b{i}/p.parquet")
    return spark.readStream.schema("deploy_id long, resource_id long, seq long, ts timestamp_ntz, status string").option(
        "maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def _batches(df, scratch, name):
    """(batch, row) of everything the stream tells, in order."""
    told = []
    q = df.writeStream.foreachBatch(lambda b, i: told.extend((i, tuple(r)) for r in b.collect())).option(
        "checkpointLocation", f"{scratch}/ck_{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return told


def test_readiness_is_told_when_it_happens_and_once(spark, scratch):
    """A ready deployment comes with the micro-batch that makes it ready, a late one at its deadline, none twice."""
    s = _statuses(spark, f"{scratch}/st", [
        [(1, 10, 1, 0, "CREATING"), (2, 20, 1, 0, "CREATING"), (4, 40, 1, 0, "RUNNING")], [(1, 11, 2, 30, "RUNNING"), (2, 20, 3, 50, "CREATING")],
        [(1, 10, 3, 40, "RUNNING"), (1, 11, 4, 50, "CREATING")], [(2, 20, 5, 4000, "RUNNING"), (1, 10, 6, 4000, "RUNNING")],
        [(3, 30, 6, 9000, "RUNNING")], [(1, 12, 7, 9500, "RUNNING")]])
    told = _batches(ST.readiness_stream(s, timeout_s=60, watermark="10 seconds"), scratch, "once")
    got = sorted((r[0], r[1], r[2], r[3]) for _, r in told)
    assert got == [(1, 2, 0, "ready"), (2, 1, 1, "timed_out"), (3, 1, 0, "ready"), (4, 1, 0, "ready")]
    at = {r[0]: i for i, r in told}
    assert at[4] == 0 and at[1] == 2 and at[3] >= at[2] > at[1]


class _Handle:
    """State of one key in memory; counts the calls on map entries."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = [], None, {}, []

    def getValueState(self, name, schema):
        h = self

        class Value:
            def exists(self):
                return h.value is not None

            def get(self):
                return h.value

            def update(self, v):
                h.value = v

        return Value()

    def getMapState(self, name, key, value):
        h = self

        class Map:
            def containsKey(self, k):
                h.calls.append("containsKey")
                return k in h.map

            def getValue(self, k):
                h.calls.append("getValue")
                return h.map.get(k)

            def updateValue(self, k, v):
                h.map[k] = v

            def clear(self):
                h.map.clear()

        return Map()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_readiness_asks_the_state_for_known_resources_only(spark):
    """A new wait reads no entries; later a resource is read once a micro-batch."""
    import pandas as pd

    h = _Handle()
    p = ST.ReadinessProcessor(60, 1000)
    p.init(h)

    def batch(*rows):
        pdf = pd.DataFrame(rows, columns=["resource_id", "event_us", "seq", "status"])
        return [tuple(r) for out in p.handleInputRows((1,), iter([pdf]), None) for r in out.itertuples(index=False)]

    assert batch((10, 0, 1, "CREATING"), (11, 1, 2, "CREATING"), (10, 2, 3, "CREATING")) == [] and h.calls == []
    assert batch((10, 3, 4, "RUNNING"), (12, 4, 5, "RUNNING"), (10, 5, 6, "RUNNING")) == [] and h.calls == ["containsKey", "getValue", "containsKey"]
    assert batch((11, 6, 7, "STOPPED")) == [(1, 3, 0, "ready", 0, 6)] and h.map == {}


def test_readiness_mark_expires_after_silence(spark, scratch):
    s = _statuses(spark, f"{scratch}/st", [
        [(1, 10, 1, 0, "RUNNING")], [(1, 10, 2, 500, "CREATING")], [(1, 10, 3, 1200, "CREATING")], [(2, 20, 4, 5000, "RUNNING")], [(1, 10, 5, 9000, "STOPPED")]])
    got = _batches(ST.readiness_stream(s, timeout_s=60, watermark="10 seconds", forget_s=1000), scratch, "forget")
    assert [(r[0], r[3]) for _, r in got] == [(1, "ready"), (2, "ready"), (1, "ready")]


def test_readiness_of_wanted_resources_only(spark, scratch):
    s = _statuses(spark, f"{scratch}/st", [[(1, 10, 1, 0, "RUNNING"), (1, 11, 2, 1, "CREATING")], [(1, 11, 3, 20, "RUNNING")], [(9, 9, 9, 9999, "RUNNING")]])
    expect = spark.createDataFrame([(1, 11), (9, 9)], "deploy_id long, resource_id long")
    got = _batches(ST.readiness_stream(s, timeout_s=60, watermark="10 seconds", expect=expect), scratch, "wanted")
    assert [(r[0], r[1], r[3], r[4].second) for _, r in got] == [(1, 1, "ready", 1), (9, 1, "ready", 39)]


def test_ready_after_stream_equals_batch(spark):
    status = fixture(spark, SF, "fx_status")
    wanted = status.groupBy("deploy_id", "resource_id").agg(F.min("ts").alias("first_seen"))
    for hours in (6, 48):
        streams = ST.stream_of(wanted, "wanted", "first_seen", ts="first_seen", end_after="400 days"), ST.stream_fixture(spark, SF, "fx_status", end_after="400 days")
        got = ST.run_to_table(ST.ready_after_stream(*streams, timeout_s=hours * 3600), "ready_after")
        want = I.ready_after(status, timeout_s=hours * 3600)
        late = F.col("timed_out")
        want = want.withColumn("first_ready", F.when(~late, F.col("first_ready"))).withColumn("wait_s", F.when(~late, F.col("wait_s")))
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
        if hours == 6:
            assert 0 < got.where("timed_out").count() < got.count()


def test_scrape_windows_stream_equals_batch(spark, scratch):
    folder, schema = _split_events(spark, scratch)
    s = ST.scrape_windows(_stream_fx(spark, folder, schema, "fx_metric"), every="6 hours", watermark="1 hour")
    got = _run(s, scratch, "scrape", mode="complete")
    batch = ST.scrape_windows(fixture(spark, SF, "fx_metric"), every="6 hours")
    a = got.select("target_id", "job_name", F.col("window_start").cast("timestamp_ntz").alias("ws"), "n_samples",
                   "last_value", "avg_value")
    b = batch.select("target_id", "job_name", F.col("window_start").alias("ws"), "n_samples", "last_value",
                     "avg_value")
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_scrape_windows_of_equal_times(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", t, 3.0, 1), (1, "a", t, 1.0, 2), (1, "a", t, 2.0, 0)], "target_id long, job_name string, ts timestamp_ntz, value double, no int")
    assert ST.scrape_windows(df).first().last_value == 3.0
    assert ST.scrape_windows(df, tie=["no"]).first().last_value == 1.0


def test_idle_sessions_stream_settles_to_batch(spark, scratch):
    folder, schema = _split_events(spark, scratch)
    batch = X.idle_sessions(fixture(spark, SF, "fx_conn"))
    open_log = _run(ST.idle_sessions_stream(_stream_fx(spark, folder, schema, "fx_conn")), scratch, "sessions_open")
    now = ST.settled_sessions(open_log)
    assert now.drop("state").exceptAll(batch).count() == 0 and now.count() == batch.count()
    assert now.where("state = 'open'").count() > 0  # told before they are closed
    _end(spark, folder, schema)
    log = _run(ST.idle_sessions_stream(_stream_fx(spark, folder, schema, "fx_conn")), scratch, "sessions")
    done = ST.settled_sessions(log)
    assert done.where("state <> 'closed'").count() == 0
    assert done.drop("state").exceptAll(batch).count() == 0 and done.count() == batch.count()


def test_sessions_merge_and_are_withdrawn(spark, scratch):
    """Two open sessions and a connection between them become one; the revisions tell it."""
    import os

    import pandas as pd

    t0 = dt.datetime(2024, 1, 1)
    for i, secs in enumerate(([0, 30], [12], [100], [21], [10000])):
        os.makedirs(f"{scratch}/c/b{i}")
        pd.DataFrame([("a", t0 + dt.timedelta(seconds=s)) for s in secs], columns=["client_ip", "ts"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{scratch}/c/b{i}/p.parquet")
    s = spark.readStream.schema("client_ip string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{scratch}/c")
    told = [(i, (r[1] - t0).seconds, (r[2] - t0).seconds, *r[3:]) for i, r in _batches(ST.idle_sessions_stream(s, gap="15 seconds", watermark="200 seconds"), scratch, "merge")]
    assert [x[1:5] for x in told if x[4] != "closed"] == [
        (0, 15, 1, "open"), (30, 45, 1, "open"), (0, 27, 2, "open"), (100, 115, 1, "open"), (30, 45, 1, "withdrawn"), (0, 45, 4, "open"), (10000, 10015, 1, "open")]
    assert sorted(x[1:5] for x in told if x[4] == "closed") == [(0, 45, 4, "closed"), (100, 115, 1, "closed")]
    assert [x[5] for x in told][:6] == [1, 2, 3, 4, 5, 6]


def test_measured_runs_on_a_stream(spark, scratch):
    folder, schema = _split_events(spark, scratch)
    runs = fixture(spark, SF, "fx_tx").groupBy("run_id").agg((F.min("ts") + F.expr("INTERVAL 1 DAY") * F.col("run_id")).alias("start_ts"))
    got = _run(B.measured_runs(_stream_fx(spark, folder, schema, "fx_tx"), runs, 86400, 5 * 86400), scratch, "runs")
    want = B.measured_runs(fixture(spark, SF, "fx_tx"), runs, 86400, 5 * 86400)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    per_run = [B.measured_window(fixture(spark, SF, "fx_tx").where(F.col("run_id") == r.run_id), r.start_ts, 86400, 5 * 86400).count() for r in runs.collect()]
    assert sum(per_run) == want.count()


def test_stream_files_come_in_order(spark):
    table = spark.read.parquet(f"{SF}/events.parquet")
    seen = []
    s = ST.stream_of(table, "events", "event_id", files=5, end_after="1 day")
    q = s.writeStream.foreachBatch(lambda b, i: seen.append(b.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 6 and sum(r[2] for r in seen) == table.count() + 1 and seen[-1][0] is None
    assert all(a[1] < b[0] for a, b in zip(seen[:-2], seen[1:-1]))


def test_stateless_rules_on_streams(spark, scratch):
    folder, schema = _split_events(spark, scratch)
    sticky = _run(X.sticky_backend(_stream_fx(spark, folder, schema, "fx_conn")), scratch, "sticky")
    b = X.sticky_backend(fixture(spark, SF, "fx_conn"))
    assert sticky.select("conn_id", "backend").exceptAll(b.select("conn_id", "backend")).count() == 0
    win = _run(B.measured_window(_stream_fx(spark, folder, schema, "fx_tx"), dt.datetime(2024, 1, 1), 5 * 86400,
                                 10 * 86400), scratch, "window")
    assert win.count() == B.measured_window(fixture(spark, SF, "fx_tx"), dt.datetime(2024, 1, 1), 5 * 86400,
                                            10 * 86400).count()


def test_stateful_streams_name_the_state_store_they_need(spark):
    import pytest

    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        for stream in (ST.readiness_stream, ST.health_stream, ST.idle_sessions_stream):
            with pytest.raises(ValueError, match="RocksDB"):
                stream(fixture(spark, SF, {ST.readiness_stream: "fx_status", ST.health_stream: "fx_probe"}.get(stream, "fx_conn")))
        from fleetlens.catalog import load_all

        assert load_all()["health_stream"].build(spark, SF).count() > 0  # the query sets it for itself
        assert spark.conf.get(key).endswith("HDFSBackedStateStoreProvider")
    finally:
        spark.conf.set(key, old)


def test_workers_get_the_package(tmp_path):
    """A query with Python on the workers runs from a folder that does not hold the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from fleetlens.session import local_session; "
            f"s = local_session(2, 2); print('ROWS', e.queries()['config_docs'](s, {SF!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 150" in out.stdout, out.stderr[-2000:]


def test_micro_batches_do_not_grow_with_the_table(spark, monkeypatch):
    """A table of many files is taken in as many micro-batches as one of four, in order and whole."""
    monkeypatch.setattr(ST, "FILE_ROWS", 40)
    table = spark.range(1000).select("id", F.timestamp_seconds("id").alias("ts"))
    for one_by_one, batches in ((False, 5), (True, 26)):
        seen = []
        s = ST.stream_of(table, "numbers", "ts", end_after="1 day", one_by_one=one_by_one)
        q = s.writeStream.foreachBatch(lambda b, i: seen.append(b.agg(F.min("id"), F.max("id"), F.count("id")).first())).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = [r for r in seen if r[2]]
        assert len(seen) <= batches and len(rows) >= batches - 2 and sum(r[2] for r in rows) == 1000
        assert all(a[1] < b[0] for a, b in zip(rows, rows[1:]))


def test_a_micro_batch_holds_a_bounded_number_of_files(spark, monkeypatch):
    """A table of more than four of the largest micro-batches takes more of them, none larger."""
    monkeypatch.setattr(ST, "FILE_ROWS", 40)
    monkeypatch.setattr(ST, "MOST_FILES", 4)
    seen = []
    s = ST.stream_of(spark.range(1000).select("id", F.timestamp_seconds("id").alias("ts")), "bounded", "ts", end_after="1 day")
    q = s.writeStream.foreachBatch(lambda b, i: seen.append(b.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 7 <= len(seen) <= 8 and max(seen) <= 200 and sum(seen) == 1001


def test_state_partitions_are_bounded(spark, monkeypatch):
    """A stream run to a table has no more state partitions than the bound or the cores, and every row; the session keeps its own number."""
    import os

    key = "spark.sql.shuffle.partitions"
    monkeypatch.setattr(ST, "STATE_PARTITIONS", 3, raising=False)
    before = spark.conf.get(key)
    assert int(before) > spark.sparkContext.defaultParallelism > 3
    table = spark.range(1000).select((F.col("id") % 50).alias("target_id"), F.lit("a").alias("job_name"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("value"))
    out = ST.run_to_table(ST.scrape_windows(ST.stream_of(table, "few", "ts", end_after="1 day")), "few")
    assert out.agg(F.sum("n_samples")).first()[0] == 1000
    state = out.inputFiles()[0].removeprefix("file://").rpartition("/out/")[0] + "/checkpoint/state/0"
    assert len([x for x in os.listdir(state) if x.isdigit()]) == spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before


def test_registered_streams_do_not_depend_on_the_order_of_keys(spark, scratch):
    """Events whose numbers run against time: nothing falls behind the watermark."""
    import os

    from fleetlens.catalog import load_all

    e = spark.read.parquet(f"{SF}/events.parquet")
    e.withColumn("event_id", -F.col("event_id")).coalesce(1).write.parquet(f"{scratch}/events.parquet")
    assert os.path.isdir(f"{scratch}/events.parquet")
    q = load_all()
    for stream, batch in (("idle_sessions_stream", "idle_sessions"), ("scrape_windows_stream", "scrape_windows")):
        got, want = q[stream].build(spark, scratch), q[batch].build(spark, scratch)
        got = got.select(*want.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_clients_of_one_bucket_are_told_apart(spark, scratch):
    """Three clients in one list state: sessions, merges and revisions are each client's own."""
    import os

    import pandas as pd

    t0 = dt.datetime(2024, 1, 1)
    batches = ([("a", 0), ("b", 0), ("a", 30)], [("a", 12), ("c", 50)], [("b", 5), ("a", 21)], [("c", 100), (None, 60)], [(None, 10000)])
    for i, rows in enumerate(batches):
        os.makedirs(f"{scratch}/c/b{i}")
        pd.DataFrame([(c, t0 + dt.timedelta(seconds=s)) for c, s in rows], columns=["client_ip", "ts"]).astype({"client_ip": "string", "ts": "datetime64[us]"}).to_parquet(f"{scratch}/c/b{i}/p.parquet")
    s = spark.readStream.schema("client_ip string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{scratch}/c")
    told = [(r[0], (r[1] - t0).seconds, (r[2] - t0).seconds, *r[3:]) for _, r in _batches(ST.idle_sessions_stream(s, gap="15 seconds", watermark="200 seconds", buckets=1), scratch, "bucket")]
    of = lambda c: [x[1:] for x in told if x[0] == c]
    assert of("a") == [(0, 15, 1, "open", 1), (30, 45, 1, "open", 2), (0, 27, 2, "open", 3), (30, 45, 1, "withdrawn", 4), (0, 45, 4, "open", 5), (0, 45, 4, "closed", 6)]
    assert of("b") == [(0, 15, 1, "open", 1), (0, 20, 2, "open", 2), (0, 20, 2, "closed", 3)]
    assert of("c") == [(50, 65, 1, "open", 1), (100, 115, 1, "open", 2), (50, 65, 1, "closed", 3), (100, 115, 1, "closed", 4)]
    assert len(told) == len(of("a")) + len(of("b")) + len(of("c"))
