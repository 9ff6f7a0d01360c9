"""Structured Streaming forms.

The poll loops of the original become streams of status, probe,
connection and metric rows. Stateless rules (#85 sticky backend, #88
measured window) are the batch functions applied to a streaming frame.
Stateful rules keep per-key state between micro-batches:

* #87 scrape windows use Spark's own windowed aggregation with a watermark
  that bounds the state;
* #73 on two streams is a left outer join of the wish list with the listings
  inside the timeout: what the join gives up on has timed out;
* #83 readiness counts what is pending in map state and tells a deployment in
  the micro-batch in which nothing is pending any more;
* #84 health checks keep their rows in a list state until the watermark passes
  them and then work them in event order, so the rows that come out do not
  depend on how the input is cut into micro-batches;
* #86 sessions are intervals that grow and merge, one list state per bucket of clients: open ones
  are told and revised, closed ones leave the state.

#83, #84 and #86 are ``transformWithStateInPandas`` with event-time timers on the
RocksDB state store.

**End of input.** A watermark stands behind the latest row, so what came last
would wait for rows that never come. A source that ends sends a closing row: no
key (null) and a time beyond every deadline. It moves the watermark past all rows
that are held, and no operator gives it out (``closing_row``).

Event times of the fixtures are TIMESTAMP_NTZ; watermarks need TIMESTAMP,
so streams cast with the session time zone (UTC in our sessions).
"""

from __future__ import annotations

import contextlib
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.inventory import READY_INSTANCE
from ..operators.proxy import gap_us
from ..session import ensure_checkpoint_dir, read_table

WATERMARK = "1 hour"
NO_KEY = -(1 << 63)


def event_time(df: DataFrame, col: str = "ts", out: str = "event_ts") -> DataFrame:
    return df.withColumn(out, F.col(col).cast("timestamp"))


# ---------------------------------------------------------------- windowed aggregations


def scrape_windows(metrics: DataFrame, every: str = "15 seconds", watermark: str | None = WATERMARK, tie: list[str] | None = None) -> DataFrame:
    """#87 samples per target and job in fixed periods: count, last value, average.

    Of samples of one time the last is the one with the greatest ``tie`` columns (a
    number of the sample, say; the value itself where there is none). Batch or stream;
    on a stream give ``watermark`` so finished periods are emitted (append mode) and
    their state dropped. Rows without a target (the closing row) give no period.
    """
    m = metrics
    ts = "ts"
    if metrics.isStreaming:
        m = event_time(metrics).withWatermark("event_ts", watermark)
        ts = "event_ts"
    agg = m.groupBy("target_id", "job_name", F.window(ts, every).alias("w")).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max_by("value", F.struct(ts, *(tie or ["value"]))).alias("last_value"),
        F.round(F.avg("value"), 6).alias("avg_value"),
        F.count("target_id").alias("_known"),  # a filter on the key itself would be pushed below the watermark
    )
    ts_type = metrics.schema["ts"].dataType.simpleString()
    return agg.where("_known > 0").select(
        "target_id", "job_name", F.col("w.start").cast(ts_type).alias("window_start"),
        F.col("w.end").cast(ts_type).alias("window_end"), "n_samples", "last_value", "avg_value")


# ---------------------------------------------------------------- wish list against listings (#73)


def ready_after_stream(wanted: DataFrame, listing: DataFrame, timeout_s: int = 3600, poll_s: int = 5, watermark: str = WATERMARK,
                       ready=("READY", "RUNNING", "STOPPED")) -> DataFrame:
    """#51 / #73 on two streams: ``wanted`` (deploy_id, resource_id, first_seen) against the
    status rows of ``listing`` (deploy_id, resource_id, ts, status).

    A left outer join: a resource meets its ready statuses from first sight to
    ``timeout_s`` later; one that met none when the watermark has passed that time has timed out.
    The bound on both sides lets Spark drop the state of either stream. The first
    ready status is the least of those met. Rows: those of ``ready_after``, but
    that a status after the timeout is not seen (``first_ready`` stays null).
    """
    ts_type = wanted.schema["first_seen"].dataType.simpleString()
    w = wanted.select("deploy_id", "resource_id", F.col("first_seen").cast("timestamp").alias("seen_ts")).withWatermark("seen_ts", watermark)
    l = listing.where(F.col("status").isin(*ready) | F.col("deploy_id").isNull()).select(
        F.col("deploy_id").alias("l_deploy"), F.col("resource_id").alias("l_resource"), F.col("ts").cast("timestamp").alias("ready_ts"))
    l = l.withWatermark("ready_ts", watermark)
    within = (F.col("ready_ts") >= F.col("seen_ts")) & (F.col("ready_ts") <= F.col("seen_ts") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS"))
    # null keys are compared as a number, else Spark would drop the closing rows before the watermark sees them
    same = lambda a, b: F.coalesce(F.col(a), F.lit(NO_KEY)) == F.coalesce(F.col(b), F.lit(NO_KEY))
    met = w.join(l, same("deploy_id", "l_deploy") & same("resource_id", "l_resource") & within, "left_outer")
    first = met.groupBy("deploy_id", "resource_id", "seen_ts").agg(F.min("ready_ts").alias("first_ready"), F.count("deploy_id").alias("_known")).where("_known > 0")
    secs = F.timestamp_diff("MICROSECOND", F.col("seen_ts"), F.col("first_ready")) / F.lit(1e6)
    wait = (F.ceil(secs / F.lit(poll_s)) * poll_s).cast("bigint")
    return first.select("deploy_id", "resource_id", F.col("seen_ts").cast(ts_type).alias("first_seen"), F.col("first_ready").cast(ts_type).alias("first_ready"),
                        wait.alias("wait_s"), (F.col("first_ready").isNull() | (wait > timeout_s)).alias("timed_out"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _needs_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"list state and timers need {PROVIDER}={ROCKSDB}")


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """The session with the RocksDB state store, for streams defined and run inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield spark
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _retime(handle: StatefulProcessorHandle, when: int) -> None:
    """One timer of the key, at ``when``."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(when)


# ---------------------------------------------------------------- readiness (#83)

READINESS_OUT = "deploy_id long, n_resources long, pending long, state string, first_us long, last_us long"
READINESS_COLS = [c.split()[0] for c in READINESS_OUT.split(", ")]


def _keyless(key) -> bool:
    """The closing row's group."""
    return key[0] is None


class ReadinessProcessor(StatefulProcessor):
    """#83: which resources of a deployment are pending, and a mark once its row is out.

    The state is one entry a resource while a deployment is waited for, one value after
    that, and nothing ``forget_s`` after the deployment's last row."""

    def __init__(self, timeout_s: float, forget_s: float):
        self.timeout_us, self.forget_us = int(timeout_s * 1e6), int(forget_s * 1e6)
        self.ready = set(READY_INSTANCE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", "first_us long, last_us long, n long, pending long, latest_us long")
        self.resources = handle.getMapState("resources", "resource_id long", "us long, seq long, pending boolean")

    def _row(self, key, state, first, last, n, pending):
        return pd.DataFrame([(key[0], n, pending, state, first, last)], columns=READINESS_COLS)

    def _over(self, first, last, n, pending, latest):
        """The row is out: only the mark stays, until the deployment has been silent for ``forget_s``."""
        self.resources.clear()
        self.wait.update((first, last, n, pending, latest))
        _retime(self.handle, -(-(latest + self.forget_us) // 1000))

    def _after_silence(self, us, latest) -> int:
        """The first row that begins a new wait: ``forget_s`` after the row before it."""
        gaps = np.flatnonzero(np.diff(us, prepend=latest) >= self.forget_us)
        return int(gaps[0]) if len(gaps) else len(us)

    def handleInputRows(self, key, rows, timerValues):
        if _keyless(key):
            return
        first, last, n, pending, latest = self.wait.get() if self.wait.exists() else (None, None, 0, 0, None)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["event_us", "seq"])
        while len(pdf):
            us = pdf["event_us"].to_numpy()
            if latest is not None:  # told already
                begins = self._after_silence(us, latest)
                self._over(first, last, n, pending, max(latest, int(us[begins - 1]) if begins else latest))
                pdf = pdf[begins:]
                if not len(pdf):
                    return
                first, last, n, pending, latest = None, None, 0, 0, None
                us = pdf["event_us"].to_numpy()
            fresh = first is None  # a new wait has no entries: asking for each resource is a call to the JVM
            first = int(us[0]) if fresh else min(first, int(us[0]))
            known: dict[int, tuple] = {}
            ready = None
            here = pdf[us <= first + self.timeout_us]
            for at, (resource, when, seq, status) in enumerate(here[["resource_id", "event_us", "seq", "status"]].itertuples(index=False, name=None)):
                if resource not in known:
                    known[resource] = self.resources.getValue((resource,)) if not fresh and self.resources.containsKey((resource,)) else None
                old, new = known[resource], status not in self.ready
                if old is not None and (old[0], old[1]) > (when, seq):  # came late: a newer status is known
                    continue
                n, pending = n + (old is None), pending + int(new) - int(old is not None and old[2])
                known[resource], last = (when, seq, new), when
                if pending == 0:
                    ready = at
                    break
            if ready is None:
                for resource, value in known.items():
                    if value is not None:
                        self.resources.updateValue((resource,), value)
                self.wait.update((first, last, n, pending, None))
                _retime(self.handle, -(-(first + self.timeout_us) // 1000))
                return
            latest = last
            self._over(first, last, n, pending, latest)
            yield self._row(key, "ready", first, last, n, pending)
            pdf = pdf[ready + 1:]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        first, last, n, pending, latest = self.wait.get()
        if latest is not None:  # long silent: a later row of the deployment is a new wait
            self.wait.clear()
            return
        self._over(first, last, n, pending, first + self.timeout_us)
        yield self._row(key, "timed_out", first, last, n, pending)

    def close(self) -> None:
        pass


def readiness_stream(status: DataFrame, timeout_s: float = 3600, watermark: str = WATERMARK, forget_s: float = 86400,
                     expect: DataFrame | None = None) -> DataFrame:
    """#83 one row per deployment, as soon as it is known: ``ready`` in the micro-batch that
    holds the first status after which none of its resources is pending, else ``timed_out`` once the
    watermark passes its deadline (first sight + ``timeout_s``).

    A resource that has not been seen is not pending (as in the poll loop). ``expect``
    (deploy_id, resource_id; a static table) restricts the wait to wanted resources. Rows are those of the
    batch form ``operators.inventory.readiness``. The statuses of a micro-batch are worked in event order;
    a status older than the one known of its resource changes nothing. The state holds one entry a
    resource of a deployment that is waited for; of one that is over a mark, so that it is
    told once, until the deployment has been silent for ``forget_s`` of event time: the next
    row then begins a new wait. Event times travel as epoch
    microseconds, so the Python side never depends on the session time zone;
    ``first_seen`` / ``last_seen`` come back in the input column's type.
    """
    _needs_rocksdb(status.sparkSession)
    ts_type = status.schema["ts"].dataType.simpleString()
    s = event_time(status).withWatermark("event_ts", watermark).select(
        "deploy_id", "resource_id", "seq", "status", "event_ts", F.unix_micros("event_ts").alias("event_us"))
    if expect is not None:
        # the closing row has no deployment and must stay
        wanted = expect.select("deploy_id", "resource_id").distinct().withColumn("_wanted", F.lit(True))
        s = s.join(wanted, ["deploy_id", "resource_id"], "left").where(F.col("_wanted") | F.col("deploy_id").isNull()).drop("_wanted")
    out = s.groupBy("deploy_id").transformWithStateInPandas(ReadinessProcessor(timeout_s, forget_s), READINESS_OUT, "Append", "EventTime")
    return out.select(
        "deploy_id", "n_resources", "pending", "state",
        F.timestamp_micros("first_us").cast(ts_type).alias("first_seen"),
        F.timestamp_micros("last_us").cast(ts_type).alias("last_seen"),
    )


# ---------------------------------------------------------------- health (#84)

HEALTH_OUT = "backend_id long, probe_no long, ok boolean, state string"


def health_steps(ok: np.ndarray, down0: bool, run_ok0, run_len0: int, fall: int, rise: int):
    """Vectorised health state machine over one ordered block of probes.

    Returns (state_down per probe, final run value, final run length).
    """
    n = len(ok)
    change = np.ones(n, dtype=bool)
    change[1:] = ok[1:] != ok[:-1]
    if run_ok0 is not None and n and ok[0] == run_ok0:
        change[0] = False
    idx = np.arange(n)
    start = np.maximum.accumulate(np.where(change, idx, -1))
    # a probe with no change before it in the block continues the carried run
    pos = np.where(start < 0, idx + 1 + run_len0, idx - start + 1)
    ev = np.full(n, -1, dtype=np.int8)  # -1 none, 1 down, 0 up
    ev[(~ok) & (pos == fall)] = 1
    ev[ok & (pos == rise)] = 0
    last_ev_idx = np.maximum.accumulate(np.where(ev >= 0, idx, -1))
    down = np.where(last_ev_idx >= 0, ev[np.maximum(last_ev_idx, 0)] == 1, down0)
    return down, bool(ok[-1]), int(pos[-1])


class HealthProcessor(StatefulProcessor):
    """#84: probes wait in a list until the watermark has passed them, then enter the state
    machine in order of time and number."""

    def __init__(self, fall: int, rise: int):
        self.fall, self.rise = fall, rise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "down boolean, run_ok boolean, run_len long, last_ms long, last_probe long")
        self.probes = handle.getListState("probes", "probe_no long, event_ms long, ok boolean")

    def handleInputRows(self, key, rows, timerValues):
        (backend,) = key
        if _keyless(key):
            return
        _, _, _, last_ms, last_probe = self.machine.get() if self.machine.exists() else (False, True, 0, None, None)
        due = min(self.handle.listTimers(), default=None)
        for pdf in rows:
            if last_ms is not None:  # the state machine is past these: told, not dropped
                late = (pdf["event_ms"] < last_ms) | ((pdf["event_ms"] == last_ms) & (pdf["probe_no"] <= last_probe))
                if late.any():
                    yield pd.DataFrame({"backend_id": backend, "probe_no": pdf["probe_no"][late], "ok": pdf["ok"][late], "state": "late"})
                    pdf = pdf[~late]
            if len(pdf):
                self.probes.appendList(list(pdf[["probe_no", "event_ms", "ok"]].itertuples(index=False, name=None)))
                low = int(pdf["event_ms"].min())
                due = low if due is None else min(due, low)
        if due is not None:
            _retime(self.handle, due)
        yield pd.DataFrame(columns=["backend_id", "probe_no", "ok", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (backend,) = key
        down0, run_ok, run_len, _, _ = self.machine.get() if self.machine.exists() else (False, None, 0, None, None)
        passed = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for probe in self.probes.get():
            (due if probe[1] <= passed else rest).append(probe)
        if rest:
            self.probes.put(rest)
            self.handle.registerTimer(min(p[1] for p in rest))
        else:
            self.probes.clear()
        if not due:
            return
        number, ms, ok = (np.array(x) for x in zip(*sorted(due, key=lambda p: (p[1], p[0]))))
        ok = ok.astype(bool)
        down, run_ok, run_len = health_steps(ok, bool(down0), run_ok, int(run_len), self.fall, self.rise)
        changed = down != np.concatenate([[bool(down0)], down[:-1]])
        self.machine.update((bool(down[-1]), run_ok, run_len, int(ms[-1]), int(number[-1])))
        yield pd.DataFrame({"backend_id": np.full(int(changed.sum()), backend), "probe_no": number[changed], "ok": ok[changed],
                            "state": np.where(down[changed], "down", "up")})

    def close(self) -> None:
        pass


def health_stream(probes: DataFrame, fall: int = 3, rise: int = 2, watermark: str = WATERMARK) -> DataFrame:
    """#84 the health state machine with per-backend state kept between micro-batches;
    emits only the probes where the state changes.

    Probes are held until the watermark has passed them, and worked in order of
    time and number: files that come in any order within the watermark give
    the changes of the batch form, all of them once a closing row has come. A probe that
    arrives after a later one was worked is emitted with state ``late``. The
    state holds one backend's probes of a watermark's length and a trigger.
    """
    _needs_rocksdb(probes.sparkSession)
    p = event_time(probes).withWatermark("event_ts", watermark).select(
        "backend_id", "probe_no", "ok", "event_ts", F.unix_millis("event_ts").alias("event_ms"))
    return p.groupBy("backend_id").transformWithStateInPandas(HealthProcessor(fall, rise), HEALTH_OUT, "Append", "EventTime")


# ---------------------------------------------------------------- sessions (#86)

SESSION_OUT = "client_ip string, start_us long, end_us long, n_conns long, state string, revision long"


OPEN_STATE = "client_ip string, start_us long, end_us long, n_conns long, revision long"


class SessionProcessor(StatefulProcessor):
    """#86: the open sessions of a bucket of clients, as intervals that grow and merge.

    One list per bucket, read and written once a micro-batch: a call of the state store costs
    more than the work on a client's few sessions. Each open session carries the client's last revision."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN_STATE)

    def _have(self):
        """The open sessions as arrays: client, start, end, connections, last revision of the client."""
        client, *numbers = zip(*self.open.get()) if self.open.exists() else ((),) * 5
        return np.array(client, dtype=object), *(np.array(x, dtype="int64") for x in numbers)

    def _keep(self, client, start, end, n, revision) -> None:
        """These are open from now on; the timer is at the end of the first one."""
        if not len(client):
            self.open.clear()
            return
        self.open.put(list(zip(client.tolist(), start.tolist(), end.tolist(), n.tolist(), revision.tolist())))
        _retime(self.handle, -(-int(end.min()) // 1000))

    def _log(self, names, told, code, start, end, n, state):
        """The rows, numbered on from each client's last one; ``told`` is moved on to the new last ones."""
        order = np.lexsort((start, state != "withdrawn", code))
        code, start, end, n, state = (x[order] for x in (code, start, end, n, state))
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        revision = told[code] + 1 + np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        np.maximum.at(told, code, revision)
        return pd.DataFrame({"client_ip": names[code], "start_us": start, "end_us": end, "n_conns": n, "state": state, "revision": revision})

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([pdf[["client_ip", "event_us"]] for pdf in rows], ignore_index=True)
        new = new[new["client_ip"].notna()]  # the closing row has no client
        if not len(new):
            return
        t = new["event_us"].astype("int64").to_numpy()
        client, start, end, n, revision = self._have()
        open_before = len(client)
        code, names = pd.factorize(np.concatenate([client, new["client_ip"].to_numpy(dtype=object)]))
        told = np.zeros(len(names), dtype="int64")
        np.maximum.at(told, code[:open_before], revision)
        start, end, n = np.concatenate([start, t]), np.concatenate([end, t + self.gap]), np.concatenate([n, np.ones_like(t)])
        order = np.lexsort((start, code))  # stable: of one start the open session is first
        known = (np.arange(len(code)) < open_before)[order]
        code, start, end, n = (x[order] for x in (code, start, end, n))
        reach = pd.Series(end).groupby(code, sort=False).cummax().to_numpy()
        begins = np.append(True, (code[1:] != code[:-1]) | (start[1:] >= reach[:-1]))  # sessions less than the gap apart are one
        first = np.flatnonzero(begins)
        grown = np.add.reduceat((~known).astype("int64"), first) > 0
        gone = known & ~begins
        now = code[first], start[first], np.maximum.reduceat(end, first), np.add.reduceat(n, first)
        out = [np.concatenate([x[gone], y[grown]]) for x, y in zip((code, start, end, n), now)]
        log = self._log(names, told, *out, np.repeat(np.array(["withdrawn", "open"], dtype=object), [gone.sum(), grown.sum()]))
        self._keep(names[now[0]], *now[1:], told[now[0]])
        yield log

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        client, start, end, n, revision = self._have()
        over = end <= timerValues.getCurrentWatermarkInMs() * 1000
        if not over.any():
            return self._keep(client, start, end, n, revision)
        code, names = pd.factorize(client)
        told = np.zeros(len(names), dtype="int64")
        np.maximum.at(told, code, revision)
        log = self._log(names, told, code[over], start[over], end[over], n[over], np.full(over.sum(), "closed", dtype=object))
        # nothing of a client without open sessions is left in the state
        self._keep(client[~over], start[~over], end[~over], n[~over], told[code][~over])
        yield log

    def close(self) -> None:
        pass


def idle_sessions_stream(conns: DataFrame, gap: str = "24 hours", watermark: str = "24 hours", buckets: int = 256) -> DataFrame:
    """#86 on a stream, told as it goes: a log of (client_ip, session_start, session_end, n_conns, state, revision).

    Each micro-batch tells the sessions that began or grew in it (``open``, with the end
    they have so far); connections that fill a gap merge sessions, and the later one is
    ``withdrawn``; a session is ``closed`` when the watermark passes its end and leaves the state then.
    ``settled_sessions`` gives what holds at the end of a log. Connections may come in any order
    within the watermark. (Spark's own ``session_window`` tells closed sessions only: it refuses update mode.)
    Clients are dealt to ``buckets`` groups by hash: the Python side is called once a bucket and
    micro-batch, not once a client. The number is part of a checkpoint.
    """
    _needs_rocksdb(conns.sparkSession)
    ts_type = conns.schema["ts"].dataType.simpleString()
    c = event_time(conns).withWatermark("event_ts", watermark).select(
        F.pmod(F.xxhash64("client_ip"), F.lit(buckets)).alias("bucket"), "client_ip", "event_ts", F.unix_micros("event_ts").alias("event_us"))
    out = c.groupBy("bucket").transformWithStateInPandas(SessionProcessor(gap_us(gap)), SESSION_OUT, "Append", "EventTime")
    return out.select("client_ip", F.timestamp_micros("start_us").cast(ts_type).alias("session_start"),
                      F.timestamp_micros("end_us").cast(ts_type).alias("session_end"), "n_conns", "state", "revision")


def settled_sessions(log: DataFrame) -> DataFrame:
    """The sessions that a log of ``idle_sessions_stream`` leaves: the last word on each that was not withdrawn.

    A client whose state is empty counts its revisions anew, so a session's words are
    ordered by its size first: it only grows, and it is closed last."""
    rank = F.when(F.col("state") == "open", 0).otherwise(1)
    last = F.struct("n_conns", rank.alias("rank"), "revision", "state", "session_end")
    s = log.groupBy("client_ip", "session_start").agg(F.max(last).alias("last"))
    return s.where("last.state <> 'withdrawn'").select("client_ip", "session_start", F.col("last.session_end").alias("session_end"),
                                                       F.col("last.n_conns").alias("n_conns"), F.col("last.state").alias("state"))


# ---------------------------------------------------------------- running a stream to a table


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A parquet table of ``sf_dir`` as a file stream (schema taken from the table)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


#: Rows of a file of a stream over a table, and the files of a micro-batch at most.
FILE_ROWS = 500_000
MOST_FILES = 20
#: Partitions of a stream's state at most; one for each core where there are more cores.
STATE_PARTITIONS = 48


def closing_row(table: DataFrame, ts: str, after: str) -> DataFrame:
    """The row that ends a stream of ``table``: all null, but its time is ``after`` the latest one."""
    last = table.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias(ts))
    return last.select(*((F.col(ts) if c == ts else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns))


def stream_of(table: DataFrame, name: str, order: str, ts: str = "ts", files: int = 4, end_after: str | None = None, one_by_one: bool = False) -> DataFrame:
    """A table as a stream of files of at most some ``FILE_ROWS`` rows, in ranges of ``order``.

    The table is taken in ``files`` micro-batches, of more files each the larger it is: a micro-batch costs
    the same (tasks, commits of the state, what tasks tell the driver) however little it holds. No
    micro-batch takes more than ``MOST_FILES`` files, since its groups are in the state until the watermark passes
    them; a table beyond ``files`` such micro-batches takes more of them. With
    ``one_by_one`` each file is a micro-batch, for streams that hold a micro-batch's rows of a key.
    The table is written once, range-partitioned, under the shared checkpoint folder; the files get
    ascending times, since the file source takes them by time. With ``end_after`` a closing
    row so much later than the last one follows as a file of its own."""
    spark = table.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fleetlens-streams/{name}-{uuid.uuid4().hex[:12]}"
    n = max(files, -(-table.count() // FILE_ROWS))
    at_once = 1 if one_by_one else min(-(-n // files), MOST_FILES)
    # equal values of order stay in one file, so that rows of one time are not told apart
    table.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    now = int(time.time() * 1000)
    for i, part in enumerate(parts):
        fs.setTimes(part, now - 2000 * (len(parts) - i), -1)
    if end_after is not None:
        closing_row(table, ts, end_after).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", at_once).parquet(path)


def stream_fixture(spark: SparkSession, sf_dir: str, name: str, files: int = 4, order: str = "ts", end_after: str | None = None,
                   one_by_one: bool = False) -> DataFrame:
    """A fixture view over its base table as a stream of files (same SQL text as the batch view; see ``stream_of``).

    Rows come in order of time, so that none is behind the watermark whatever order the keys have."""
    from ..fixtures import FIXTURE_SQL, base_tables_of

    frames = {t: stream_of(read_table(spark, sf_dir, t), t, order, files=files, end_after=end_after, one_by_one=one_by_one) for t in base_tables_of(name)}
    return spark.sql(FIXTURE_SQL[name], **frames)


@contextlib.contextmanager
def bounded_state(spark: SparkSession):
    """The session with ``STATE_PARTITIONS`` shuffle partitions at most, for streams started inside.

    A task of a stateful stage tells the driver a metric for each partition of each of its stores, so what the
    driver is told goes with the square of the partitions; and a partition writes its files in every
    micro-batch, however few rows it holds. ``stream_of`` bounds the rows of a micro-batch,
    and by that a partition's share of them."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key, None)
    most = max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    spark.conf.set(key, str(min(int(spark.conf.get(key)), most)))
    try:
        yield spark
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame to completion (``availableNow``) into parquet under the shared
    checkpoint folder, and return the written rows as a batch frame."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    base = f"{root}/fleetlens-streams/{name}-{uuid.uuid4().hex[:12]}"
    with bounded_state(spark):
        q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
