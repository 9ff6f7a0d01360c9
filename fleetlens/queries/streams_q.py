"""Streaming queries.

Each runs its stream to completion over several micro-batches and a closing row, and
returns all rows that were told; the oracles ask the same of the whole
tables, in batch. ``scrape_windows`` and ``readiness`` are registered in their batch forms
too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..operators import bench as B
from ..operators import inventory as I
from ..session import stored
from ..streaming import streams as ST

#: Later than any watermark, timeout or gap of the queries.
END = "400 days"

SCRAPE = """SELECT target_id, job_name, time_bucket(INTERVAL 6 HOUR, ts) AS window_start,
              time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
              count(*) AS n_samples, arg_max(value, {'ts': ts, 'value': value}) AS last_value, round(avg(value), 6) AS avg_value
       FROM fx_metric GROUP BY target_id, job_name, time_bucket(INTERVAL 6 HOUR, ts)"""


@query("scrape_windows", SCRAPE, ("fx_metric",))
def q_scrape_windows(spark, sf):
    # the fixture's samples are sparse, so the period is 6 hours instead of 15 seconds
    return ST.scrape_windows(fixture(spark, sf, "fx_metric"), every="6 hours")


@query("scrape_windows_stream", SCRAPE, ("fx_metric",))
def q_scrape_windows_stream(spark, sf):
    return ST.run_to_table(ST.scrape_windows(ST.stream_fixture(spark, sf, "fx_metric", end_after=END), every="6 hours"), "scrape")


READINESS = """WITH f AS (SELECT deploy_id, min(ts) AS first_seen FROM fx_status GROUP BY deploy_id),
            w AS (SELECT s.*, f.first_seen, CASE WHEN status IN ('RUNNING', 'STOPPED') THEN 0 ELSE 1 END AS p,
                         lag(CASE WHEN status IN ('RUNNING', 'STOPPED') THEN 0 ELSE 1 END)
                           OVER (PARTITION BY s.deploy_id, resource_id ORDER BY ts, seq) AS b
                  FROM fx_status s JOIN f ON s.deploy_id = f.deploy_id WHERE s.ts <= f.first_seen + INTERVAL 10 DAY),
            r AS (SELECT *, sum(p - coalesce(b, 0)) OVER o AS pending, sum(CASE WHEN b IS NULL THEN 1 ELSE 0 END) OVER o AS n,
                         row_number() OVER (PARTITION BY deploy_id ORDER BY ts DESC, seq DESC) AS from_end
                  FROM w WINDOW o AS (PARTITION BY deploy_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
            e AS (SELECT *, row_number() OVER (PARTITION BY deploy_id ORDER BY CASE WHEN pending = 0 THEN 0 ELSE 1 END, ts, seq) AS pick
                  FROM r WHERE pending = 0 OR from_end = 1)
       SELECT deploy_id, n::BIGINT AS n_resources, pending::BIGINT AS pending,
              CASE WHEN pending = 0 THEN 'ready' ELSE 'timed_out' END AS state, first_seen, ts AS last_seen
       FROM e WHERE pick = 1"""


@query("readiness", READINESS, ("fx_status",))
def q_readiness(spark, sf):
    return I.readiness(fixture(spark, sf, "fx_status"), timeout_s=864000, chunk=F.date_trunc("day", "ts"))


@query("readiness_stream", READINESS, ("fx_status",))
def q_readiness_stream(spark, sf):
    # the fixture's statuses are sparse, so a wait lasts ten days instead of an hour
    with ST.rocksdb_state(spark):
        s = ST.stream_fixture(spark, sf, "fx_status", end_after=END)
        return ST.run_to_table(ST.readiness_stream(s, timeout_s=864000, forget_s=40 * 86400), "readiness")


@query(
    "ready_after_stream",
    """WITH a AS (SELECT deploy_id, resource_id, min(ts) AS first_seen FROM fx_status GROUP BY deploy_id, resource_id),
            b AS (SELECT a.deploy_id, a.resource_id, first_seen, min(s.ts) AS first_ready
                  FROM a LEFT JOIN fx_status s ON s.deploy_id = a.deploy_id AND s.resource_id = a.resource_id
                   AND s.status IN ('READY', 'RUNNING', 'STOPPED') AND s.ts <= a.first_seen + INTERVAL 2 DAY
                  GROUP BY a.deploy_id, a.resource_id, first_seen)
       SELECT deploy_id, resource_id, first_seen, first_ready,
              CAST(ceil(date_diff('microsecond', first_seen, first_ready) / 1e6 / 5) * 5 AS BIGINT) AS wait_s, first_ready IS NULL AS timed_out
       FROM b""",
    ("fx_status",),
)
def q_ready_after_stream(spark, sf):
    # the wish list is known before the listings: one row a resource, at its first sight; the timeout is two days
    status = fixture(spark, sf, "fx_status")
    wanted = stored(status.groupBy("deploy_id", "resource_id").agg(F.min("ts").alias("first_seen")))
    wanted = ST.stream_of(wanted, "wanted", "first_seen", ts="first_seen", end_after=END)
    listing = ST.stream_fixture(spark, sf, "fx_status", end_after=END)
    return ST.run_to_table(ST.ready_after_stream(wanted, listing, timeout_s=2 * 86400), "ready_after")


@query(
    "idle_sessions_stream",
    """WITH c AS (SELECT client_ip, ts,
                         CASE WHEN ts - lag(ts) OVER (PARTITION BY client_ip ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new_session
                  FROM fx_conn),
            s AS (SELECT *, sum(new_session) OVER (PARTITION BY client_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM c)
       SELECT client_ip, min(ts) AS session_start, max(ts) + INTERVAL 24 HOUR AS session_end, count(*) AS n_conns, 'closed' AS state
       FROM s GROUP BY client_ip, sid""",
    ("fx_conn",),
)
def q_idle_sessions_stream(spark, sf):
    with ST.rocksdb_state(spark):
        log = ST.run_to_table(ST.idle_sessions_stream(ST.stream_fixture(spark, sf, "fx_conn", end_after=END)), "sessions")
    return ST.settled_sessions(log)


MEASURED = """WITH runs AS (SELECT run_id, min(ts) AS start_ts FROM fx_tx GROUP BY run_id)
       SELECT t.tx_id, t.run_id, t.ts, t.tx_type, t.latency_ms, t.ok FROM fx_tx t JOIN runs r ON t.run_id = r.run_id
       WHERE t.ts >= r.start_ts + INTERVAL 5 DAY AND t.ts < r.start_ts + INTERVAL 15 DAY"""


def _runs(spark, sf):
    return stored(fixture(spark, sf, "fx_tx").groupBy("run_id").agg(F.min("ts").alias("start_ts")))


@query("measured_runs", MEASURED, ("fx_tx",))
def q_measured_runs(spark, sf):
    return B.measured_runs(fixture(spark, sf, "fx_tx"), _runs(spark, sf), 5 * 86400, 10 * 86400)


@query("measured_runs_stream", MEASURED, ("fx_tx",))
def q_measured_runs_stream(spark, sf):
    tx = ST.stream_fixture(spark, sf, "fx_tx")
    return ST.run_to_table(B.measured_runs(tx, _runs(spark, sf), 5 * 86400, 10 * 86400), "measured")


@query(
    "health_stream",
    """WITH p AS (SELECT *, CASE WHEN lag(ok) OVER (PARTITION BY backend_id ORDER BY probe_no) IS DISTINCT FROM ok
                                 THEN 1 ELSE 0 END AS chg FROM fx_probe),
            r AS (SELECT *, sum(chg) OVER (PARTITION BY backend_id ORDER BY probe_no ROWS UNBOUNDED PRECEDING) AS run_id
                  FROM p),
            q AS (SELECT *, row_number() OVER (PARTITION BY backend_id, run_id ORDER BY probe_no) AS pos FROM r),
            e AS (SELECT *, CASE WHEN NOT ok AND pos = 3 THEN 'down' WHEN ok AND pos = 2 THEN 'up' END AS ev FROM q),
            s AS (SELECT backend_id, probe_no, ok,
                         coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY backend_id ORDER BY probe_no
                                                                    ROWS UNBOUNDED PRECEDING), 'up') AS state
                  FROM e)
       SELECT backend_id, probe_no, ok, state FROM (
         SELECT *, coalesce(lag(state) OVER (PARTITION BY backend_id ORDER BY probe_no), 'up') AS prev FROM s)
       WHERE state <> prev""",
    ("fx_probe",),
)
def q_health_stream(spark, sf):
    with ST.rocksdb_state(spark):
        return ST.run_to_table(ST.health_stream(ST.stream_fixture(spark, sf, "fx_probe", end_after=END, one_by_one=True)), "health")
