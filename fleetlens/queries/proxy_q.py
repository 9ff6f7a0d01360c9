"""Proxy-tier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..operators import proxy as X


@query(
    "lb_round_robin",
    "SELECT conn_id, ts, client_ip, (row_number() OVER (ORDER BY ts, conn_id) - 1) % 2 AS backend FROM fx_conn",
    ("fx_conn",),
)
def q_lb_round_robin(spark, sf):
    c = fixture(spark, sf, "fx_conn").select("conn_id", "ts", "client_ip")
    return X.assign_round_robin(c, 2)


@query(
    "health_state",
    """WITH p AS (SELECT *, CASE WHEN lag(ok) OVER (PARTITION BY backend_id ORDER BY probe_no) IS DISTINCT FROM ok
                                 THEN 1 ELSE 0 END AS chg FROM fx_probe),
            r AS (SELECT *, sum(chg) OVER (PARTITION BY backend_id ORDER BY probe_no ROWS UNBOUNDED PRECEDING) AS run_id
                  FROM p),
            q AS (SELECT *, row_number() OVER (PARTITION BY backend_id, run_id ORDER BY probe_no) AS pos FROM r),
            e AS (SELECT *, CASE WHEN NOT ok AND pos = 3 THEN 'down' WHEN ok AND pos = 2 THEN 'up' END AS ev FROM q)
       SELECT backend_id, probe_no, ts, ok,
              coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY backend_id ORDER BY probe_no
                                                         ROWS UNBOUNDED PRECEDING), 'up') AS state
       FROM e""",
    ("fx_probe",),
)
def q_health_state(spark, sf):
    # chunks of 1000 probe numbers, so the fixture crosses many chunk edges
    return X.health_state(fixture(spark, sf, "fx_probe"), chunk_size=1000)


@query(
    "sticky_backend",
    """SELECT conn_id, client_ip,
              CAST(CAST(('0x' || substr(md5(client_ip), 1, 8)) AS BIGINT) % 2 AS INTEGER) AS backend
       FROM fx_conn""",
    ("fx_conn",),
)
def q_sticky_backend(spark, sf):
    return X.sticky_backend(fixture(spark, sf, "fx_conn").select("conn_id", "client_ip"), 2)


@query(
    "idle_sessions",
    """WITH c AS (SELECT client_ip, ts,
                         CASE WHEN lag(ts) OVER (PARTITION BY client_ip ORDER BY ts) IS NULL
                                OR ts - lag(ts) OVER (PARTITION BY client_ip ORDER BY ts) >= INTERVAL 24 HOUR
                              THEN 1 ELSE 0 END AS new_session
                  FROM fx_conn),
            s AS (SELECT *, sum(new_session) OVER (PARTITION BY client_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
                  FROM c)
       SELECT client_ip, min(ts) AS session_start, max(ts) + INTERVAL 24 HOUR AS session_end,
              count(*) AS n_conns
       FROM s GROUP BY client_ip, sid""",
    ("fx_conn",),
)
def q_idle_sessions(spark, sf):
    return X.idle_sessions(fixture(spark, sf, "fx_conn"))
