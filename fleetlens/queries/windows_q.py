"""Window / ordered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..operators import inventory as I
from . import common as C
from .inventory_q import JOBS_SQL, jobs

INV_FX = ("fx_profile", "fx_deployment", "fx_role_alias", "fx_instance")
BASE = f"{C.PR_CTE}, {C.DESIRED_CTE}, {C.INVENTORY_CTE}"


def observers(spark, sf):
    return C.inventory(spark, sf).where(F.col("role") == "observer").select("deploy_id", "idx", "name")


@query(
    "server_names",
    f"""WITH {BASE}
        SELECT deploy_id, idx, name,
               'server' || CAST(row_number() OVER (PARTITION BY deploy_id ORDER BY idx, name) AS VARCHAR) AS server_name
        FROM inv WHERE role = 'observer'""",
    INV_FX,
)
def q_server_names(spark, sf):
    return I.server_names(observers(spark, sf))


@query(
    "zone_assign",
    f"""WITH {BASE}
        SELECT deploy_id, idx, name,
               'zone' || CAST(((row_number() OVER (PARTITION BY deploy_id ORDER BY idx, name) - 1) % 3) + 1 AS VARCHAR)
               AS zone_name
        FROM inv WHERE role = 'observer'""",
    INV_FX,
)
def q_zone_assign(spark, sf):
    return I.zone_assign(observers(spark, sf), n_zones=3)


@query(
    "log_tail",
    f"""WITH {JOBS_SQL},
        t AS (SELECT op_id, line_no, line,
                     CAST(row_number() OVER (PARTITION BY op_id ORDER BY line_no DESC) AS INTEGER) AS rn_from_end
              FROM fx_op_line WHERE op_id IN (SELECT CAST(substr(host, 6) AS BIGINT) FROM jobs WHERE failed))
        SELECT * FROM t WHERE rn_from_end <= 40""",
    ("fx_op_line",),
)
def q_log_tail(spark, sf):
    failed = jobs(spark, sf).where("failed").select("op_id")
    lines = fixture(spark, sf, "fx_op_line").join(failed, "op_id", "left_semi").select("op_id", "line_no", "line")
    return I.log_tail(lines, 40)


@query(
    "last_error_line",
    """SELECT op_id, arg_max(line, line_no) AS last_line FROM fx_op_line GROUP BY op_id
       HAVING arg_max(line, line_no) IS NOT NULL AND trim(arg_max(line, line_no)) <> ''""",
    ("fx_op_line",),
)
def q_last_error_line(spark, sf):
    return I.last_line(fixture(spark, sf, "fx_op_line"))


@query(
    "retry_budget",
    """WITH r AS (SELECT op_id, line_no, row_number() OVER (PARTITION BY op_id ORDER BY line_no) AS rn,
                         CASE WHEN contains(line, 'The limit on maximum number of active operations has exceeded')
                              THEN 'rate_limited' WHEN contains(line, 'ERROR:') THEN 'error' ELSE 'ok' END AS cls
                  FROM fx_op_line),
            a AS (SELECT op_id, min(rn) FILTER (WHERE cls <> 'rate_limited') AS stop_rn,
                         arg_min(cls, rn) FILTER (WHERE cls <> 'rate_limited') AS stop_cls, count(*) AS n
                  FROM r WHERE rn <= 61 GROUP BY op_id),
            b AS (SELECT *, coalesce(stop_rn - 1, n) AS rl FROM a)
       SELECT op_id,
              CASE WHEN rl >= 60 THEN 'gave_up' WHEN stop_rn IS NULL THEN 'incomplete'
                   WHEN stop_cls = 'ok' THEN 'success' ELSE 'failed' END AS outcome,
              CAST(CASE WHEN rl >= 60 THEN 60 WHEN stop_rn IS NULL THEN rl ELSE rl + 1 END AS INTEGER) AS attempts,
              CAST((CASE WHEN rl >= 60 THEN 60 ELSE rl END) * 10 AS INTEGER) AS waited_s
       FROM b""",
    ("fx_op_line",),
)
def q_retry_budget(spark, sf):
    return I.retry_outcome(fixture(spark, sf, "fx_op_line"))


@query(
    "ready_after",
    """WITH a AS (SELECT deploy_id, resource_id, min(ts) AS first_seen,
                         min(ts) FILTER (WHERE status IN ('READY', 'RUNNING', 'STOPPED')) AS first_ready
                  FROM fx_status GROUP BY deploy_id, resource_id),
            b AS (SELECT *, CAST(ceil(date_diff('microsecond', first_seen, first_ready) / 1e6 / 5) * 5 AS BIGINT) AS wait_s
                  FROM a)
       SELECT deploy_id, resource_id, first_seen, first_ready, wait_s,
              first_ready IS NULL OR wait_s > 3600 AS timed_out
       FROM b""",
    ("fx_status",),
)
def q_ready_after(spark, sf):
    return I.ready_after(fixture(spark, sf, "fx_status"))
