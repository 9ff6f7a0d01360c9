"""Profile queries on fx_profile / fx_deployment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..functions.scalars import merge_disk
from ..operators import profiles as P
from .common import shared

FX = ("fx_profile", "fx_deployment", "fx_role_alias")


def _round(size: str, typ: str) -> str:
    return (
        f"CASE WHEN nullif({typ}, '') IS NOT NULL AND {size} IS NOT NULL AND {size} <> 0 THEN "
        f"(CASE WHEN {typ} IN ('network-ssd-nonreplicated', 'network-ssd-io-m3') "
        f"THEN greatest(93, CAST(ceil(greatest(1, {size}) / 93.0) * 93 AS INTEGER)) "
        f"ELSE greatest(1, {size}) END) ELSE {size} END"
    )


# The resolver as SQL: shared by the oracle texts below.
RESOLVED_CTE = f"""resolved AS (
  SELECT p.deploy_id, a.role,
         coalesce(p.platform, d.default_platform, 'standard-v3') AS platform,
         coalesce(p.cores, d.default_cores, 4) AS cores,
         coalesce(p.memory_gb, d.default_memory_gb, 16) AS memory_gb,
         CASE WHEN nullif(d.image_name, '') IS NOT NULL
              THEN 'image-folder-id=' || coalesce(nullif(d.image_folder_id, ''), 'standard-images') || ',image-name=' || d.image_name
              ELSE 'image-folder-id=' || coalesce(nullif(d.image_folder_id, ''), 'standard-images') || ',image-family='
                   || coalesce(nullif(d.image_family, ''), 'ubuntu-2204-lts') END AS image_spec,
         coalesce(d.default_core_fraction, 100) AS core_fraction,
         CAST(NULL AS BOOLEAN) AS boot_enabled, p.boot_type, {_round('p.boot_size_gb', 'p.boot_type')} AS boot_size_gb,
         CAST(NULL AS VARCHAR) AS boot_mount,
         p.data_enabled, p.data_type, {_round('p.data_size_gb', 'p.data_type')} AS data_size_gb,
         CAST(NULL AS VARCHAR) AS data_mount,
         p.log_enabled, p.log_type, {_round('p.log_size_gb', 'p.log_type')} AS log_size_gb,
         CAST(NULL AS VARCHAR) AS log_mount,
         coalesce(p.vm_count, 1) AS vm_count, coalesce(p.enabled, true) AS enabled,
         coalesce(p.dedicated, true) AS dedicated,
         p.vm_count AS raw_count, p.enabled AS raw_enabled, p.dedicated AS raw_dedicated
  FROM fx_profile p JOIN fx_role_alias a ON p.role_in = a.alias
  LEFT JOIN fx_deployment d ON d.deploy_id = p.deploy_id)"""

RESOLVED_COLS = (
    "deploy_id, role, platform, cores, memory_gb, image_spec, core_fraction, boot_enabled, boot_type, boot_size_gb, "
    "boot_mount, data_enabled, data_type, data_size_gb, data_mount, log_enabled, log_type, log_size_gb, log_mount, "
    "vm_count, enabled, dedicated"
)

TUNED_CTE = """tuned AS (
  SELECT deploy_id,
         CAST(greatest(4, memory_gb - greatest(4, memory_gb // 8)) AS VARCHAR) || 'G' AS memory_limit,
         CAST(least(4, greatest(2, memory_gb // 8)) AS VARCHAR) || 'G' AS system_memory,
         CAST(greatest(20, CAST(floor(coalesce(data_size_gb, 100) * CAST(0.85 AS DOUBLE)) AS INTEGER)) AS VARCHAR) || 'G'
           AS datafile_size,
         CAST(CASE WHEN (CASE WHEN coalesce(log_enabled, false) THEN coalesce(log_size_gb, 0) ELSE 0 END) <> 0
                   THEN greatest(15, CAST(floor(coalesce(log_size_gb, 0) * CAST(0.9 AS DOUBLE)) AS INTEGER))
                   ELSE greatest(15, 3 * greatest(4, memory_gb - greatest(4, memory_gb // 8))) END AS VARCHAR) || 'G'
           AS log_disk_size,
         cores AS cpu_count
  FROM resolved WHERE role = 'observer')"""

ISSUES_CTE = """mins AS (SELECT * FROM fx_role_min),
issues AS (
  SELECT deploy_id, role, 'observer_count' AS rule, 'WARN' AS severity,
         'observer.count=' || CAST(coalesce(raw_count, 0) AS VARCHAR) || ' < 3' AS message
  FROM resolved WHERE role = 'observer' AND coalesce(raw_count, 0) < 3
  UNION ALL
  SELECT deploy_id, 'observer', 'observer_count', 'WARN', 'observer.count=0 < 3' FROM fx_deployment
  WHERE deploy_id NOT IN (SELECT deploy_id FROM resolved WHERE role = 'observer')
  UNION ALL
  SELECT r.deploy_id, r.role, 'min_cores', 'ERROR',
         r.role || ': cores=' || CAST(r.cores AS VARCHAR) || ' < ' || CAST(m.min_cores AS VARCHAR)
  FROM resolved r JOIN mins m ON r.role = m.role
  WHERE r.cores < m.min_cores
    AND NOT (r.role = 'configserver' AND NOT coalesce(r.raw_dedicated, false))
    AND NOT (r.role IN ('monitoring', 'ocp') AND NOT coalesce(r.raw_enabled, false))
  UNION ALL
  SELECT r.deploy_id, r.role, 'min_memory', 'ERROR',
         r.role || ': memory_gb=' || CAST(r.memory_gb AS VARCHAR) || ' < ' || CAST(m.min_memory_gb AS VARCHAR)
  FROM resolved r JOIN mins m ON r.role = m.role
  WHERE r.memory_gb < m.min_memory_gb
    AND NOT (r.role = 'configserver' AND NOT coalesce(r.raw_dedicated, false))
    AND NOT (r.role IN ('monitoring', 'ocp') AND NOT coalesce(r.raw_enabled, false))
  UNION ALL
  SELECT deploy_id, role, 'min_data_disk', 'ERROR',
         'observer data_disk.size_gb=' || CAST(coalesce(data_size_gb, 0) AS VARCHAR) || ' < 100'
  FROM resolved WHERE role = 'observer' AND coalesce(data_enabled, false) AND coalesce(data_size_gb, 0) < 100
  UNION ALL
  SELECT deploy_id, role, 'data_disk_type', 'WARN', 'observer data_disk.type=' || coalesce(data_type, '')
  FROM resolved WHERE role = 'observer' AND coalesce(data_enabled, false)
    AND coalesce(data_type, '') <> 'network-ssd-nonreplicated'
  UNION ALL
  SELECT deploy_id, role, 'log_disk_type', 'WARN', 'observer log_disk.type=' || coalesce(log_type, '')
  FROM resolved WHERE role = 'observer' AND coalesce(data_enabled, false) AND coalesce(log_enabled, false)
    AND coalesce(log_type, '') <> 'network-ssd-io-m3')"""


def inputs(spark, sf):
    return (
        fixture(spark, sf, "fx_profile"),
        fixture(spark, sf, "fx_deployment"),
        fixture(spark, sf, "fx_role_alias"),
    )


@shared
def resolved(spark, sf):
    prof, dep, ali = inputs(spark, sf)
    return P.resolve_profiles(prof, dep, ali)[0]


@shared
def issues(spark, sf):
    prof, dep, ali = inputs(spark, sf)
    return P.audit_profiles(prof, dep, ali, fixture(spark, sf, "fx_role_min"))


@query(
    "disk_merge",
    """SELECT deploy_id, role_in,
              coalesce(data_enabled, false) AS enabled, coalesce(data_type, 'network-ssd') AS type,
              coalesce(data_size_gb, 0) AS size_gb, '/data' AS mount_point
       FROM fx_profile""",
    ("fx_profile",),
)
def q_disk_merge(spark, sf):
    p = fixture(spark, sf, "fx_profile")
    base = {"enabled": F.lit(False), "type": F.lit("network-ssd"), "size_gb": F.lit(0), "mount_point": F.lit("/data")}
    over = {"enabled": F.col("data_enabled"), "type": F.col("data_type"), "size_gb": F.col("data_size_gb")}
    return p.select("deploy_id", "role_in", merge_disk(base, over).alias("d")).select("deploy_id", "role_in", "d.*")


@query("role_lookup",
       """SELECT p.deploy_id, p.role_in, coalesce(a.role, p.role_in) AS role
          FROM fx_profile p LEFT JOIN fx_role_alias a ON p.role_in = a.alias""",
       ("fx_profile", "fx_role_alias"))
def q_role_lookup(spark, sf):
    p, _, a = inputs(spark, sf)
    return P.role_lookup(p, a).select("deploy_id", "role_in", "role")


# every fiftieth deployment asks for a management role that does not exist
UNKNOWN = "p.deploy_id % 50 = 0 AND p.role_in = 'ocp'"


@query("profile_resolve", f"""WITH {RESOLVED_CTE}
        SELECT {RESOLVED_COLS}, CAST(NULL AS VARCHAR) AS role_in, CAST(NULL AS VARCHAR) AS reason
        FROM resolved WHERE NOT (deploy_id % 50 = 0 AND role = 'ocp')
        UNION ALL BY NAME
        SELECT p.deploy_id, 'ocp-next' AS role_in, 'unknown vm profile role' AS reason FROM fx_profile p WHERE {UNKNOWN}""", FX)
def q_profile_resolve(spark, sf):
    """Resolved profiles, and a row with the reason for each requested role that is unknown."""
    prof, dep, ali = inputs(spark, sf)
    asked = prof.alias("p").withColumn("role_in", F.when(F.expr(UNKNOWN), F.lit("ocp-next")).otherwise(F.col("role_in")))
    res, rejects = P.resolve_profiles(asked, dep, ali)
    return res.unionByName(rejects, allowMissingColumns=True)


@query("auto_tune", f"WITH {RESOLVED_CTE}, {TUNED_CTE} SELECT * FROM tuned", FX)
def q_auto_tune(spark, sf):
    return P.auto_tune(resolved(spark, sf))


@query(
    "tune_override",
    f"""WITH {RESOLVED_CTE}, {TUNED_CTE}
        SELECT d.deploy_id, coalesce(d.auto_tune, true) AS auto_tune_on,
               CASE WHEN coalesce(d.auto_tune, true) THEN t.memory_limit ELSE d.memory_limit END AS memory_limit,
               CASE WHEN coalesce(d.auto_tune, true) THEN t.system_memory ELSE d.system_memory END AS system_memory,
               CASE WHEN coalesce(d.auto_tune, true) THEN t.datafile_size ELSE d.datafile_size END AS datafile_size,
               CASE WHEN coalesce(d.auto_tune, true) THEN t.log_disk_size ELSE d.log_disk_size END AS log_disk_size,
               CASE WHEN coalesce(d.auto_tune, true) THEN t.cpu_count ELSE d.cpu_count END AS cpu_count
        FROM fx_deployment d LEFT JOIN tuned t ON d.deploy_id = t.deploy_id""",
    FX,
)
def q_tune_override(spark, sf):
    dep = fixture(spark, sf, "fx_deployment")
    return P.effective_tuning(dep, P.auto_tune(resolved(spark, sf)))


@query("profile_audit", f"WITH {RESOLVED_CTE}, {ISSUES_CTE} SELECT * FROM issues", FX + ("fx_role_min",))
def q_profile_audit(spark, sf):
    return issues(spark, sf)


@query(
    "issue_route",
    f"""WITH {RESOLVED_CTE}, {ISSUES_CTE}
        SELECT *, CASE WHEN severity = 'ERROR' THEN 'errors' ELSE 'others' END AS route FROM issues""",
    FX + ("fx_role_min",),
)
def q_issue_route(spark, sf):
    return P.routed(issues(spark, sf))


@query(
    "audit_status",
    f"""WITH {RESOLVED_CTE}, {ISSUES_CTE},
        s AS (SELECT deploy_id, CAST(count(*) FILTER (WHERE severity = 'ERROR') AS BIGINT) AS n_errors,
                     CAST(count(*) FILTER (WHERE severity <> 'ERROR') AS BIGINT) AS n_warnings
              FROM issues GROUP BY deploy_id)
        SELECT d.deploy_id, coalesce(s.n_errors, 0) AS n_errors, coalesce(s.n_warnings, 0) AS n_warnings,
               coalesce(s.n_errors, 0) > 0 AS failed
        FROM fx_deployment d LEFT JOIN s ON d.deploy_id = s.deploy_id""",
    FX + ("fx_role_min",),
)
def q_audit_status(spark, sf):
    return P.audit_status(issues(spark, sf), fixture(spark, sf, "fx_deployment"))
