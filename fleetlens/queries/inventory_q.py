"""Inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..operators import inventory as I
from ..sources.kv import parse_kv
from . import common as C
from .profiles_q import RESOLVED_CTE, resolved

PROF = ("fx_profile", "fx_deployment", "fx_role_alias")


@query(
    "by_deployment",
    """SELECT i.instance_id, i.name, i.label_deployment FROM fx_instance i
       JOIN fx_deployment d ON d.deploy_id = i.deploy_id WHERE i.label_deployment = d.deploy_name""",
    ("fx_instance", "fx_deployment"),
)
def q_by_deployment(spark, sf):
    i = fixture(spark, sf, "fx_instance").join(
        fixture(spark, sf, "fx_deployment").select("deploy_id", "deploy_name"), "deploy_id")
    return I.by_deployment(i, F.col("deploy_name")).select("instance_id", "name", "label_deployment")


@query(
    "orphan_disks",
    f"""WITH {C.DISKS_CTE}
        SELECT disk_id, name, label_deployment FROM disks
        WHERE label_deployment IS NOT NULL AND len(instance_ids) = 0 AND (status <> 'DELETING' OR status IS NULL)""",
    ("fx_disk",),
)
def q_orphan_disks(spark, sf):
    return I.orphan_disks(C.disk_listing(spark, sf)).select("disk_id", "name", "label_deployment")


@query(
    "delete_candidates",
    """WITH kv AS (
          SELECT file_id AS deploy_id, regexp_replace(split_part(line, '=', 1), '^\\s+|\\s+$', '', 'g') AS key,
                 regexp_replace(substr(line, strpos(line, '=') + 1), '^\\s+|\\s+$', '', 'g') AS value, line_no
          FROM fx_kv_line WHERE strpos(line, '=') > 0),
        last AS (SELECT deploy_id, key, arg_max(value, line_no) AS value FROM kv GROUP BY deploy_id, key)
        SELECT deploy_id, value AS name, 'inventory' AS source FROM last
        WHERE regexp_matches(key, '_NAME$') AND key <> 'DEPLOY_NAME'
        UNION ALL
        SELECT i.deploy_id, i.name, 'label' AS source
        FROM fx_instance i JOIN fx_deployment d ON d.deploy_id = i.deploy_id
        WHERE i.label_deployment = d.deploy_name
          AND i.deploy_id NOT IN (SELECT DISTINCT file_id FROM fx_kv_line)""",
    ("fx_kv_line", "fx_instance", "fx_deployment"),
)
def q_delete_candidates(spark, sf):
    lines = fixture(spark, sf, "fx_kv_line")
    kv = parse_kv(lines, key_cols=("file_id",)).withColumnRenamed("file_id", "deploy_id")
    files = lines.select(F.col("file_id").alias("deploy_id"))
    return I.delete_candidates(kv, fixture(spark, sf, "fx_instance"), fixture(spark, sf, "fx_deployment"), files)


@query(
    "existing_instances",
    f"""WITH {C.PR_CTE}, {C.DESIRED_CTE}
        SELECT instance_id, name, status FROM fx_instance WHERE name IN (SELECT name FROM desired)""",
    PROF + ("fx_instance",),
)
def q_existing_instances(spark, sf):
    return I.existing(fixture(spark, sf, "fx_instance"), C.desired(spark, sf)).select("instance_id", "name", "status")


@query(
    "existing_disks",
    f"""WITH {RESOLVED_CTE}, {C.PR_CTE}, {C.DESIRED_CTE},
        want AS (SELECT q.name || '-data' AS name FROM desired q JOIN resolved r ON q.deploy_id = r.deploy_id
                   AND q.role = r.role WHERE coalesce(r.data_enabled, false)
                 UNION ALL
                 SELECT q.name || '-log' FROM desired q JOIN resolved r ON q.deploy_id = r.deploy_id
                   AND q.role = r.role WHERE coalesce(r.log_enabled, false))
        SELECT disk_id, name, status FROM fx_disk
        WHERE name IN (SELECT name FROM want) AND (status <> 'DELETING' OR status IS NULL)""",
    PROF + ("fx_disk",),
)
def q_existing_disks(spark, sf):
    want = I.disk_names(C.desired(spark, sf), resolved(spark, sf)).select(F.col("disk_name").alias("name"))
    return I.existing(fixture(spark, sf, "fx_disk"), want, skip_status=("DELETING",)).select(
        "disk_id", "name", "status")


@query(
    "new_vms",
    f"""WITH {C.PR_CTE}, {C.DESIRED_CTE}
        SELECT deploy_id, role, prefix, idx, name FROM desired
        WHERE name NOT IN (SELECT name FROM fx_instance)""",
    PROF + ("fx_instance",),
)
def q_new_vms(spark, sf):
    return I.new_vms(C.desired(spark, sf), fixture(spark, sf, "fx_instance")).select(
        "deploy_id", "role", "prefix", "idx", "name")


NEW_DISKS_SQL = f"""WITH {RESOLVED_CTE}, {C.PR_CTE}, {C.DESIRED_CTE},
        nv AS (SELECT * FROM desired WHERE name NOT IN (SELECT name FROM fx_instance)),
        cand AS (SELECT q.deploy_id, q.role, q.name AS vm_name, q.name || '-data' AS disk_name,
                        r.data_type AS disk_type, r.data_size_gb AS size_gb
                 FROM nv q JOIN resolved r ON q.deploy_id = r.deploy_id AND q.role = r.role
                 WHERE coalesce(r.data_enabled, false)
                 UNION ALL
                 SELECT q.deploy_id, q.role, q.name, q.name || '-log', r.log_type, r.log_size_gb
                 FROM nv q JOIN resolved r ON q.deploy_id = r.deploy_id AND q.role = r.role
                 WHERE coalesce(r.log_enabled, false))
        SELECT * FROM cand
        WHERE disk_name NOT IN (SELECT name FROM fx_disk WHERE status <> 'DELETING' AND disk_id IS NOT NULL)"""


@query("disks_to_create", NEW_DISKS_SQL, PROF + ("fx_instance", "fx_disk"))
def q_disks_to_create(spark, sf):
    new = I.new_vms(C.desired(spark, sf), fixture(spark, sf, "fx_instance"))
    return I.disks_to_create(new, resolved(spark, sf), fixture(spark, sf, "fx_disk"))


@query("vm_queue", f"WITH {C.PR_CTE}, {C.DESIRED_CTE} "
       "SELECT *, role || ':' || prefix || ':' || CAST(idx AS VARCHAR) || ':' || name AS vm_key FROM desired",
       PROF)
def q_vm_queue(spark, sf):
    return C.desired(spark, sf)


@query(
    "image_availability",
    """WITH w AS (
          SELECT deploy_id,
                 CASE WHEN nullif(nullif(image_name, ''), 'null') IS NOT NULL THEN 'name'
                      WHEN nullif(nullif(image_family, ''), 'null') IS NOT NULL THEN 'family' END AS kind,
                 coalesce(nullif(nullif(image_name, ''), 'null'), nullif(nullif(image_family, ''), 'null')) AS wanted
          FROM fx_deployment),
        h AS (SELECT w.deploy_id, count(*) AS matches FROM w JOIN fx_image i
                ON (w.kind = 'name' AND i.name = w.wanted)
                OR (w.kind = 'family' AND (i.family = w.wanted OR i.family_id = w.wanted))
              GROUP BY w.deploy_id)
        SELECT w.deploy_id, w.kind, w.wanted, CAST(coalesce(h.matches, 0) AS BIGINT) AS matches,
               coalesce(h.matches, 0) = 0 AS warn
        FROM w LEFT JOIN h ON w.deploy_id = h.deploy_id WHERE w.kind IS NOT NULL""",
    ("fx_deployment", "fx_image"),
)
def q_image_availability(spark, sf):
    return I.image_availability(fixture(spark, sf, "fx_deployment"), fixture(spark, sf, "fx_image"))


@query(
    "disk_attachments",
    f"""WITH {C.DISKS_CTE},
        d AS (SELECT disk_id, name AS disk_name, unnest(CASE WHEN len(instance_ids) = 0 THEN [NULL::BIGINT]
                                                             ELSE instance_ids END) AS instance_id FROM disks),
        i AS (SELECT DISTINCT instance_id, name AS instance_name FROM fx_instance)
        SELECT d.disk_id, d.disk_name, coalesce(d.instance_id, i.instance_id) AS instance_id, i.instance_name
        FROM d FULL OUTER JOIN i ON d.instance_id = i.instance_id""",
    ("fx_disk", "fx_instance"),
)
def q_disk_attachments(spark, sf):
    return I.disk_attachments(C.disk_listing(spark, sf), fixture(spark, sf, "fx_instance"))


@query(
    "scale_out_delta",
    f"""WITH {C.PR_CTE}, {C.DESIRED_CTE},
        cur AS (SELECT q.deploy_id, d.deploy_name, max(q.idx) AS current FROM desired q
                JOIN fx_deployment d ON d.deploy_id = q.deploy_id WHERE q.role = 'observer'
                GROUP BY q.deploy_id, d.deploy_name),
        n AS (SELECT deploy_id, deploy_name, current, CAST(unnest(generate_series(current + 1, current + 2)) AS INTEGER) AS idx
              FROM cur),
        nn AS (SELECT *, deploy_name || '-observer-' || CAST(idx AS VARCHAR) AS name FROM n)
        SELECT nn.deploy_id, nn.idx, nn.name, nn.name IN (SELECT name FROM fx_instance) AS "exists",
               nn.current + 2 AS new_total
        FROM nn""",
    PROF + ("fx_instance",),
)
def q_scale_out_delta(spark, sf):
    vms = C.desired(spark, sf).join(fixture(spark, sf, "fx_deployment").select("deploy_id", "deploy_name"), "deploy_id")
    return I.scale_out(vms, fixture(spark, sf, "fx_instance"), add=2)


@query(
    "pending_disks",
    f"""WITH {RESOLVED_CTE}, {C.PR_CTE}, {C.DESIRED_CTE},
        want AS (SELECT DISTINCT q.deploy_id, q.name || '-data' AS name FROM desired q JOIN resolved r
                   ON q.deploy_id = r.deploy_id AND q.role = r.role WHERE coalesce(r.data_enabled, false)
                 UNION
                 SELECT DISTINCT q.deploy_id, q.name || '-log' FROM desired q JOIN resolved r
                   ON q.deploy_id = r.deploy_id AND q.role = r.role WHERE coalesce(r.log_enabled, false)),
        pend AS (SELECT w.deploy_id, count(*) FILTER (WHERE d.status <> 'READY') AS pending
                 FROM want w JOIN fx_disk d ON d.name = w.name GROUP BY w.deploy_id),
        miss AS (SELECT deploy_id, count(*) AS missing FROM want WHERE name NOT IN (SELECT name FROM fx_disk)
                 GROUP BY deploy_id)
        SELECT k.deploy_id, CAST(coalesce(p.pending, 0) AS BIGINT) AS pending,
               CAST(coalesce(m.missing, 0) AS BIGINT) AS missing
        FROM (SELECT DISTINCT deploy_id FROM want) k LEFT JOIN pend p ON k.deploy_id = p.deploy_id
        LEFT JOIN miss m ON k.deploy_id = m.deploy_id""",
    PROF + ("fx_disk",),
)
def q_pending_disks(spark, sf):
    want = I.disk_names(C.desired(spark, sf), resolved(spark, sf))
    return I.pending_disks(fixture(spark, sf, "fx_disk"), want)


@query(
    "pending_instances",
    """WITH l AS (SELECT deploy_id, resource_id, arg_max(status, seq) AS status FROM fx_status
                  GROUP BY deploy_id, resource_id)
       SELECT deploy_id, count(*) AS n_resources,
              count(*) FILTER (WHERE status NOT IN ('RUNNING', 'STOPPED')) AS pending
       FROM l GROUP BY deploy_id""",
    ("fx_status",),
)
def q_pending_instances(spark, sf):
    return I.pending_instances(fixture(spark, sf, "fx_status"))


@query(
    "role_counts",
    f"""WITH {C.PR_CTE}, {C.DESIRED_CTE}
        SELECT deploy_id,
               count(*) FILTER (WHERE role = 'observer') AS observer_count,
               count(*) FILTER (WHERE role = 'obproxy') AS obproxy_count,
               count(*) FILTER (WHERE role = 'configserver') AS configserver_count,
               count(*) FILTER (WHERE role = 'monitoring') AS monitor_count,
               count(*) FILTER (WHERE role = 'ocp') AS ocp_count
        FROM desired GROUP BY deploy_id""",
    PROF,
)
def q_role_counts(spark, sf):
    return I.role_counts(C.desired(spark, sf))


JOBS_SQL = """jobs AS (
  SELECT op_id % 3 AS run_id, 'host-' || CAST(op_id AS VARCHAR) AS host,
         'observer-host-' || CAST(op_id AS VARCHAR) || '.log' AS log_name,
         bool_or(contains(line, 'ERROR:') AND NOT contains(line, 'The limit on maximum number of active operations has exceeded')) AS failed
  FROM fx_op_line GROUP BY op_id)"""


def jobs(spark, sf):
    """One prepare job per operation log: failed when a line is a (non rate-limit) error."""
    from ..functions.scalars import host_log_name

    lines = I.classify_op_lines(fixture(spark, sf, "fx_op_line"))
    j = lines.groupBy("op_id").agg(F.bool_or(F.col("line_class") == "error").alias("failed"))
    host = F.concat(F.lit("host-"), F.col("op_id").cast("string"))
    return j.select("op_id", (F.col("op_id") % 3).alias("run_id"), host.alias("host"),
                    host_log_name(F.lit("observer"), host).alias("log_name"), "failed")


@query(
    "failed_hosts",
    f"""WITH {JOBS_SQL}
        SELECT j.run_id, j.host, j.log_name, n.n_failed
        FROM jobs j JOIN (SELECT run_id, count(*) AS n_failed FROM jobs WHERE failed GROUP BY run_id) n
          ON j.run_id = n.run_id
        WHERE j.failed""",
    ("fx_op_line",),
)
def q_failed_hosts(spark, sf):
    return I.failed_hosts(jobs(spark, sf))


@query(
    "fleet_totals",
    f"""WITH {RESOLVED_CTE},
        r AS (SELECT deploy_id, role, cores, memory_gb,
                     CASE WHEN role = 'configserver' AND NOT dedicated THEN 0 WHEN NOT enabled THEN 0 ELSE vm_count END AS vms
              FROM resolved)
        SELECT deploy_id, role, CAST(sum(vms) AS BIGINT) AS vms, CAST(sum(vms * cores) AS BIGINT) AS vcpu,
               CAST(sum(vms * memory_gb) AS BIGINT) AS memory_gb, CAST(grouping(deploy_id, role) AS INTEGER) AS level
        FROM r GROUP BY ROLLUP (deploy_id, role)""",
    PROF,
)
def q_fleet_totals(spark, sf):
    return I.fleet_totals(resolved(spark, sf))


@query(
    "host_lists",
    f"""WITH {C.PR_CTE}, {C.DESIRED_CTE}, {C.INVENTORY_CTE}
        SELECT deploy_id, role, array_to_string(list({C.host_sql('name', 'ip', 'zone')} ORDER BY idx), ',') AS hosts
        FROM inv GROUP BY deploy_id, role""",
    PROF + ("fx_instance",),
)
def q_host_lists(spark, sf):
    h = I.host_lists(C.inventory(spark, sf))
    return h.select("deploy_id", "role", F.array_join("hosts", ",").alias("hosts"))


@query(
    "first_candidate",
    f"""WITH {C.DISKS_CTE}
        SELECT label_deployment, arg_min(name, disk_id) FILTER (WHERE status = 'READY' AND len(instance_ids) = 0
                                                              AND NOT ends_with(name, '-boot')) AS name
        FROM disks GROUP BY label_deployment""",
    ("fx_disk",),
)
def q_first_candidate(spark, sf):
    d = C.disk_listing(spark, sf)
    usable = (F.col("status") == "READY") & (F.size("instance_ids") == 0) & ~F.col("name").endswith("-boot")
    return I.first_candidate(d, "label_deployment", "name", "disk_id", usable)


@query(
    "cluster_hosts",
    f"""WITH {C.PR_CTE}, {C.DESIRED_CTE}, {C.INVENTORY_CTE},
        h AS (SELECT deploy_id, role, idx, {C.host_sql('name', 'ip', 'zone')} AS host FROM inv
              WHERE role IN ('observer', 'obproxy', 'configserver', 'monitoring'))
        SELECT deploy_id, CASE role WHEN 'observer' THEN 1 WHEN 'obproxy' THEN 2 WHEN 'configserver' THEN 3 ELSE 4 END
               AS section, idx, role, host
        FROM h WHERE NOT (role = 'configserver' AND host IS NULL)""",
    PROF + ("fx_instance",),
)
def q_cluster_hosts(spark, sf):
    return I.cluster_hosts(C.inventory(spark, sf))
