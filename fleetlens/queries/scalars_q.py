"""Scalar / projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..functions import scalars as S
from ..operators import inventory as I
from . import common as C
from .profiles_q import RESOLVED_CTE, resolved

ESC = "\u001b"


@query(
    "disk_round",
    """SELECT disk_id, type, size_gb,
              CASE WHEN type IN ('network-ssd-nonreplicated', 'network-ssd-io-m3')
                   THEN greatest(93, CAST(ceil(greatest(1, size_gb) / 93.0) * 93 AS INTEGER))
                   ELSE greatest(1, size_gb) END AS rounded_gb
       FROM fx_disk""",
    ("fx_disk",),
)
def q_disk_round(spark, sf):
    d = fixture(spark, sf, "fx_disk")
    return d.select("disk_id", "type", "size_gb", S.round_disk("size_gb", "type").alias("rounded_gb"))


@query(
    "image_spec",
    """SELECT deploy_id,
              CASE WHEN nullif(image_name, '') IS NOT NULL
                   THEN 'image-folder-id=' || coalesce(nullif(image_folder_id, ''), 'standard-images') || ',image-name=' || image_name
                   ELSE 'image-folder-id=' || coalesce(nullif(image_folder_id, ''), 'standard-images') || ',image-family='
                        || coalesce(nullif(image_family, ''), 'ubuntu-2204-lts') END AS image_spec
       FROM fx_deployment""",
    ("fx_deployment",),
)
def q_image_spec(spark, sf):
    d = fixture(spark, sf, "fx_deployment")
    none = F.lit(None).cast("string")
    return d.select("deploy_id", S.image_spec(none, none, none, "image_folder_id", "image_name", "image_family")
                    .alias("image_spec"))


@query("zone_region", f"SELECT deploy_id, zone, {C.region_sql('zone')} AS region FROM fx_deployment",
       ("fx_deployment",))
def q_zone_region(spark, sf):
    return fixture(spark, sf, "fx_deployment").select("deploy_id", "zone", S.zone_region("zone").alias("region"))


@query(
    "internal_fqdn",
    f"""SELECT i.instance_id, i.name, d.zone, {C.fqdn_sql('i.name', 'd.zone')} AS fqdn
        FROM fx_instance i LEFT JOIN fx_deployment d ON d.deploy_id = i.deploy_id""",
    ("fx_instance", "fx_deployment"),
)
def q_internal_fqdn(spark, sf):
    return I.fqdn_frame(fixture(spark, sf, "fx_instance"), fixture(spark, sf, "fx_deployment"))


@query(
    "host_address",
    f"""SELECT i.instance_id, {C.host_sql('i.name', 'i.ip_address', 'd.zone')} AS host,
               nullif(i.ip_address, '') AS ip_strict
        FROM fx_instance i LEFT JOIN fx_deployment d ON d.deploy_id = i.deploy_id""",
    ("fx_instance", "fx_deployment"),
)
def q_host_address(spark, sf):
    i = fixture(spark, sf, "fx_instance").join(
        fixture(spark, sf, "fx_deployment").select("deploy_id", "zone"), "deploy_id", "left")
    return i.select(
        "instance_id",
        S.host_address("name", "ip_address", "zone").alias("host"),
        S.host_address("name", "ip_address", "zone", strict=True).alias("ip_strict"),
    )


@query(
    "pick_ip",
    "SELECT instance_id, coalesce(nullif(ip_address, ''), nullif(nat_address, ''), '') AS ip FROM fx_instance",
    ("fx_instance",),
)
def q_pick_ip(spark, sf):
    i = fixture(spark, sf, "fx_instance")
    iface = F.struct(F.struct(F.col("ip_address").alias("address"),
                              F.struct(F.col("nat_address").alias("address")).alias("one_to_one_nat"))
                     .alias("primary_v4_address"))
    return i.select("instance_id", S.pick_ip(F.array(iface)).alias("ip"))


@query(
    "disk_state",
    f"""WITH {C.DISKS_CTE},
        l AS (SELECT name, arg_max({{'status': status, 'n': len(instance_ids), 'id': disk_id}}, disk_id) AS s
              FROM disks GROUP BY name)
        SELECT name, CASE WHEN s.status = 'DELETING' THEN 'deleting' WHEN coalesce(s.n, 0) > 0 THEN 'attached'
                          ELSE 'orphan' END AS state,
               s.id IS NOT NULL AND coalesce(s.status, '') <> 'DELETING' AS exists_strict
        FROM l""",
    ("fx_disk",),
)
def q_disk_state(spark, sf):
    return I.disk_states(C.disk_listing(spark, sf))


@query(
    "role_disk_needs",
    f"""WITH {RESOLVED_CTE}, {C.PR_CTE}, {C.DESIRED_CTE}
        SELECT q.deploy_id, q.role, q.name,
               CASE WHEN q.role = 'observer' THEN true WHEN q.role IN ('obproxy', 'configserver') THEN false
                    ELSE coalesce(r.data_enabled, false) END AS need_data,
               CASE WHEN (CASE WHEN q.role = 'observer' THEN true WHEN q.role IN ('obproxy', 'configserver') THEN false
                               ELSE coalesce(r.data_enabled, false) END)
                    THEN (CASE WHEN q.role = 'ocp' THEN coalesce(r.data_mount, '/ocp-data')
                               ELSE coalesce(r.data_mount, '/data') END) END AS data_mount,
               CASE WHEN q.role = 'observer' THEN coalesce(r.log_enabled, false) ELSE false END AS need_log,
               CASE WHEN q.role = 'observer' AND coalesce(r.log_enabled, false)
                    THEN coalesce(r.log_mount, '/data/log1') END AS log_mount
        FROM desired q LEFT JOIN resolved r ON q.deploy_id = r.deploy_id AND q.role = r.role""",
    ("fx_profile", "fx_deployment", "fx_role_alias"),
)
def q_role_disk_needs(spark, sf):
    return I.role_disk_needs(C.desired(spark, sf), resolved(spark, sf))


@query(
    "feature_flags",
    f"""WITH {RESOLVED_CTE},
        p AS (SELECT deploy_id,
                     bool_or(role = 'monitoring' AND coalesce(raw_enabled, false)) AS mon_vm,
                     bool_or(role = 'ocp' AND coalesce(raw_enabled, false)) AS ocp_vm,
                     max(CASE WHEN role = 'observer' THEN raw_count END) AS obs
              FROM resolved GROUP BY deploy_id)
        SELECT d.deploy_id,
               coalesce(d.ocp_enabled, false) AND coalesce(p.ocp_vm, false) AS management,
               coalesce(d.prometheus_component, false) OR coalesce(p.mon_vm, false) AS prometheus,
               coalesce(d.grafana_component, false) OR coalesce(p.mon_vm, false) AS grafana,
               coalesce(d.node_exporter_enabled, true)
                 AND (coalesce(p.mon_vm, false) OR coalesce(d.prometheus_component, false)) AS node_exporter,
               coalesce(d.configserver_component, true) AS configserver, coalesce(d.database_component, true) AS database,
               coalesce(d.proxy_component, true) AS proxy, coalesce(d.agent_component, true) AS agent,
               coalesce(p.obs, 3) >= 3 AS production_mode
        FROM fx_deployment d LEFT JOIN p ON d.deploy_id = p.deploy_id""",
    ("fx_profile", "fx_deployment", "fx_role_alias"),
)
def q_feature_flags(spark, sf):
    return I.feature_flags(fixture(spark, sf, "fx_deployment"), C.resolved_raw(spark, sf))


@query(
    "user_audit",
    """SELECT deploy_id, coalesce(nullif(nullif(deploy_user, ''), 'null'), ssh_user) AS deploy_user_eff,
              coalesce(nullif(nullif(ssh_user, ''), 'null') IS NOT NULL
                       AND coalesce(nullif(nullif(deploy_user, ''), 'null'), ssh_user) <> ssh_user, false) AS mismatch
       FROM fx_deployment""",
    ("fx_deployment",),
)
def q_user_audit(spark, sf):
    d = fixture(spark, sf, "fx_deployment")
    eff = S.user_effective("deploy_user", "ssh_user")
    ssh_set = F.nullif(F.nullif(F.col("ssh_user"), F.lit("")), F.lit("null")).isNotNull()
    return d.select("deploy_id", eff.alias("deploy_user_eff"),
                    F.coalesce(ssh_set & (eff != F.col("ssh_user")), F.lit(False)).alias("mismatch"))


@query(
    "flag_audit",
    f"""WITH {C.PR_CTE},
        o AS (SELECT deploy_id, bool_or(coalesce(enabled, false)) AS ocp_vm FROM pr WHERE role = 'ocp' GROUP BY deploy_id)
        SELECT d.deploy_id, coalesce(d.ocp_enabled, false) AS ocp_enabled, coalesce(o.ocp_vm, false) AS ocp_vm_enabled,
               'management needs both ocp.enabled and vm_profiles.ocp.enabled' AS warning
        FROM fx_deployment d LEFT JOIN o ON d.deploy_id = o.deploy_id
        WHERE coalesce(d.ocp_enabled, false) <> coalesce(o.ocp_vm, false)""",
    ("fx_profile", "fx_deployment", "fx_role_alias"),
)
def q_flag_audit(spark, sf):
    p = C.profiles_with_role(spark, sf)
    o = p.where(F.col("role") == "ocp").groupBy("deploy_id").agg(
        F.bool_or(F.coalesce("enabled", F.lit(False))).alias("_vm"))
    d = fixture(spark, sf, "fx_deployment").join(o, "deploy_id", "left")
    a = F.coalesce("ocp_enabled", F.lit(False))
    b = F.coalesce("_vm", F.lit(False))
    return d.where(a != b).select(
        "deploy_id", a.alias("ocp_enabled"), b.alias("ocp_vm_enabled"),
        F.lit("management needs both ocp.enabled and vm_profiles.ocp.enabled").alias("warning"))


@query(
    "op_line_class",
    """SELECT op_id, line_no,
              CASE WHEN contains(line, 'The limit on maximum number of active operations has exceeded') THEN 'rate_limited'
                   WHEN contains(line, 'ERROR:') THEN 'error' ELSE 'ok' END AS line_class
       FROM fx_op_line""",
    ("fx_op_line",),
)
def q_op_line_class(spark, sf):
    return I.classify_op_lines(fixture(spark, sf, "fx_op_line")).select("op_id", "line_no", "line_class")


@query(
    "ansi_clean",
    """WITH c AS (SELECT op_id, line_no,
                         CASE WHEN line_no % 3 = 0 THEN chr(27) || '[32m' || line || chr(27) || '[0m'
                              WHEN line_no % 3 = 1 THEN chr(27) || '[1;31m' || line || chr(27) || '[K'
                              ELSE line END AS raw
                  FROM fx_op_line),
            d AS (SELECT op_id, line_no, regexp_replace(raw, chr(27) || '\\[[0-9;?]*[A-Za-z]', '', 'g') AS clean FROM c)
       SELECT op_id, line_no, clean, regexp_matches(clean, '(^|\\s)done(\\s|$)') AS matched FROM d""",
    ("fx_op_line",),
)
def q_ansi_clean(spark, sf):
    lines = fixture(spark, sf, "fx_op_line")
    raw = (
        F.when(F.col("line_no") % 3 == 0, F.concat(F.lit(ESC + "[32m"), "line", F.lit(ESC + "[0m")))
        .when(F.col("line_no") % 3 == 1, F.concat(F.lit(ESC + "[1;31m"), "line", F.lit(ESC + "[K")))
        .otherwise(F.col("line"))
    )
    c = lines.select("op_id", "line_no", raw.alias("raw"))
    return c.select("op_id", "line_no", S.ansi_clean("raw").alias("clean"), S.word_match("raw", "done").alias("matched"))


@query(
    "host_log_name",
    f"""SELECT i.instance_id,
               'observer-' || replace(replace(replace({C.fqdn_sql('i.name', 'd.zone')}, '.', '_'), '/', '_'), ':', '_')
               || '.log' AS log_name
        FROM fx_instance i LEFT JOIN fx_deployment d ON d.deploy_id = i.deploy_id""",
    ("fx_instance", "fx_deployment"),
)
def q_host_log_name(spark, sf):
    f = I.fqdn_frame(fixture(spark, sf, "fx_instance"), fixture(spark, sf, "fx_deployment"))
    return f.select("instance_id", S.host_log_name(F.lit("observer"), F.col("fqdn")).alias("log_name"))


@query(
    "vm_key",
    f"""WITH {C.PR_CTE}, {C.DESIRED_CTE},
        k AS (SELECT deploy_id, role || ':' || prefix || ':' || CAST(idx AS VARCHAR) || ':' || name AS vm_key FROM desired)
        SELECT deploy_id, vm_key, split_part(vm_key, ':', 1) AS role, split_part(vm_key, ':', 2) AS prefix,
               CAST(split_part(vm_key, ':', 3) AS INTEGER) AS idx, split_part(vm_key, ':', 4) AS name,
               CAST(regexp_extract(split_part(vm_key, ':', 4), '[^-]*$') AS INTEGER) AS name_idx
        FROM k""",
    ("fx_profile", "fx_deployment", "fx_role_alias"),
)
def q_vm_key(spark, sf):
    k = C.desired(spark, sf).select("deploy_id", "vm_key")
    parts = S.split_vm_key("vm_key")
    return k.select("deploy_id", "vm_key", *[c.alias(n) for n, c in parts.items()],
                    S.name_index(parts["name"]).cast("int").alias("name_idx"))


@query(
    "endpoint_text",
    f"""WITH {RESOLVED_CTE}, {C.PR_CTE}, {C.DESIRED_CTE}, {C.INVENTORY_CTE}
        SELECT v.name,
               {C.host_sql('v.name', 'v.ip', 'v.zone')} || ':' || CAST(coalesce(d.exporter_port, 9100) AS VARCHAR) AS exporter_target,
               CASE WHEN v.role = 'observer' THEN {C.host_sql('v.name', 'v.ip', 'v.zone')} || ':' ||
                    CAST(coalesce(d.agent_port, 8088) AS VARCHAR) END AS agent_target,
               CASE WHEN v.role = 'ocp' THEN 'http://' || v.ip || ':' ||
                    CAST(coalesce(d.management_port, 8080) AS VARCHAR) END AS site_url,
               r.image_spec || ',name=' || v.name || '-boot,type=' || coalesce(r.boot_type, 'network-ssd')
               || ',size=' || CAST(coalesce(r.boot_size_gb, 50) AS VARCHAR) || 'G,auto-delete=true' AS boot_disk_spec
        FROM inv v JOIN resolved r ON v.deploy_id = r.deploy_id AND v.role = r.role
        JOIN fx_deployment d ON d.deploy_id = v.deploy_id""",
    ("fx_profile", "fx_deployment", "fx_role_alias", "fx_instance"),
)
def q_endpoint_text(spark, sf):
    from ..sinks.documents import endpoint_text

    return endpoint_text(C.inventory(spark, sf), resolved(spark, sf), fixture(spark, sf, "fx_deployment"))
