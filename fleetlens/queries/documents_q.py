"""Rendered-output queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..operators import inventory as I
from ..session import ensure_checkpoint_dir
from ..sinks import documents as D
from . import common as C
from .profiles_q import RESOLVED_CTE, resolved

PROF = ("fx_profile", "fx_deployment", "fx_role_alias")
INV_FX = PROF + ("fx_instance",)
BASE = f"{RESOLVED_CTE}, {C.PR_CTE}, {C.DESIRED_CTE}, {C.INVENTORY_CTE}"


def flags(spark, sf):
    return I.feature_flags(fixture(spark, sf, "fx_deployment"), C.resolved_raw(spark, sf))


FLAGS_CTE = """pf AS (SELECT deploy_id,
                    bool_or(role = 'monitoring' AND coalesce(raw_enabled, false)) AS mon_vm,
                    bool_or(role = 'ocp' AND coalesce(raw_enabled, false)) AS ocp_vm,
                    max(CASE WHEN role = 'observer' THEN raw_count END) AS obs
             FROM resolved GROUP BY deploy_id),
flags AS (SELECT d.deploy_id,
                 coalesce(d.ocp_enabled, false) AND coalesce(pf.ocp_vm, false) AS management,
                 coalesce(d.prometheus_component, false) OR coalesce(pf.mon_vm, false) AS prometheus,
                 coalesce(d.grafana_component, false) OR coalesce(pf.mon_vm, false) AS grafana,
                 coalesce(d.node_exporter_enabled, true)
                   AND (coalesce(pf.mon_vm, false) OR coalesce(d.prometheus_component, false)) AS node_exporter,
                 coalesce(d.configserver_component, true) AS configserver, coalesce(d.database_component, true) AS database,
                 coalesce(d.proxy_component, true) AS proxy, coalesce(d.agent_component, true) AS agent,
                 coalesce(pf.obs, 3) >= 3 AS production_mode
          FROM fx_deployment d LEFT JOIN pf ON d.deploy_id = pf.deploy_id)"""

HOSTS_CTE = f"""ch AS (
  SELECT deploy_id, CASE role WHEN 'observer' THEN 1 WHEN 'obproxy' THEN 2 WHEN 'configserver' THEN 3 ELSE 4 END
         AS section, idx, role, {C.host_sql('name', 'ip', 'zone')} AS host
  FROM inv WHERE role IN ('observer', 'obproxy', 'configserver', 'monitoring')),
hosts AS (SELECT * FROM ch WHERE NOT (role = 'configserver' AND host IS NULL))"""

# The settings of the documents with their defaults (fixed values, see sinks.documents.CONFIG_DEFAULTS).
CFG_CTE = """cfg0 AS (SELECT *, coalesce(deploy_user, ssh_user, 'obadmin') AS usr FROM fx_deployment),
cfg AS (SELECT deploy_id, usr, coalesce(ssh_port, 22) AS ssh_port, nullif(key_file, '') AS key_file,
               coalesce(mysql_port, 2881) AS mysql_port, 2882 AS rpc_port, 2886 AS obshell_port,
               coalesce(exporter_port, 9100) AS exporter_port, coalesce(agent_port, 8088) AS agent_port,
               coalesce(prometheus_port, 9090) AS prometheus_port, coalesce(management_port, 8080) AS management_port,
               coalesce(home_path, '/home/' || usr || '/observer') AS home_path, coalesce(data_dir, '/data/1') AS data_dir,
               coalesce(redo_dir, '/data/log1') AS redo_dir, coalesce(cluster_name, 'obcluster') AS cluster_name,
               coalesce(agent_user, 'admin') AS agent_user, nullif(management_version, '') AS management_version,
               coalesce(management_memory, '8G') AS management_memory, coalesce(meta_tenant_name, 'ocp_meta') AS meta_tenant_name,
               coalesce(meta_max_cpu, CAST(2 AS DOUBLE)) AS meta_max_cpu
        FROM cfg0)"""


@query(
    "inventory_render",
    f"""WITH {BASE},
        p AS (SELECT deploy_id,
                     max(CASE WHEN role = 'observer' THEN vm_count END) AS obs,
                     max(CASE WHEN role = 'obproxy' THEN vm_count END) AS prx,
                     max(CASE WHEN role = 'configserver' THEN vm_count END) AS cs,
                     max(CASE WHEN role = 'configserver' THEN dedicated END) AS cs_ded,
                     max(CASE WHEN role = 'monitoring' THEN vm_count END) AS mon,
                     bool_or(role = 'monitoring' AND coalesce(enabled, false)) AS mon_on,
                     max(CASE WHEN role = 'ocp' THEN vm_count END) AS ocp,
                     bool_or(role = 'ocp' AND coalesce(enabled, false)) AS ocp_on
              FROM pr GROUP BY deploy_id),
        bad AS (SELECT DISTINCT deploy_id FROM inv WHERE coalesce(ip, '') = ''),
        f AS (SELECT d.deploy_id, p.obs, p.prx, p.cs, p.cs_ded, p.mon, p.mon_on, p.ocp, p.ocp_on, d.deploy_name,
                     d.ssh_user
              FROM fx_deployment d LEFT JOIN p ON d.deploy_id = p.deploy_id
              WHERE d.deploy_id NOT IN (SELECT deploy_id FROM bad)),
        k AS (SELECT *, CASE role WHEN 'observer' THEN 'OBSERVER' WHEN 'obproxy' THEN 'OBPROXY'
                                  WHEN 'configserver' THEN 'CONFIGSERVER' WHEN 'monitoring' THEN 'MONITOR' ELSE 'OCP' END
                        AS key,
                        CASE role WHEN 'observer' THEN 1 WHEN 'obproxy' THEN 2 WHEN 'configserver' THEN 3
                                  WHEN 'monitoring' THEN 4 ELSE 5 END AS section
              FROM inv WHERE deploy_id NOT IN (SELECT deploy_id FROM bad)),
        lines AS (
        SELECT deploy_id, section, idx, 0 AS kind, key || '_' || CAST(idx AS VARCHAR) || '_NAME=' || name AS line FROM k
        UNION ALL SELECT deploy_id, section, idx, 1, key || '_' || CAST(idx AS VARCHAR) || '_IP=' || ip FROM k
        UNION ALL SELECT deploy_id, 9, 0, 0, 'OBSERVER_COUNT=' || coalesce(CAST(obs AS VARCHAR), '') FROM f
        UNION ALL SELECT deploy_id, 9, 0, 1, 'OBPROXY_COUNT=' || coalesce(CAST(prx AS VARCHAR), '0') FROM f
        UNION ALL SELECT deploy_id, 9, 0, 2, 'CONFIGSERVER_COUNT=' ||
                  CASE WHEN coalesce(cs_ded, false) THEN coalesce(CAST(cs AS VARCHAR), '') ELSE '0' END FROM f
        UNION ALL SELECT deploy_id, 9, 0, 3, 'MONITOR_COUNT=' ||
                  CASE WHEN coalesce(mon_on, false) THEN coalesce(CAST(mon AS VARCHAR), '') ELSE '0' END FROM f
        UNION ALL SELECT deploy_id, 9, 0, 4, 'OCP_COUNT=' ||
                  CASE WHEN coalesce(ocp_on, false) THEN coalesce(CAST(ocp AS VARCHAR), '') ELSE '0' END FROM f
        UNION ALL SELECT deploy_id, 9, 0, 5, 'DEPLOY_NAME=' || deploy_name FROM f
        UNION ALL SELECT deploy_id, 9, 0, 6, 'SSH_USER=' || coalesce(ssh_user, '') FROM f
        UNION ALL SELECT deploy_id, 9, 0, 7, 'CONFIGSERVER_DEDICATED=' || coalesce(CAST(cs_ded AS VARCHAR), '') FROM f)
        SELECT deploy_id, section, idx, kind, line, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS reason FROM lines
        UNION ALL
        SELECT deploy_id, NULL, NULL, NULL, NULL, name,
               CASE WHEN coalesce(ip, '') = '' THEN 'no address for VM'
                    ELSE 'withheld: another VM of the deployment has no address' END
        FROM inv WHERE deploy_id IN (SELECT deploy_id FROM bad)""",
    INV_FX,
)
def q_inventory_render(spark, sf):
    """Every VM is in a line or a reject row (``line`` NULL, with the reason)."""
    lines, rejects = D.render_inventory(C.inventory(spark, sf), fixture(spark, sf, "fx_deployment"),
                                        C.profiles_with_role(spark, sf))
    return lines.unionByName(rejects, allowMissingColumns=True).select("deploy_id", "section", "idx", "kind", "line", "name", "reason")


PROFILE_VALUES = ", ".join([
    "platform", "CAST(cores AS VARCHAR)", "CAST(memory_gb AS VARCHAR)", "image_spec", "CAST(core_fraction AS VARCHAR)",
    "coalesce(boot_type, 'network-ssd')", "coalesce(CAST(boot_size_gb AS VARCHAR), '50')",
    "coalesce(CAST(data_enabled AS VARCHAR), 'false')", "coalesce(data_type, 'network-ssd')",
    "coalesce(CAST(data_size_gb AS VARCHAR), '0')", "coalesce(data_mount, '/data')",
    "coalesce(CAST(log_enabled AS VARCHAR), 'false')", "coalesce(log_type, 'network-ssd-io-m3')",
    "coalesce(CAST(log_size_gb AS VARCHAR), '0')", "coalesce(log_mount, '/data/log1')",
])


@query(
    "profile_render",
    f"""WITH {RESOLVED_CTE}
        SELECT deploy_id, role, CAST(unnest(range(0, 15)) AS INTEGER) AS pos, unnest([{PROFILE_VALUES}]) AS value
        FROM resolved""",
    PROF,
)
def q_profile_render(spark, sf):
    return D.render_profile(resolved(spark, sf))


HOST_TEMPLATE = """#cloud-config
hostname: ${name}
users:
  - name: ${ssh_user}
write_files:
  - path: /etc/role-${role}
    content: |
      ${marker}
"""


@query(
    "host_docs",
    f"""WITH {BASE},
        m AS (SELECT v.deploy_id, v.name, v.role, coalesce(d.ssh_user, '') AS usr,
                     ['role=' || v.role, 'deploy_user=' || coalesce(d.ssh_user, ''),
                      'data_disk_enabled=' || CAST(coalesce(r.data_enabled, false) AS VARCHAR),
                      'data_mount=' || coalesce(r.data_mount, '/data'),
                      'log_disk_enabled=' || CAST(coalesce(r.log_enabled, false) AS VARCHAR),
                      'log_mount=' || coalesce(r.log_mount, '/data/log1'),
                      'data_dir=' || coalesce(d.data_dir, ''), 'redo_dir=' || coalesce(d.redo_dir, '')] AS l
              FROM inv v LEFT JOIN resolved r ON v.deploy_id = r.deploy_id AND v.role = r.role
              LEFT JOIN fx_deployment d ON d.deploy_id = v.deploy_id)
        SELECT deploy_id, name, array_to_string(l, chr(10)) AS doc,
               concat_ws(chr(10), '#cloud-config', 'hostname: ' || name, 'users:', '  - name: ' || usr, 'write_files:',
                         '  - path: /etc/role-' || role, '    content: |',
                         '      ' || array_to_string(l, chr(10) || '      '), '') AS document
        FROM m""",
    INV_FX,
)
def q_host_docs(spark, sf):
    return D.render_host_docs(C.inventory(spark, sf), resolved(spark, sf), fixture(spark, sf, "fx_deployment"), HOST_TEMPLATE)


@query(
    "host_logs",
    """SELECT 'observer' AS role, 'dep-' || CAST(op_id % 200 AS VARCHAR) || '-observer-1_ru-central1_internal' AS host_safe,
              row_number() OVER (PARTITION BY op_id % 200 ORDER BY line_no) AS nth, line
       FROM fx_op_line""",
    ("fx_op_line",),
)
def q_host_logs(spark, sf):
    """#13 the logs written by host in parts of some size, then read back from the files, in order."""
    lines = fixture(spark, sf, "fx_op_line").select(
        F.lit("observer").alias("role"),
        F.concat(F.lit("dep-"), (F.col("op_id") % 200).cast("string"), F.lit("-observer-1.ru-central1.internal")).alias("host"),
        "line_no", "line")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/host-logs-{uuid.uuid4().hex}"
    D.write_host_logs(lines, path, part_lines=50000)
    nth = F.row_number().over(Window.partitionBy("role", "host_safe").orderBy("part", "pos"))
    return D.read_host_logs(spark, path).select("role", "host_safe", nth.alias("nth"), "line")


@query(
    "scrape_targets",
    f"""WITH {BASE}, {FLAGS_CTE}, {HOSTS_CTE}, {CFG_CTE},
        f AS (SELECT flags.deploy_id, node_exporter, agent, exporter_port, agent_port
              FROM flags JOIN cfg ON cfg.deploy_id = flags.deploy_id WHERE prometheus)
        SELECT f.deploy_id, 'prometheus' AS job_name, '/metrics' AS metrics_path, 'localhost:9090' AS target,
               0 AS section, 0 AS idx FROM f
        UNION ALL
        SELECT h.deploy_id, 'node_exporter', '/metrics', h.host || ':' || CAST(f.exporter_port AS VARCHAR), h.section, h.idx
        FROM hosts h JOIN f ON h.deploy_id = f.deploy_id WHERE f.node_exporter
        UNION ALL
        SELECT deploy_id, j.job_name, j.metrics_path, host || ':' || CAST(agent_port AS VARCHAR), section, idx
        FROM (SELECT h.*, f.agent_port, unnest([{{'job_name': 'node', 'metrics_path': '/metrics/node/host'}},
                                  {{'job_name': 'ob_basic', 'metrics_path': '/metrics/ob/basic'}},
                                  {{'job_name': 'ob_extra', 'metrics_path': '/metrics/ob/extra'}},
                                  {{'job_name': 'agent', 'metrics_path': '/metrics/stat'}}]) AS j
              FROM hosts h JOIN f ON h.deploy_id = f.deploy_id WHERE h.role = 'observer' AND f.agent)""",
    INV_FX,
)
def q_scrape_targets(spark, sf):
    return D.scrape_targets(C.inventory(spark, sf), flags(spark, sf), fixture(spark, sf, "fx_deployment"))


SERVERS_CTE = f"""{CFG_CTE},
o AS (SELECT deploy_id, idx, name, nullif(ip, '') AS ip, {C.host_sql('name', 'ip', 'zone')} AS host,
             row_number() OVER (PARTITION BY deploy_id ORDER BY idx, name) AS rn,
             count(*) OVER (PARTITION BY deploy_id) AS n
      FROM inv WHERE role = 'observer'),
so AS (SELECT o.deploy_id, o.rn AS server_pos, 'server' || CAST(o.rn AS VARCHAR) AS server_name, o.ip, c.mysql_port,
              c.rpc_port, c.obshell_port, c.home_path, c.data_dir, c.redo_dir,
              'zone' || CAST(((o.rn - 1) % o.n) + 1 AS VARCHAR) AS zone
       FROM o JOIN cfg c ON c.deploy_id = o.deploy_id)"""


@query(
    "server_overrides",
    f"WITH {BASE}, {SERVERS_CTE} SELECT * FROM so",
    INV_FX,
)
def q_server_overrides(spark, sf):
    return D.server_overrides(C.inventory(spark, sf), fixture(spark, sf, "fx_deployment"))


PLACEMENT_CTES = f"""v AS (SELECT deploy_id, role, idx, nullif(ip, '') AS ip FROM inv),
        fs AS (SELECT deploy_id,
                      max(CASE WHEN role = 'observer' AND idx = 1 THEN ip END) AS obs1,
                      max(CASE WHEN role = 'configserver' AND idx = 1 THEN ip END) AS cs1,
                      max(CASE WHEN role = 'monitoring' AND idx = 1 THEN ip END) AS mon1,
                      max(CASE WHEN role = 'ocp' AND idx = 1 THEN ip END) AS ocp1,
                      count(*) FILTER (WHERE role = 'obproxy') AS n_proxy,
                      count(*) FILTER (WHERE role = 'monitoring') AS n_mon,
                      count(*) FILTER (WHERE role = 'ocp') AS n_ocp
               FROM v GROUP BY deploy_id),
        pp AS (SELECT deploy_id, bool_or(role = 'configserver' AND coalesce(dedicated, false)) AS cs_ded,
                      bool_or(role = 'monitoring' AND coalesce(enabled, false)) AS mon_vm
               FROM pr GROUP BY deploy_id),
        g AS (SELECT fs.*, pp.cs_ded, pp.mon_vm, fl.* EXCLUDE (deploy_id),
                     coalesce(pp.mon_vm, false) AND fs.n_mon > 0 AS mon_here
              FROM fs LEFT JOIN pp ON fs.deploy_id = pp.deploy_id LEFT JOIN flags fl ON fs.deploy_id = fl.deploy_id),
placement AS (
        SELECT v.deploy_id, 'oceanbase-ce' AS component, v.idx, v.ip FROM v JOIN g ON g.deploy_id = v.deploy_id
          WHERE v.role = 'observer' AND g.database
        UNION ALL SELECT v.deploy_id, 'obproxy-ce', v.idx, v.ip FROM v JOIN g ON g.deploy_id = v.deploy_id
          WHERE v.role = 'obproxy' AND g.proxy
        UNION ALL SELECT v.deploy_id, 'obagent', v.idx, v.ip FROM v JOIN g ON g.deploy_id = v.deploy_id
          WHERE v.role = 'observer' AND g.agent
        UNION ALL SELECT deploy_id, 'ob-configserver', 1, CASE WHEN coalesce(cs_ded, false) THEN cs1 ELSE obs1 END FROM g
                  WHERE configserver
        UNION ALL SELECT deploy_id, 'obproxy-ce', 1, obs1 FROM g WHERE n_proxy = 0 AND proxy
        UNION ALL SELECT deploy_id, 'prometheus', 1, CASE WHEN mon_here THEN mon1 ELSE obs1 END FROM g
                  WHERE coalesce(prometheus, false)
        UNION ALL SELECT deploy_id, 'grafana', 1, CASE WHEN mon_here OR mon1 IS NOT NULL THEN mon1 ELSE obs1 END FROM g
                  WHERE coalesce(grafana, false)
        UNION ALL SELECT deploy_id, 'ocp-server-ce', 1, CASE WHEN n_ocp > 0 THEN ocp1 END FROM g
                  WHERE coalesce(management, false))"""


REASON_SQL = """CASE WHEN p.component = 'ocp-server-ce' AND g.n_ocp = 0 THEN 'no server for the component'
                     ELSE 'no address for the host' END"""


@query(
    "component_placement",
    f"""WITH {BASE}, {FLAGS_CTE}, {PLACEMENT_CTES}
        SELECT p.*, CASE WHEN p.ip IS NULL THEN {REASON_SQL} END AS reason FROM placement p JOIN g ON g.deploy_id = p.deploy_id""",
    INV_FX,
)
def q_component_placement(spark, sf):
    """Every host of a component is a row with its address or one with the reason that it has none."""
    hosts, rejects = D.component_placement(C.inventory(spark, sf), flags(spark, sf), C.profiles_with_role(spark, sf))
    return hosts.unionByName(rejects, allowMissingColumns=True)


@query(
    "component_closure",
    f"""WITH RECURSIVE {BASE}, {FLAGS_CTE}, {PLACEMENT_CTES},
        comps AS (SELECT DISTINCT deploy_id, component FROM placement),
        e AS (SELECT c.deploy_id, x.component, x.depends_on FROM comps c JOIN fx_component_edge x
                ON x.component = c.component
              WHERE x.depends_on NOT IN ('ob-configserver', 'obagent')
                 OR EXISTS (SELECT 1 FROM comps t WHERE t.deploy_id = c.deploy_id AND t.component = x.depends_on)),
        cl(deploy_id, component, depends_on, depth) AS (
          SELECT deploy_id, component, depends_on, 1 FROM e
          UNION ALL
          SELECT cl.deploy_id, cl.component, e.depends_on, cl.depth + 1 FROM cl JOIN e
            ON cl.deploy_id = e.deploy_id AND cl.depends_on = e.component)
        SELECT deploy_id, component, depends_on, max(depth) AS depth FROM cl
        GROUP BY deploy_id, component, depends_on""",
    INV_FX + ("fx_component_edge",),
)
def q_component_closure(spark, sf):
    """#50 per deployment: the dependency closure of the components it runs. A dependency on the
    config server or the agent holds only where that component is switched on."""
    from ..operators import graph as G

    hosts, rejects = D.component_placement(C.inventory(spark, sf), flags(spark, sf), C.profiles_with_role(spark, sf))
    runs = hosts.select("deploy_id", "component").unionByName(rejects.select("deploy_id", "component"))
    return G.component_closure(runs, fixture(spark, sf, "fx_component_edge"), optional=("ob-configserver", "obagent"))[0]


# A graph of the size of the orders table: nodes in five layers, chains, and rings that are cycles.
EDGES_SQL = """SELECT 'n' || CAST(o_orderkey % 5 AS {text}) || '-' || CAST(o_custkey % 97 AS {text}) AS component,
       CASE WHEN o_orderkey % 5 = 4 THEN 'z' || CAST(o_custkey % 64 AS {text})
            ELSE 'n' || CAST(o_orderkey % 5 + 1 AS {text}) || '-' || CAST(o_orderkey % 89 AS {text}) END AS depends_on
FROM orders
UNION ALL
SELECT 'z' || CAST(c_custkey % 64 AS {text}),
       CASE WHEN c_custkey % 4 < 3 THEN 'z' || CAST(c_custkey % 64 + 1 AS {text})
            WHEN c_custkey % 8 < 4 THEN 'z' || CAST(c_custkey % 64 - 3 AS {text}) END
FROM customer"""


@query(
    "dependency_closure",
    f"""WITH RECURSIVE edges AS (SELECT DISTINCT component, depends_on FROM ({EDGES_SQL.format(text='VARCHAR')}) WHERE depends_on IS NOT NULL),
        reach(a, b) AS (SELECT component, depends_on FROM edges UNION SELECT r.a, e.depends_on FROM reach r JOIN edges e ON r.b = e.component),
        cyclic AS (SELECT e.* FROM edges e WHERE EXISTS (SELECT 1 FROM reach r WHERE r.a = e.depends_on AND r.b = e.component)),
        rest AS (SELECT * FROM edges EXCEPT SELECT * FROM cyclic),
        longest(component, depends_on, depth) AS (
          SELECT component, depends_on, 1 FROM rest
          UNION SELECT l.component, e.depends_on, l.depth + 1 FROM longest l JOIN rest e ON l.depends_on = e.component)
        SELECT component, depends_on, max(depth) AS depth, CAST(NULL AS VARCHAR) AS reason FROM longest GROUP BY component, depends_on
        UNION ALL SELECT component, depends_on, NULL, 'on a cycle of dependencies' FROM cyclic""",
)
def q_dependency_closure(spark, sf):
    """#50 on any edge table: layers, chains and cycles; the edges on a cycle are rejects."""
    from ..operators import graph as G
    from ..session import tables

    base = tables(spark, sf, ("orders", "customer"))
    sql = EDGES_SQL.format(text="STRING").replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}")
    closure, rejects = G.dependency_closure(spark.sql(sql, **base))
    return closure.unionByName(rejects, allowMissingColumns=True)


@query(
    "start_levels",
    f"""WITH RECURSIVE e AS (SELECT component, depends_on FROM fx_component_edge),
        p(component, depth) AS (SELECT depends_on, 0 FROM e UNION SELECT e.component, p.depth + 1 FROM p JOIN e ON e.depends_on = p.component),
        l AS (SELECT component, max(depth) AS level FROM p GROUP BY component),
        {BASE}, {FLAGS_CTE}, {PLACEMENT_CTES}
        SELECT DISTINCT d.deploy_id, l.component, l.level FROM placement d JOIN l ON l.component = d.component
        WHERE d.deploy_id IN (SELECT deploy_id FROM g WHERE configserver AND agent AND database AND proxy
                              AND coalesce(prometheus, false) AND coalesce(grafana, false) AND coalesce(management, false))""",
    INV_FX + ("fx_component_edge",),
)
def q_start_levels(spark, sf):
    """#50 the start order of deployments that run every component."""
    from ..operators import graph as G

    hosts, rejects = D.component_placement(C.inventory(spark, sf), flags(spark, sf), C.profiles_with_role(spark, sf))
    runs = hosts.select("deploy_id", "component").unionByName(rejects.select("deploy_id", "component"))
    full = runs.groupBy("deploy_id").agg(F.count_distinct("component").alias("n")).where("n = 7").select("deploy_id")
    closure, _ = G.component_closure(runs.join(full, "deploy_id", "left_semi"), fixture(spark, sf, "fx_component_edge"))
    return G.start_levels(closure, ["deploy_id"])


def _fields_sql(struct: str) -> str:
    """The fields of a JSON object without its braces."""
    return f"substr(CAST(to_json({struct}) AS VARCHAR), 2, length(CAST(to_json({struct}) AS VARCHAR)) - 2)"


def _json_sql(struct: str) -> str:
    return f"CAST(to_json({struct}) AS VARCHAR)"


def _cluster_docs_sql() -> str:
    from .profiles_q import TUNED_CTE

    j, f = _json_sql, _fields_sql
    home = lambda part: f"'home_path': '/home/' || c.usr || '/{part}'"
    agents = ", ".join(
        f"CASE WHEN g.agent THEN {j(f"{{'job_name': '{n}', 'metrics_path': '{p}', 'basic_auth': {{'username': c.agent_user}}, "
                                    f"'static_configs': [{{'targets': ob.agent_targets}}]}}")} END"
        for n, p in D.AGENT_JOBS)
    ports = "'mysql_port': c.mysql_port, 'rpc_port': c.rpc_port, 'obshell_port': c.obshell_port, 'home_path': c.home_path"
    tuned = ", ".join(f"CASE WHEN coalesce(d.auto_tune, true) THEN t.{k} ELSE d.{k} END AS {k}" for k in (
        "memory_limit", "system_memory", "datafile_size", "log_disk_size", "cpu_count"))
    return f"""WITH {LISTED_BASE}, {FLAGS_CTE}, {PLACEMENT_CTES}, {HOSTS_CTE}, {SERVERS_CTE}, {TUNED_CTE},
        missing AS (SELECT p.deploy_id, p.component, p.idx, {REASON_SQL} AS reason
                    FROM placement p JOIN g ON g.deploy_id = p.deploy_id WHERE p.ip IS NULL),
        tn AS (SELECT d.deploy_id, {tuned} FROM fx_deployment d LEFT JOIN tuned t ON d.deploy_id = t.deploy_id),
        ob AS (SELECT o.deploy_id, list({{'name': 'server' || CAST(o.rn AS VARCHAR), 'ip': o.ip}} ORDER BY o.rn) AS servers,
                      list(o.host || ':' || CAST(c.agent_port AS VARCHAR) ORDER BY o.rn) AS agent_targets,
                      string_agg('"server' || CAST(o.rn AS VARCHAR) || '":' ||
                        {j(f"{{{ports}, 'data_dir': c.data_dir, 'redo_dir': c.redo_dir, 'zone': 'zone' || CAST(o.rn AS VARCHAR)}}")},
                        ',' ORDER BY o.rn) AS overrides
               FROM o JOIN cfg c ON c.deploy_id = o.deploy_id GROUP BY o.deploy_id),
        px AS (SELECT deploy_id, list(ip ORDER BY idx) AS ips FROM v WHERE role = 'obproxy' GROUP BY deploy_id),
        hx AS (SELECT h.deploy_id, list(h.host || ':' || CAST(c.exporter_port AS VARCHAR) ORDER BY h.section, h.idx) AS targets
               FROM hosts h JOIN cfg c ON c.deploy_id = h.deploy_id GROUP BY h.deploy_id)
        SELECT g.deploy_id, '{{' || concat_ws(',',
          '"user":{{' || concat_ws(',', {f("{'username': c.usr, 'port': c.ssh_port, 'timeout': 60}")},
                                   CASE WHEN c.key_file IS NOT NULL THEN {f("{'key_file': c.key_file}")} END) || '}}',
          CASE WHEN g.configserver THEN '"ob-configserver":' || {j(
              f"{{'servers': [CASE WHEN coalesce(g.cs_ded, false) THEN g.cs1 ELSE g.obs1 END], "
              f"'global': {{'listen_port': 8080, {home('ob-configserver')}}}}}")} END,
          CASE WHEN g.database THEN '"oceanbase-ce":{{' || concat_ws(',',
              CASE WHEN g.configserver THEN '"depends":["ob-configserver"]' ELSE '"depends":[]' END,
              {f("{'servers': ob.servers}")},
              '"global":{{' || concat_ws(',', {f(
                  "{'appname': c.cluster_name, 'cluster_id': 1, 'memory_limit': tn.memory_limit, 'system_memory': tn.system_memory, "
                  "'datafile_size': tn.datafile_size, 'log_disk_size': tn.log_disk_size, 'cpu_count': tn.cpu_count, "
                  "'production_mode': g.production_mode, 'enable_syslog_wf': false}")},
                CASE WHEN g.management THEN {f(
                  "{'ocp_meta_tenant': {'tenant_name': c.meta_tenant_name, 'max_cpu': c.meta_max_cpu, 'memory_size': '4G'}, "
                  "'ocp_meta_username': 'root', 'ocp_meta_db': 'meta_database', "
                  "'ocp_monitor_tenant': {'tenant_name': 'ocp_monitor', 'max_cpu': CAST(2 AS DOUBLE), 'memory_size': '4G'}, "
                  "'ocp_monitor_username': 'root', 'ocp_monitor_db': 'monitor_database'}")} END) || '}}',
              ob.overrides) || '}}' END,
          CASE WHEN g.proxy THEN '"obproxy-ce":' || {j(
              f"{{'depends': ['oceanbase-ce'], 'servers': coalesce(px.ips, [g.obs1]), 'global': {{'listen_port': 2883, "
              f"'prometheus_listen_port': 2884, {home('obproxy')}, 'enable_cluster_checkout': false, "
              f"'skip_proxy_sys_private_check': true, 'enable_strict_kernel_release': false}}}}")} END,
          CASE WHEN g.agent THEN '"obagent":' || {j(
              f"{{'depends': ['oceanbase-ce'], 'servers': ob.servers, 'global': {{{home('obagent')}, "
              f"'monagent_http_port': c.agent_port, 'http_basic_auth_user': c.agent_user, 'ob_monitor_status': 'active'}}}}")} END,
          CASE WHEN g.prometheus THEN '"prometheus":{{' || concat_ws(',',
              CASE WHEN g.agent THEN '"depends":["obagent"]' ELSE '"depends":[]' END,
              {f("{'servers': [CASE WHEN g.mon_here THEN g.mon1 ELSE g.obs1 END]}")},
              '"global":{{' || {f(f"{{{home('prometheus')}, 'port': c.prometheus_port}}")} || ',"config":{{' ||
              '"global":{{"scrape_interval":"15s","evaluation_interval":"15s"}},"scrape_configs":[' || concat_ws(',',
                '{{"job_name":"prometheus","metrics_path":"/metrics","static_configs":[{{"targets":["localhost:9090"]}}]}}',
                CASE WHEN g.node_exporter THEN {j(
                  "{'job_name': 'node_exporter', 'metrics_path': '/metrics', 'static_configs': [{'targets': hx.targets}]}")} END,
                {agents}) || ']}}}}') || '}}' END,
          CASE WHEN g.grafana THEN '"grafana":' || {j(
              f"{{'depends': ['prometheus'], 'servers': [CASE WHEN g.mon_here OR g.mon1 IS NOT NULL THEN g.mon1 ELSE g.obs1 END], "
              f"'global': {{{home('grafana')}}}}}")} END,
          CASE WHEN g.management THEN '"ocp-server-ce":{{' || concat_ws(',', {f(
              f"{{'depends': ['oceanbase-ce', 'obproxy-ce'], 'servers': [CASE WHEN g.n_ocp > 0 THEN g.ocp1 END], 'global': {{{home('ocp')}, "
              "'soft_dir': '/home/' || c.usr || '/ocp/software', 'log_dir': '/home/' || c.usr || '/ocp/logs', "
              "'ocp_site_url': 'http://' || CASE WHEN g.n_ocp > 0 THEN g.ocp1 END || ':' || CAST(c.management_port AS VARCHAR), "
              "'port': c.management_port, 'memory_size': c.management_memory}}")},
              CASE WHEN c.management_version IS NOT NULL THEN {f("{'version': c.management_version}")} END) || '}}' END) || '}}' AS doc,
               CAST(NULL AS VARCHAR) AS component, CAST(NULL AS INTEGER) AS idx, CAST(NULL AS VARCHAR) AS reason
        FROM g JOIN cfg c ON c.deploy_id = g.deploy_id LEFT JOIN ob ON ob.deploy_id = g.deploy_id
        LEFT JOIN px ON px.deploy_id = g.deploy_id LEFT JOIN hx ON hx.deploy_id = g.deploy_id
        LEFT JOIN tn ON tn.deploy_id = g.deploy_id
        WHERE g.deploy_id NOT IN (SELECT deploy_id FROM missing)
        UNION ALL SELECT deploy_id, NULL, component, idx, reason FROM missing"""


# Most deployments are through with provisioning: every VM of theirs is listed with an address. The
# others are as the listing has them, which lacks a VM or an address in each.
PROVISIONED = 4
LISTED_BASE = BASE.replace("FROM fx_instance GROUP BY name", f"""FROM (
    SELECT name, instance_id, ip_address, nat_address FROM fx_instance
    UNION ALL SELECT name, 1000000000000 + deploy_id, '10.9.' || CAST(deploy_id % 250 AS VARCHAR) || '.' || CAST(idx AS VARCHAR), NULL
    FROM desired WHERE deploy_id % {PROVISIONED} <> 0) GROUP BY name""")


@query("cluster_docs", _cluster_docs_sql(), INV_FX)
def q_cluster_docs(spark, sf):
    """A document, or a reject row for each missing address; no document holds a null address."""
    from ..plans.cluster_config import cluster_documents

    text = lambda c: F.col(c).cast("string")
    done = C.desired(spark, sf).where(F.col("deploy_id") % PROVISIONED != 0).select(
        "name", (F.lit(1000000000000) + F.col("deploy_id")).alias("instance_id"),
        F.concat(F.lit("10.9."), (F.col("deploy_id") % 250).cast("string"), F.lit("."), text("idx")).alias("ip_address"),
        F.lit(None).cast("string").alias("nat_address"))
    listing = fixture(spark, sf, "fx_instance").select("name", "instance_id", "ip_address", "nat_address").unionByName(done)
    docs, rejects = cluster_documents(fixture(spark, sf, "fx_deployment"), fixture(spark, sf, "fx_profile"),
                                      fixture(spark, sf, "fx_role_alias"), listing)
    return docs.unionByName(rejects, allowMissingColumns=True)
