"""Fixture views (FIXTURES.md section 2).

Each view is one SQL text that runs unchanged on Spark SQL and on DuckDB.
On Spark the base tables are bound as DataFrame parameters of
``spark.sql(text, **frames)``; for DuckDB the same text is placed in a
``WITH`` clause in front of the oracle query, where the base tables are
already registered as views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import read_table, session_key

# The view texts of FIXTURES.md section 2.
FIXTURE_SQL: dict[str, str] = {
    "fx_deployment": """
SELECT c_custkey AS deploy_id,
       'dep-' || CAST(c_custkey AS STRING) AS deploy_name,
       CASE c_nationkey % 4 WHEN 0 THEN 'ru-central1-a' WHEN 1 THEN 'ru-central1-b'
                            WHEN 2 THEN 'ru-central1-d' ELSE 'standalone' END AS zone,
       CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'standard-images' END AS image_folder_id,
       CASE WHEN c_nationkey % 3 = 0 THEN 'os-image-' || CAST(c_nationkey + 30 * (c_nationkey % 2) AS STRING) END AS image_name,
       CASE WHEN c_nationkey % 8 = 2 THEN 'other-lts' WHEN c_nationkey % 2 = 0 THEN 'ubuntu-2404-lts' END AS image_family,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'standard-v3' END AS default_platform,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 100 END AS default_core_fraction,
       CASE WHEN c_custkey % 5 = 0 THEN 6 END AS default_cores,
       CASE WHEN c_custkey % 7 = 0 THEN 24 END AS default_memory_gb,
       'adm' AS ssh_user,
       CASE c_custkey % 10 WHEN 0 THEN 'other' WHEN 1 THEN '' WHEN 2 THEN 'null' ELSE 'adm' END AS deploy_user,
       CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS auto_tune,
       c_custkey % 3 = 0 AS ocp_enabled,
       c_custkey % 7 = 0 AS prometheus_component,
       c_custkey % 26 = 0 AS grafana_component,
       CASE c_custkey % 23 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS configserver_component,
       CASE c_custkey % 29 WHEN 0 THEN false END AS database_component,
       CASE c_custkey % 31 WHEN 0 THEN false END AS proxy_component,
       CASE c_custkey % 22 WHEN 0 THEN false END AS agent_component,
       CASE c_custkey % 20 WHEN 0 THEN false END AS node_exporter_enabled,
       CASE WHEN c_custkey % 11 = 0 THEN 3306 END AS mysql_port,
       CASE WHEN c_custkey % 13 = 0 THEN 9200 END AS exporter_port,
       CASE WHEN c_custkey % 12 = 0 THEN 8188 END AS agent_port,
       CASE WHEN c_custkey % 17 = 0 THEN 9091 END AS prometheus_port,
       CASE WHEN c_custkey % 9 = 0 THEN 8180 END AS management_port,
       CASE WHEN c_custkey % 10 = 3 THEN 2222 END AS ssh_port,
       CASE WHEN c_custkey % 18 = 0 THEN '/keys/' || CAST(c_custkey AS STRING) WHEN c_custkey % 18 = 1 THEN '' END AS key_file,
       CASE WHEN c_custkey % 14 = 0 THEN '/srv/observer' END AS home_path,
       CASE WHEN c_custkey % 15 = 0 THEN '/srv/data' END AS data_dir,
       CASE WHEN c_custkey % 16 = 0 THEN '/srv/redo' END AS redo_dir,
       CASE WHEN c_custkey % 21 = 0 THEN 'cluster-' || CAST(c_custkey AS STRING) END AS cluster_name,
       CASE WHEN c_custkey % 19 = 0 THEN 'metrics' END AS agent_user,
       CASE WHEN c_custkey % 27 = 0 THEN '4.3.1' END AS management_version,
       CASE WHEN c_custkey % 24 = 0 THEN '16G' END AS management_memory,
       CASE WHEN c_custkey % 24 = 0 THEN 'meta_two' END AS meta_tenant_name,
       CASE WHEN c_custkey % 24 = 0 THEN CAST(4.5 AS DOUBLE) END AS meta_max_cpu,
       CASE WHEN c_custkey % 8 = 0 THEN '10G' END AS memory_limit,
       CASE WHEN c_custkey % 8 = 0 THEN '2G' END AS system_memory,
       CASE WHEN c_custkey % 8 = 0 THEN '50G' END AS datafile_size,
       CASE WHEN c_custkey % 8 = 0 THEN '30G' END AS log_disk_size,
       CASE WHEN c_custkey % 8 = 0 THEN 6 END AS cpu_count
FROM {customer}
""",
    "fx_profile": """
SELECT c.c_custkey AS deploy_id,
       CASE WHEN r.k = 1 AND c.c_custkey % 8 = 0 THEN 'observers'
            WHEN r.k = 4 AND c.c_custkey % 8 = 1 THEN 'monitor' ELSE r.role END AS role_in,
       CAST(CASE r.k WHEN 1 THEN CASE WHEN c.c_custkey % 40 = 7 THEN 14 ELSE 1 + c.c_custkey % 6 END WHEN 2 THEN c.c_custkey % 3 ELSE 1 END AS INT) AS vm_count,
       CASE WHEN r.k IN (4, 5) THEN c.c_custkey % 2 = 0 END AS enabled,
       CASE WHEN r.k = 3 THEN c.c_custkey % 5 = 0 END AS dedicated,
       CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE 'standard-v' || CAST(2 + c.c_custkey % 2 AS STRING) END AS platform,
       CAST(CASE WHEN (c.c_custkey + r.k) % 7 = 0 THEN NULL ELSE 2 + 2 * (c.c_custkey % 8) END AS INT) AS cores,
       CAST(CASE WHEN (c.c_custkey + r.k) % 11 = 0 THEN NULL ELSE 4 + 8 * (c.c_custkey % 9) END AS INT) AS memory_gb,
       CASE WHEN r.k = 1 THEN 'network-ssd' ELSE 'network-ssd-io-m3' END AS boot_type,
       CAST(20 + c.c_custkey % 80 AS INT) AS boot_size_gb,
       r.k IN (1, 4, 5) AS data_enabled,
       CASE c.c_custkey % 3 WHEN 0 THEN 'network-ssd' ELSE 'network-ssd-nonreplicated' END AS data_type,
       CAST(CASE WHEN r.k IN (1, 4, 5) THEN 31 + 17 * (c.c_custkey % 60) END AS INT) AS data_size_gb,
       r.k = 1 AND c.c_custkey % 4 <> 3 AS log_enabled,
       CASE c.c_custkey % 5 WHEN 0 THEN 'network-ssd' ELSE 'network-ssd-io-m3' END AS log_type,
       CAST(CASE WHEN r.k = 1 THEN 13 * (c.c_custkey % 40) END AS INT) AS log_size_gb
FROM {customer} c
CROSS JOIN (SELECT 1 AS k, 'observer' AS role UNION ALL SELECT 2, 'obproxy' UNION ALL SELECT 3, 'configserver'
            UNION ALL SELECT 4, 'monitoring' UNION ALL SELECT 5, 'ocp') r
""",
    "fx_role_min": """
SELECT 'observer' AS role, 4 AS min_cores, 16 AS min_memory_gb, 100 AS min_data_disk_gb
UNION ALL SELECT 'obproxy', 2, 4, NULL UNION ALL SELECT 'configserver', 2, 4, NULL
UNION ALL SELECT 'monitoring', 4, 8, NULL UNION ALL SELECT 'ocp', 4, 16, NULL
""",
    "fx_role_alias": """
SELECT 'observers' AS alias, 'observer' AS role UNION ALL SELECT 'obproxy', 'obproxy'
UNION ALL SELECT 'monitoring', 'monitoring' UNION ALL SELECT 'monitor', 'monitoring'
UNION ALL SELECT 'configserver', 'configserver' UNION ALL SELECT 'observer', 'observer' UNION ALL SELECT 'ocp', 'ocp'
""",
    "fx_instance": """
SELECT o_orderkey AS instance_id, o_custkey AS deploy_id,
       'dep-' || CAST(o_custkey AS STRING) || '-observer-' || CAST(1 + o_orderkey % 12 AS STRING) AS name,
       CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'STOPPED' ELSE 'PROVISIONING' END AS status,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'dep-' || CAST(o_custkey AS STRING) END AS label_deployment,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN ''
            ELSE '10.0.' || CAST(o_custkey % 250 AS STRING) || '.' || CAST(o_orderkey % 250 AS STRING) END AS ip_address,
       CASE WHEN o_orderkey % 4 = 0 THEN '84.0.0.' || CAST(o_orderkey % 250 AS STRING) END AS nat_address,
       o_orderdate AS snapshot_ts
FROM {orders}
""",
    "fx_disk": """
SELECT l_orderkey * 10 + l_linenumber AS disk_id,
       'dep-' || CAST(l_suppkey AS STRING) || '-observer-' || CAST(1 + l_partkey % 12 AS STRING) ||
       CASE l_linenumber % 2 WHEN 0 THEN '-data' ELSE '-log' END AS name,
       CASE l_returnflag WHEN 'N' THEN 'network-ssd-nonreplicated' WHEN 'R' THEN 'network-ssd-io-m3'
                         ELSE 'network-ssd' END AS type,
       CAST(20 * l_quantity AS INT) AS size_gb,
       CASE WHEN l_linestatus = 'O' THEN 'READY' WHEN l_suppkey % 2 = 0 THEN 'CREATING' ELSE 'DELETING' END AS status,
       CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_partkey % 50 = 0 THEN -1 - l_orderkey ELSE l_orderkey END AS attached_instance_id,
       'dep-' || CAST(l_suppkey AS STRING) AS label_deployment
FROM {lineitem}
""",
    "fx_image": """
SELECT 'os-image-' || CAST(n_nationkey AS STRING) AS name,
       CASE WHEN n_nationkey % 4 = 0 THEN 'ubuntu-2404-lts' END AS family,
       CASE WHEN n_nationkey % 6 = 1 THEN 'ubuntu-2204-lts' END AS family_id
FROM {nation}
""",
    "fx_kv_line": """
SELECT user_id AS file_id, event_id AS line_no,
       CASE event_type
         WHEN 'click' THEN 'OBSERVER_' || CAST(1 + event_id % 3 AS STRING) || '_IP=10.0.0.' || CAST(event_id % 250 AS STRING)
         WHEN 'view' THEN 'OBSERVER_' || CAST(1 + event_id % 3 AS STRING) || '_NAME=dep-observer-' || CAST(1 + event_id % 3 AS STRING)
         WHEN 'signup' THEN 'OBSERVER_COUNT = ' || CAST(event_id % 4 AS STRING)
         WHEN 'purchase' THEN 'OPTS=a=b=' || CAST(event_id % 10 AS STRING)
         ELSE '# a line with no separator' END AS line
FROM {events}
""",
    "fx_tx": """
SELECT event_id AS tx_id, user_id % 3 AS run_id, ts,
       CASE event_type WHEN 'click' THEN 'NewOrder' WHEN 'purchase' THEN 'Payment' WHEN 'view' THEN 'OrderStatus'
                       WHEN 'signup' THEN 'Delivery' ELSE 'StockLevel' END AS tx_type,
       CAST(1 + floor(value * 20) AS INT) AS latency_ms,
       event_id % 97 <> 0 AS ok
FROM {events}
""",
    "fx_result_line": """
SELECT event_id AS line_no, user_id AS run_id,
       '2026-07-21T10:17:34.248 info:   ' ||
       CASE event_type WHEN 'click' THEN 'NewOrder' WHEN 'purchase' THEN 'Payment' WHEN 'view' THEN 'OrderStatus'
                       WHEN 'signup' THEN 'Delivery' ELSE '=== TPC-C Results ===' END ||
       CASE WHEN event_type = 'error' THEN '' ELSE
       ': OK=' || CAST(event_id * 3 AS STRING) || ' Failed=' || CAST(event_id % 5 AS STRING) ||
       ' p50=' || CAST(100 + event_id % 900 AS STRING) || 'ms p90=' || CAST(1000 + event_id % 900 AS STRING) ||
       'ms p99=' || CAST(2000 + event_id % 900 AS STRING) || 'ms' END AS line
FROM {events}
""",
    "fx_probe": """
SELECT user_id % 8 AS backend_id, event_id AS probe_no, ts, value < 40 AS ok FROM {events}
""",
    "fx_status": """
SELECT user_id AS resource_id, user_id % 10 AS deploy_id, event_id AS seq, ts,
       CASE event_type WHEN 'click' THEN 'CREATING' WHEN 'view' THEN 'READY' WHEN 'purchase' THEN 'RUNNING'
                       WHEN 'signup' THEN 'STOPPED' ELSE 'DELETING' END AS status
FROM {events}
""",
    "fx_conn": """
SELECT event_id AS conn_id, ts, '10.1.' || CAST(user_id % 7 AS STRING) || '.' || CAST(user_id AS STRING) AS client_ip,
       CAST(1 + floor(value) AS INT) AS duration_s
FROM {events}
""",
    "fx_op_line": """
SELECT user_id AS op_id, event_id AS line_no, ts,
       CASE event_type WHEN 'error' THEN
              CASE WHEN event_id % 2 = 0 THEN 'The limit on maximum number of active operations has exceeded'
                   ELSE 'ERROR: quota' END
            WHEN 'signup' THEN 'ERROR: The limit on maximum number of active operations has exceeded'
            ELSE 'done (' || CAST(event_id AS STRING) || ')' END AS line
FROM {events}
""",
    "fx_metric": """
SELECT user_id AS target_id, event_type AS job_name, ts, value FROM {events}
""",
    "fx_component_edge": """
SELECT 'oceanbase-ce' AS component, 'ob-configserver' AS depends_on UNION ALL SELECT 'obproxy-ce', 'oceanbase-ce'
UNION ALL SELECT 'obagent', 'oceanbase-ce' UNION ALL SELECT 'prometheus', 'obagent' UNION ALL SELECT 'grafana', 'prometheus'
UNION ALL SELECT 'ocp-server-ce', 'oceanbase-ce' UNION ALL SELECT 'ocp-server-ce', 'obproxy-ce'
""",
    "fx_target": """
SELECT p_partkey AS target_id, CAST(100 + 50 * (p_partkey % 600) AS INT) AS warehouses,
       CASE p_size % 2 WHEN 0 THEN 16 ELSE 32 END AS node_cores,
       CASE p_size % 2 WHEN 0 THEN 64 ELSE 128 END AS node_memory_gb
FROM {part}
""",
}

# Spark-side form of fx_profile: the five roles are generated per customer row
# (``inline`` of a literal array) instead of a cross join with a constant
# table; the rows are the same (the oracle checks it).
SPARK_FIXTURE_SQL: dict[str, str] = {
    "fx_profile": FIXTURE_SQL["fx_profile"].replace(
        """CROSS JOIN (SELECT 1 AS k, 'observer' AS role UNION ALL SELECT 2, 'obproxy' UNION ALL SELECT 3, 'configserver'
            UNION ALL SELECT 4, 'monitoring' UNION ALL SELECT 5, 'ocp') r""",
        """LATERAL VIEW inline(array(struct(1 AS k, 'observer' AS role), struct(2 AS k, 'obproxy' AS role),
                                 struct(3 AS k, 'configserver' AS role), struct(4 AS k, 'monitoring' AS role),
                                 struct(5 AS k, 'ocp' AS role))) r AS k, role""",
    ),
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def base_tables_of(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(FIXTURE_SQL[name])))


_VIEWS: dict[tuple, DataFrame] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame over the parquet tables of ``sf_dir`` (built once per
    session; the same immutable frame serves every query)."""
    key = (*session_key(spark), sf_dir.rstrip("/"), name)
    df = _VIEWS.get(key)
    if df is None:
        frames = {t: read_table(spark, sf_dir, t) for t in base_tables_of(name)}
        df = _VIEWS[key] = spark.sql(SPARK_FIXTURE_SQL.get(name, FIXTURE_SQL[name]), **frames)
    return df


def duckdb_text(name: str) -> str:
    """The view text with plain table names, for DuckDB."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), FIXTURE_SQL[name])


def with_fixtures(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix an oracle query with the fixture views it uses as CTEs."""
    ctes = ",\n".join(f"{n} AS ({duckdb_text(n).strip()})" for n in names)
    sql = sql.strip()
    m = re.match(r"(?is)^with\s+(recursive\s+)?", sql)
    if m:
        # the oracle query has its own CTEs: join the two lists
        recursive = recursive or bool(m.group(1))
        head = "WITH RECURSIVE " if recursive else "WITH "
        return f"{head}{ctes},\n{sql[m.end():]}"
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}\n{sql}"
