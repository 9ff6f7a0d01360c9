"""Sizing queries on fx_target."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..operators import profiles as P
from ..operators import sizing as Z
from .profiles_q import RESOLVED_CTE, TUNED_CTE, resolved

CAP_CTE = """cap AS (
  SELECT target_id, warehouses, node_cores, node_memory_gb,
         warehouses / 2400.0 AS k, 48 * (warehouses / 2400.0) AS vcpu_need, 192 * (warehouses / 2400.0) AS memory_need_gb,
         CAST(ceil(greatest(ceil(48 * (warehouses / 2400.0) / node_cores),
                            ceil(192 * (warehouses / 2400.0) / node_memory_gb)) / 3.0) * 3 AS INTEGER) AS nodes
  FROM fx_target)"""


def capacity(spark, sf):
    return Z.scale_capacity(fixture(spark, sf, "fx_target"))


@query(
    "workload_density",
    """SELECT target_id, warehouses, 3 * node_cores AS vcpu, 3 * node_memory_gb AS memory_gb,
              warehouses / (3 * node_cores) AS wh_per_vcpu, warehouses / (3 * node_memory_gb) AS wh_per_gb
       FROM fx_target""",
    ("fx_target",),
)
def q_workload_density(spark, sf):
    # each target read as a run on three nodes of its shape
    t = fixture(spark, sf, "fx_target").select(
        "target_id", "warehouses", (F.col("node_cores") * 3).alias("vcpu"),
        (F.col("node_memory_gb") * 3).alias("memory_gb"))
    return Z.density(t)


@query(
    "scale_capacity",
    f"WITH {CAP_CTE} SELECT target_id, k, vcpu_need, memory_need_gb, nodes FROM cap",
    ("fx_target",),
)
def q_scale_capacity(spark, sf):
    return capacity(spark, sf).select("target_id", "k", "vcpu_need", "memory_need_gb", "nodes")


@query(
    "tpmc_ceiling",
    """SELECT target_id, warehouses, warehouses * CAST(12.86 AS DOUBLE) AS max_tpmc,
              warehouses * CAST(12.86 AS DOUBLE) * CAST(0.9 AS DOUBLE) AS expected_tpmc
       FROM fx_target""",
    ("fx_target",),
)
def q_tpmc_ceiling(spark, sf):
    return Z.tpmc_ceiling(fixture(spark, sf, "fx_target"))


@query(
    "bench_params",
    f"""WITH {CAP_CTE}
        SELECT target_id, nodes, nodes * 6 AS partitions, CAST(round(500 * k, -2) AS INTEGER) AS inflight FROM cap""",
    ("fx_target",),
)
def q_bench_params(spark, sf):
    return Z.bench_params(capacity(spark, sf))


@query(
    "unit_layout",
    f"""WITH {CAP_CTE}
        SELECT target_id, nodes, CAST(nodes / 3 AS INTEGER) AS unit_num, k * 1 / CAST(nodes / 3 AS INTEGER)
               AS data_per_node_vs_base
        FROM cap""",
    ("fx_target",),
)
def q_unit_layout(spark, sf):
    return Z.unit_layout(capacity(spark, sf))


@query(
    "variant_headroom",
    f"""WITH {CAP_CTE}
        SELECT target_id, nodes * node_cores AS vcpu_total, nodes * node_memory_gb AS memory_total_gb,
               nodes * node_cores / vcpu_need * 100 - 100 AS cpu_headroom_pct,
               nodes * node_memory_gb / memory_need_gb * 100 - 100 AS memory_headroom_pct
        FROM cap""",
    ("fx_target",),
)
def q_variant_headroom(spark, sf):
    return Z.variant_headroom(capacity(spark, sf))


@query(
    "storage_rules",
    f"""WITH {RESOLVED_CTE}, {TUNED_CTE},
        o AS (SELECT deploy_id, memory_gb, vm_count, coalesce(data_size_gb, 0) AS data_gb,
                     CASE WHEN coalesce(log_enabled, false) THEN coalesce(log_size_gb, 0) ELSE 0 END AS log_gb
              FROM resolved WHERE role = 'observer'),
        t AS (SELECT deploy_id, CAST(regexp_extract(memory_limit, '^(\\d+)', 1) AS INTEGER) AS mem_limit_gb,
                     CAST(regexp_extract(log_disk_size, '^(\\d+)', 1) AS INTEGER) AS log_disk_gb,
                     CAST(regexp_extract(datafile_size, '^(\\d+)', 1) AS INTEGER) AS datafile_gb FROM tuned),
        j AS (SELECT o.*, t.mem_limit_gb, t.log_disk_gb, t.datafile_gb, g.warehouses,
                     t.datafile_gb * greatest(1, o.vm_count // 3) AS zone_cap
              FROM o JOIN t ON o.deploy_id = t.deploy_id JOIN fx_target g ON g.target_id = o.deploy_id)
        SELECT deploy_id, 'log_vs_memory' AS rule,
               'log_disk_size ' || CAST(log_disk_gb AS VARCHAR) || 'G < 3 x memory_limit ' || CAST(mem_limit_gb AS VARCHAR)
               || 'G' AS message
        FROM j WHERE log_disk_gb < 3 * mem_limit_gb
        UNION ALL
        SELECT deploy_id, 'disks_vs_memory', 'data ' || CAST(data_gb AS VARCHAR) || 'G + log ' || CAST(log_gb AS VARCHAR)
               || 'G < 6 x memory ' || CAST(memory_gb AS VARCHAR) || 'G'
        FROM j WHERE data_gb + log_gb < 6 * memory_gb
        UNION ALL
        SELECT deploy_id, 'dataset_fit', 'dataset ' || CAST(warehouses AS VARCHAR) || ' warehouses needs more than '
               || CAST(zone_cap AS VARCHAR) || 'G per zone'
        FROM j WHERE warehouses * 70 / 1024.0 > zone_cap""",
    ("fx_profile", "fx_deployment", "fx_role_alias", "fx_target"),
)
def q_storage_rules(spark, sf):
    r = resolved(spark, sf)
    targets = fixture(spark, sf, "fx_target").withColumnRenamed("target_id", "deploy_id")
    return Z.storage_rules(r, P.auto_tune(r), targets)
