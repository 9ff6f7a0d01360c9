"""Capacity sizing from a measured base run.

Targets are a table (one row per sizing request). The base is the measured
run they scale from: by default the published run, given as literals (no
join); or a table of runs keyed by ``base_id`` that targets reference,
joined on that key with the runs table broadcast (one row per base run).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bench import TPMC_PER_WAREHOUSE

# The measured base run of the published sizing (2400 warehouses on
# 3 x 16 vCPU / 64 GB, 28039.94 tpmC, 18 partitions, 500 in flight).
BASE_RUN = dict(base_id=1, warehouses=2400, vcpu=48, memory_gb=192, observers=3, tpmc=28039.94,
                partitions=18, inflight=500)
EXPECTED_EFFICIENCY = 0.9
ZONES = 3
PARTITIONS_PER_OBSERVER = 6


def base_frame(spark: SparkSession, **over) -> DataFrame:
    row = {**BASE_RUN, **over}
    return spark.createDataFrame(
        [tuple(row.values())],
        "base_id int, warehouses int, vcpu int, memory_gb int, observers int, tpmc double, partitions int, "
        "inflight int",
    )


def density(runs: DataFrame) -> DataFrame:
    """#76 warehouses per vCPU and per GB of RAM."""
    return runs.withColumn("wh_per_vcpu", F.col("warehouses") / F.col("vcpu")).withColumn(
        "wh_per_gb", F.col("warehouses") / F.col("memory_gb"))


def _with_base(targets: DataFrame, base) -> DataFrame:
    """Targets with the ``base_*`` columns of their base run.

    ``base`` is either one run as a dict (its values become literals: no
    join at all) or a table of runs keyed by ``base_id`` that the targets
    reference (an equi-join; the runs table is tiny and broadcast).
    """
    if isinstance(base, dict):
        return targets.select("*", *[F.lit(v).alias(f"base_{k}") for k, v in base.items() if k != "base_id"])
    b = base.select(*[F.col(c).alias(f"base_{c}") if c != "base_id" else F.col(c) for c in base.columns])
    return targets.join(b, "base_id")


def scale_capacity(targets: DataFrame, base=None) -> DataFrame:
    """#77 linear need: k = target / base warehouses; vCPU and RAM times k; nodes of the target
    shape to cover both, raised to a multiple of the 3 zones."""
    t = _with_base(targets, BASE_RUN if base is None else base)
    k = F.col("warehouses") / F.col("base_warehouses")
    vcpu = F.col("base_vcpu") * k
    ram = F.col("base_memory_gb") * k
    raw = F.greatest(F.ceil(vcpu / F.col("node_cores")), F.ceil(ram / F.col("node_memory_gb")))
    nodes = (F.ceil(raw / F.lit(ZONES)) * ZONES).cast("int")
    return t.select(
        "target_id", "warehouses", "node_cores", "node_memory_gb",
        k.alias("k"), vcpu.alias("vcpu_need"), ram.alias("memory_need_gb"), nodes.alias("nodes"),
        F.col("base_observers"), F.col("base_inflight"),
    )


def tpmc_ceiling(targets: DataFrame) -> DataFrame:
    """#78 maximum = warehouses x 12.86; expected = 90 % of it."""
    mx = F.col("warehouses") * F.lit(TPMC_PER_WAREHOUSE)
    return targets.select("target_id", "warehouses", mx.alias("max_tpmc"),
                          (mx * F.lit(EXPECTED_EFFICIENCY)).alias("expected_tpmc"))


def bench_params(capacity: DataFrame) -> DataFrame:
    """#79 partitions = 6 per observer; in-flight = base in-flight x k, rounded to hundreds."""
    return capacity.select(
        "target_id", "nodes",
        (F.col("nodes") * PARTITIONS_PER_OBSERVER).alias("partitions"),
        F.round(F.col("base_inflight") * F.col("k"), -2).cast("int").alias("inflight"),
    )


def unit_layout(capacity: DataFrame) -> DataFrame:
    """#80 unit count = nodes / 3; data per node relative to the base = k x base units / units."""
    units = (F.col("nodes") / F.lit(ZONES)).cast("int")
    base_units = F.greatest(F.lit(1), (F.col("base_observers") / F.lit(ZONES)).cast("int"))
    return capacity.select("target_id", "nodes", units.alias("unit_num"),
                           (F.col("k") * base_units / units).alias("data_per_node_vs_base"))


def variant_headroom(capacity: DataFrame) -> DataFrame:
    """#82 aggregate vCPU / RAM of the chosen nodes over the linear need, in percent."""
    cpu = F.col("nodes") * F.col("node_cores")
    ram = F.col("nodes") * F.col("node_memory_gb")
    return capacity.select(
        "target_id", cpu.alias("vcpu_total"), ram.alias("memory_total_gb"),
        (cpu / F.col("vcpu_need") * 100 - 100).alias("cpu_headroom_pct"),
        (ram / F.col("memory_need_gb") * 100 - 100).alias("memory_headroom_pct"),
    )


def storage_rules(resolved: DataFrame, tuned: DataFrame, targets: DataFrame,
                  mb_per_warehouse: int = 70) -> DataFrame:
    """#81 one issue row per broken storage rule of each deployment's observers.

    Rules: log disk size >= 3 x memory_limit; data + log disk >= 6 x memory;
    the dataset (``warehouses x 70 MB``, the upper end of 50-70) fits the
    data files of one zone (``datafile_size x observers / 3``). ``targets``
    join the deployment on ``deploy_id``.
    """
    gb = lambda c: F.regexp_extract(F.col(c), r"^(\d+)", 1).cast("int")
    obs = resolved.where(F.col("role") == "observer").select(
        "deploy_id", "memory_gb", "vm_count",
        F.coalesce("data_size_gb", F.lit(0)).alias("data_gb"),
        F.when(F.coalesce("log_enabled", F.lit(False)), F.coalesce("log_size_gb", F.lit(0))).otherwise(0).alias("log_gb"))
    t = tuned.select("deploy_id", gb("memory_limit").alias("mem_limit_gb"), gb("log_disk_size").alias("log_disk_gb"),
                     gb("datafile_size").alias("datafile_gb"))
    j = obs.join(t, "deploy_id").join(targets.select("deploy_id", "warehouses"), "deploy_id")
    need_gb = F.col("warehouses") * F.lit(mb_per_warehouse) / F.lit(1024.0)
    zone_cap = F.col("datafile_gb") * F.greatest(F.lit(1), F.expr("vm_count div 3"))

    def issue(cond, rule, msg):
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), msg.alias("message")))

    rules = F.array(
        issue(F.col("log_disk_gb") < 3 * F.col("mem_limit_gb"), "log_vs_memory",
              F.format_string("log_disk_size %dG < 3 x memory_limit %dG", "log_disk_gb", "mem_limit_gb")),
        issue(F.col("data_gb") + F.col("log_gb") < 6 * F.col("memory_gb"), "disks_vs_memory",
              F.format_string("data %dG + log %dG < 6 x memory %dG", "data_gb", "log_gb", "memory_gb")),
        issue(need_gb > zone_cap, "dataset_fit",
              F.format_string("dataset %d warehouses needs more than %dG per zone", "warehouses",
                              zone_cap.cast("int"))),
    )
    return j.select("deploy_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("i")).select(
        "deploy_id", "i.rule", "i.message")
