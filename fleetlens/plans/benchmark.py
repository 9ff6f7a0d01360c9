"""The benchmark run report: what did each run achieve?

measured window -> per-type counts with a TOTAL row, latency percentiles,
tpmC and efficiency in one table per run and type (the shape of a published
result: counts, p50/p90/p99, throughput, efficiency).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.bench import NEW_ORDER, TOTAL_LABEL, TPMC_PER_WAREHOUSE, _seconds, histogram_percentiles, measured_window, type_histogram


def run_report(tx: DataFrame, runs: DataFrame, start, warmup, duration) -> DataFrame:
    """One row per run and transaction type (plus TOTAL) with run-level throughput.

    The log is scanned once, with the window filter pushed down: values are
    counted per run, type and latency, and everything else is worked from
    those counts (a few rows per run from there on).
    """
    window = measured_window(tx, start, warmup, duration)
    per = histogram_percentiles(type_histogram(window, F.col("latency_ms")), counts=True)
    level = per.groupingSets([["run_id", "tx_type"], ["run_id"]], "run_id", "tx_type").agg(
        F.sum("ok_count").alias("ok_count"), F.sum("failed_count").alias("failed_count"),
        F.sum(F.when(F.col("tx_type") == NEW_ORDER, F.col("ok_count"))).alias("_new"),
        *[F.max(p).alias(f"_{p}") for p in ("p50", "p90", "p99")], F.grouping("tx_type").alias("_g"))
    total = F.col("_g") == 1
    new_order = F.coalesce(F.max("_new").over(Window.partitionBy("run_id")), F.lit(0))
    tpmc = new_order * F.lit(60.0) / F.lit(_seconds(duration))
    rows = level.select("run_id", F.when(total, F.lit(TOTAL_LABEL)).otherwise(F.col("tx_type")).alias("tx_type"), "ok_count", "failed_count",
                        *[F.when(~total, F.col(f"_{p}")).alias(p) for p in ("p50", "p90", "p99")], tpmc.alias("_tpmc"))
    j = rows.join(runs.select("run_id", "warehouses"), "run_id", "left")
    known = F.col("warehouses").isNotNull()
    return j.select("run_id", "tx_type", "ok_count", "failed_count", "p50", "p90", "p99", "warehouses",
                    F.when(known, F.col("_tpmc")).alias("tpmc"),
                    (F.col("_tpmc") / (F.col("warehouses") * F.lit(TPMC_PER_WAREHOUSE)) * F.lit(100.0)).alias("efficiency_pct"))
