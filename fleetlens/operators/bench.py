"""Benchmark transaction-log analytics.

Input is a transaction log: one row per transaction with
``run_id, ts, tx_type, latency_ms, ok``. Every operator is a grouped
aggregation keyed by run (and type), so partial aggregation runs map-side
and only one small row per key and task is shuffled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# TPC-C constants used by the published results.
NEW_ORDER = "NewOrder"
TPMC_PER_WAREHOUSE = 12.86  # maximum tpmC one warehouse can give
TOTAL_LABEL = "TOTAL"


def _seconds(value) -> float:
    if isinstance(value, dt.timedelta):
        return value.total_seconds()
    return float(value)


def measured_window(tx: DataFrame, start, warmup, duration, ts_col: str = "ts") -> DataFrame:
    """Keep the measured part of each run: ``[start + warmup, start + warmup + duration)``.

    ``start`` is a timestamp (``datetime`` or ISO text) or a Column such as a
    per-run start joined in; ``warmup`` / ``duration`` are seconds or
    timedeltas. With a fixed start the bounds are folded to literals of the
    column's own type, so the range filter reaches the parquet scan.
    """
    w, d = _seconds(warmup), _seconds(duration)
    if isinstance(start, Column):
        lo = start + F.make_dt_interval(secs=F.lit(w))
        hi = lo + F.make_dt_interval(secs=F.lit(d))
    else:
        t0 = start if isinstance(start, dt.datetime) else dt.datetime.fromisoformat(str(start))
        typ = tx.schema[ts_col].dataType.simpleString()
        lo_v = t0 + dt.timedelta(seconds=w)
        hi_v = lo_v + dt.timedelta(seconds=d)
        lo = F.lit(lo_v.isoformat(sep=" ")).cast(typ)
        hi = F.lit(hi_v.isoformat(sep=" ")).cast(typ)
    return tx.where((F.col(ts_col) >= lo) & (F.col(ts_col) < hi))


def measured_runs(tx: DataFrame, runs: DataFrame, warmup, duration, key: str = "run_id", start: str = "start_ts") -> DataFrame:
    """#88 with a start of its own for each run: the table of runs is joined ahead of the filter.

    ``runs``: one row a run (``key``, ``start``), static; transactions of other runs are dropped. The join is
    an equi-join on the run (Spark broadcasts the runs when they are small), so ``tx`` can be a
    stream: each of its rows is judged alone, without state.
    """
    r = runs.select(F.col(key).alias("_run"), F.col(start).alias("_start"))
    met = tx.join(r, tx[key] == r["_run"])
    return measured_window(met, F.col("_start"), warmup, duration).drop("_run", "_start")


def tx_summary(tx: DataFrame, total: bool = False, keys=("run_id",)) -> DataFrame:
    """OK / failed counts per run and transaction type; ``total`` adds a TOTAL row per run."""
    keys = list(keys)
    aggs = [
        F.count_if(F.col("ok")).cast("bigint").alias("ok_count"),
        F.count_if(~F.col("ok")).cast("bigint").alias("failed_count"),
    ]
    if not total:
        return tx.groupBy(*keys, "tx_type").agg(*aggs)
    # GROUPING SETS ((keys, tx_type), (keys)) in one pass over the data
    gs = tx.groupingSets([[*keys, "tx_type"], keys], *keys, "tx_type").agg(
        *aggs, F.grouping("tx_type").alias("_g")
    )
    return gs.select(
        *keys,
        F.when(F.col("_g") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("tx_type")).alias("tx_type"),
        "ok_count",
        "failed_count",
    )


def tpmc(tx: DataFrame, duration, keys=("run_id",)) -> DataFrame:
    """New-order commits per minute over the measured window, per run.

    ``tx`` should already be restricted with :func:`measured_window`;
    ``duration`` is the measured length in seconds.
    """
    secs = _seconds(duration)
    return tx.groupBy(*keys).agg(
        F.count_if(F.col("ok") & (F.col("tx_type") == NEW_ORDER)).cast("bigint").alias("new_order_ok"),
    ).select(
        *keys,
        "new_order_ok",
        F.lit(secs).cast("double").alias("elapsed_s"),
        (F.col("new_order_ok") * F.lit(60.0) / F.lit(secs)).alias("tpmc"),
    )


def efficiency(tpmc_df: DataFrame, runs: DataFrame, keys=("run_id",)) -> DataFrame:
    """tpmC as a percentage of the maximum ``warehouses * 12.86``.

    ``runs`` holds ``warehouses`` per run; it has one row per run, so the
    join is a small equi-join on the run key.
    """
    return tpmc_df.join(runs.select(*keys, "warehouses"), list(keys)).select(
        *keys,
        "tpmc",
        "warehouses",
        (F.col("tpmc") / (F.col("warehouses") * F.lit(TPMC_PER_WAREHOUSE)) * F.lit(100.0)).alias("efficiency_pct"),
    )


def pow2_bucket(col: Column) -> Column:
    """Upper bound of the power-of-two histogram bucket holding ``col`` (1 for values <= 1)."""
    return F.when(col <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(col.cast("double"))))).cast("int")


def percentile_names(percentiles) -> list[str]:
    return ["p" + format(p * 100, "g").replace(".", "_") for p in percentiles]  # p50, p90, p99, p99_9


def type_histogram(tx: DataFrame, value: Column, keys=("run_id",)) -> DataFrame:
    """``keys, tx_type, _v, _n, ok_count, failed_count``: one row per distinct value, from partial counts."""
    return tx.groupBy(*keys, "tx_type", value.alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("ok")).alias("ok_count"), F.count_if(~F.col("ok")).alias("failed_count"))


def histogram_percentiles(hist: DataFrame, percentiles=(0.5, 0.9, 0.99), keys=("run_id",), counts: bool = False) -> DataFrame:
    """Exact discrete percentiles of a histogram: the smallest value that ``p`` of a group's values
    do not exceed. Values are counted before they meet, so a group's task sorts its distinct
    values (and spills), however many transactions it has. NULL values don't take part."""
    group = Window.partitionBy(*keys, "tx_type")
    n = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    h = hist.withColumn("_upto", F.sum(n).over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("_total", F.sum(n).over(group))
    at = [F.min(F.when(F.col("_upto") >= F.col("_total") * F.lit(p), F.col("_v"))).cast("int").alias(name)
          for p, name in zip(percentiles, percentile_names(percentiles))]
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("ok_count", "failed_count")] if counts else []
    return h.groupBy(*keys, "tx_type").agg(*sums, *at)


def tx_percentiles(
    tx: DataFrame,
    percentiles=(0.5, 0.9, 0.99),
    bucket: str | None = None,
    approx: bool = False,
    accuracy: int = 10000,
    keys=("run_id",),
) -> DataFrame:
    """Latency percentiles per run and type.

    Exact form: values are counted first (:func:`type_histogram`), then ranked.
    ``approx=True`` uses ``percentile_approx``, whose sketch is merged across
    partitions, for logs with very many distinct values. ``bucket='pow2'``
    first maps each latency to its power-of-two bucket bound.
    """
    lat = F.col("latency_ms")
    if bucket == "pow2":
        lat = pow2_bucket(lat)
    if approx:
        arr = F.percentile_approx(lat, list(percentiles), accuracy)
        out = tx.groupBy(*keys, "tx_type").agg(arr.alias("_p"))
        names = percentile_names(percentiles)
        return out.select(*keys, "tx_type", *[F.col("_p")[i].cast("int").alias(n) for i, n in enumerate(names)])
    return histogram_percentiles(type_histogram(tx, lat, keys), percentiles, keys)


def percentile_bounds(approx: DataFrame, tx: DataFrame, percentiles=(0.5, 0.9, 0.99), accuracy: int = 10000,
                      keys=("run_id",)) -> DataFrame:
    """Whether each approximate percentile lies within its rank bound of the exact counts:
    ``1 / accuracy`` of the group's values, and one value for the rounding of a rank."""
    h = type_histogram(tx, F.col("latency_ms"), keys).join(approx, [*keys, "tx_type"])
    names = percentile_names(percentiles)
    sums = h.groupBy(*keys, "tx_type").agg(
        F.sum("_n").alias("_total"),
        *[F.sum(F.when(F.col("_v") < F.col(n), F.col("_n")).otherwise(0)).alias(f"_below_{n}") for n in names],
        *[F.sum(F.when(F.col("_v") <= F.col(n), F.col("_n")).otherwise(0)).alias(f"_upto_{n}") for n in names])
    ok = lambda p, n: ((F.col(f"_upto_{n}") >= (p - 1 / accuracy) * F.col("_total") - 1)
                       & (F.col(f"_below_{n}") <= (p + 1 / accuracy) * F.col("_total") + 1)).alias(f"{n}_within")
    return sums.select(*keys, "tx_type", *[ok(p, n) for p, n in zip(percentiles, names)])


def compare_runs(tx: DataFrame, run_a, run_b, cores_a: float = 1.0, cores_b: float = 1.0) -> DataFrame:
    """Two runs side by side per transaction type: counts, p50/p99 and ratios.

    Both sides are aggregates with one row per type, so the final join is
    tiny whatever the log size.
    """
    hist = type_histogram(tx.where(F.col("run_id").isin(run_a, run_b)), F.col("latency_ms"))
    agg = histogram_percentiles(hist, (0.5, 0.99), counts=True)
    of = lambda run, c: F.max(F.when(F.col("run_id") == F.lit(run), F.col(c)))
    both = agg.groupBy("tx_type").agg(*[of(run, c).alias(f"{name}_{side}") for side, run in (("a", run_a), ("b", run_b))
                                        for c, name in (("ok_count", "ok"), ("p50", "p50"), ("p99", "p99"))])
    return both.select(
        "tx_type",
        "ok_a",
        "ok_b",
        (F.col("ok_b") / F.col("ok_a")).alias("ok_ratio"),
        (F.col("ok_b") / F.lit(float(cores_b)) / (F.col("ok_a") / F.lit(float(cores_a)))).alias("ok_per_core_ratio"),
        (F.col("p50_b") / F.col("p50_a")).alias("p50_ratio"),
        (F.col("p99_b") / F.col("p99_a")).alias("p99_ratio"),
    )
