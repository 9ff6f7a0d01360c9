"""Benchmark queries on fx_tx and the run report."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..operators import bench as B
from ..operators import ranks as R
from ..plans.benchmark import run_report
from ..session import stored

# Fixture parameters (FIXTURES fx_tx): run start, 5 days warmup, 10 days measured.
START = dt.datetime(2024, 1, 1)
WARMUP = dt.timedelta(days=5)
DURATION = dt.timedelta(days=10)
WINDOW_SQL = "ts >= TIMESTAMP '2024-01-06 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'"
DURATION_S = 864000.0


def _tx(spark, sf):
    return fixture(spark, sf, "fx_tx")


def _runs(spark, sf):
    # one target per run: run r is sized by target r + 1
    return fixture(spark, sf, "fx_target").select((F.col("target_id") - 1).alias("run_id"), "warehouses")


@query("measured_window", f"SELECT * FROM fx_tx WHERE {WINDOW_SQL}", ("fx_tx",))
def q_measured_window(spark, sf):
    return B.measured_window(_tx(spark, sf), START, WARMUP, DURATION)


@query(
    "tx_summary",
    """SELECT run_id, tx_type, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS ok_count,
              CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed_count
       FROM fx_tx GROUP BY run_id, tx_type""",
    ("fx_tx",),
)
def q_tx_summary(spark, sf):
    return B.tx_summary(_tx(spark, sf))


@query(
    "tx_total",
    """SELECT run_id, CASE WHEN grouping(tx_type) = 1 THEN 'TOTAL' ELSE tx_type END AS tx_type,
              CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS ok_count,
              CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed_count
       FROM fx_tx GROUP BY GROUPING SETS ((run_id, tx_type), (run_id))""",
    ("fx_tx",),
)
def q_tx_total(spark, sf):
    return B.tx_summary(_tx(spark, sf), total=True)


@query(
    "tpmc",
    f"""SELECT run_id, CAST(count(*) FILTER (WHERE ok AND tx_type = 'NewOrder') AS BIGINT) AS new_order_ok,
              CAST({DURATION_S} AS DOUBLE) AS elapsed_s,
              count(*) FILTER (WHERE ok AND tx_type = 'NewOrder') * 60.0 / {DURATION_S} AS tpmc
       FROM fx_tx WHERE {WINDOW_SQL} GROUP BY run_id""",
    ("fx_tx",),
)
def q_tpmc(spark, sf):
    return B.tpmc(B.measured_window(_tx(spark, sf), START, WARMUP, DURATION), DURATION)


@query(
    "efficiency",
    f"""WITH t AS (
          SELECT run_id, count(*) FILTER (WHERE ok AND tx_type = 'NewOrder') * 60.0 / {DURATION_S} AS tpmc
          FROM fx_tx WHERE {WINDOW_SQL} GROUP BY run_id)
        SELECT t.run_id, t.tpmc, g.warehouses, t.tpmc / (g.warehouses * 12.86) * 100.0 AS efficiency_pct
        FROM t JOIN fx_target g ON g.target_id - 1 = t.run_id""",
    ("fx_tx", "fx_target"),
)
def q_efficiency(spark, sf):
    w = B.measured_window(_tx(spark, sf), START, WARMUP, DURATION)
    return B.efficiency(B.tpmc(w, DURATION), _runs(spark, sf))


def _pct_sql(expr: str) -> str:
    return f"""SELECT run_id, tx_type,
          CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {expr}) AS INTEGER) AS p50,
          CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY {expr}) AS INTEGER) AS p90,
          CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY {expr}) AS INTEGER) AS p99
       FROM fx_tx GROUP BY run_id, tx_type"""


@query("tx_percentiles", _pct_sql("latency_ms"), ("fx_tx",))
def q_tx_percentiles(spark, sf):
    return B.tx_percentiles(_tx(spark, sf))


@query(
    "tx_percentiles_bucketed",
    _pct_sql("CASE WHEN latency_ms <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(latency_ms))) AS INTEGER) END"),
    ("fx_tx",),
)
def q_tx_percentiles_bucketed(spark, sf):
    return B.tx_percentiles(_tx(spark, sf), bucket="pow2")


@query("tx_percentiles_approx",
       """SELECT run_id, tx_type, true AS p50_within, true AS p90_within, true AS p99_within
          FROM fx_tx GROUP BY run_id, tx_type""", ("fx_tx",))
def q_tx_percentiles_approx(spark, sf):
    """#63 checked on its own data: every approximate value within its rank bound."""
    tx = _tx(spark, sf)
    return B.percentile_bounds(B.tx_percentiles(tx, approx=True), tx)


@query(
    "run_compare",
    """WITH a AS (SELECT run_id, tx_type, count(*) FILTER (WHERE ok) AS ok_count,
                     percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50,
                     percentile_disc(0.99) WITHIN GROUP (ORDER BY latency_ms) AS p99
              FROM fx_tx WHERE run_id IN (0, 1) GROUP BY run_id, tx_type)
       SELECT coalesce(x.tx_type, y.tx_type) AS tx_type, x.ok_count AS ok_a, y.ok_count AS ok_b,
              y.ok_count / x.ok_count AS ok_ratio,
              (y.ok_count / 1.0) / (x.ok_count / 1.0) AS ok_per_core_ratio,
              y.p50 / x.p50 AS p50_ratio, y.p99 / x.p99 AS p99_ratio
       FROM (SELECT * FROM a WHERE run_id = 0) x FULL OUTER JOIN (SELECT * FROM a WHERE run_id = 1) y
         ON x.tx_type = y.tx_type""",
    ("fx_tx",),
)
def q_run_compare(spark, sf):
    return B.compare_runs(_tx(spark, sf), 0, 1)


@query(
    "run_report",
    f"""WITH w AS (SELECT * FROM fx_tx WHERE {WINDOW_SQL}),
        c AS (SELECT run_id, CASE WHEN grouping(tx_type) = 1 THEN 'TOTAL' ELSE tx_type END AS tx_type,
                     CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS ok_count,
                     CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed_count
              FROM w GROUP BY GROUPING SETS ((run_id, tx_type), (run_id))),
        p AS (SELECT run_id, tx_type,
                     CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS INTEGER) AS p50,
                     CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY latency_ms) AS INTEGER) AS p90,
                     CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY latency_ms) AS INTEGER) AS p99
              FROM w GROUP BY run_id, tx_type),
        t AS (SELECT run_id, count(*) FILTER (WHERE ok AND tx_type = 'NewOrder') * 60.0 / {DURATION_S} AS tpmc
              FROM w GROUP BY run_id),
        e AS (SELECT t.run_id, t.tpmc, g.warehouses, t.tpmc / (g.warehouses * 12.86) * 100.0 AS efficiency_pct
              FROM t JOIN fx_target g ON g.target_id - 1 = t.run_id)
       SELECT c.run_id, c.tx_type, c.ok_count, c.failed_count, p.p50, p.p90, p.p99,
              e.warehouses, e.tpmc, e.efficiency_pct
       FROM c LEFT JOIN p ON c.run_id = p.run_id AND c.tx_type = p.tx_type
              LEFT JOIN e ON c.run_id = e.run_id""",
    ("fx_tx", "fx_target"),
)
def q_run_report(spark, sf):
    return run_report(_tx(spark, sf), _runs(spark, sf), START, WARMUP, DURATION)


def _samples(spark, sf):
    """Metric samples with continuous values, once by job and once as one group of all rows."""
    m = fixture(spark, sf, "fx_metric")
    return m.select(F.explode(F.array("job_name", F.lit("ALL"))).alias("job_name"), (F.col("value") * F.lit(1.5)).alias("value"))


@query(
    "sample_percentiles",
    """WITH m AS (SELECT job_name, value * 1.5 AS value FROM fx_metric UNION ALL SELECT 'ALL', value * 1.5 FROM fx_metric)
       SELECT job_name, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90,
              percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99, percentile_disc(0.999) WITHIN GROUP (ORDER BY value) AS p99_9
       FROM m GROUP BY job_name""",
    ("fx_metric",),
)
def q_sample_percentiles(spark, sf):
    """#61 on continuous values, one group holding half of all rows: passes until 1,000 values are left, so the query makes several."""
    return R.rank_select(_samples(spark, sf), "value", (0.5, 0.9, 0.99, 0.999), ["job_name"], at_most=1000)


G = (1 + 0.01) / (1 - 0.01)
SKETCH_SQL = f"""WITH b AS (SELECT run_id, tx_type, latency_ms, CAST(ceil(ln(latency_ms) / {math.log(G)!r}) AS INTEGER) AS b FROM fx_tx),
       c AS (SELECT run_id, tx_type, b, count(*) AS n FROM b GROUP BY run_id, tx_type, b),
       u AS (SELECT *, sum(n) OVER (PARTITION BY run_id, tx_type ORDER BY b) AS upto, sum(n) OVER (PARTITION BY run_id, tx_type) AS total FROM c)"""


@query(
    "tx_percentiles_sketch",
    f"""{SKETCH_SQL},
       q AS (SELECT run_id, tx_type, max(total)::BIGINT AS n, min(b) FILTER (WHERE upto >= total * 0.5) AS b50,
                    min(b) FILTER (WHERE upto >= total * 0.9) AS b90, min(b) FILTER (WHERE upto >= total * 0.99) AS b99
             FROM u GROUP BY run_id, tx_type)
       SELECT run_id, tx_type, n, round(2 * pow({G!r}, b50) / {G + 1!r}, 6) AS p50, round(2 * pow({G!r}, b90) / {G + 1!r}, 6) AS p90,
              round(2 * pow({G!r}, b99) / {G + 1!r}, 6) AS p99, true AS p50_within, true AS p90_within, true AS p99_within
       FROM q""",
    ("fx_tx",),
)
def q_tx_percentiles_sketch(spark, sf):
    """#63 sketches of each day and run, stored; merged over the days; values, and whether each is within 1 % of the exact one."""
    tx = _tx(spark, sf)
    days = stored(R.sketch(tx.withColumn("day", F.to_date("ts")), "latency_ms", ["run_id", "tx_type", "day"]))
    keys = ["run_id", "tx_type"]
    merged = R.merge_sketches(days, keys)
    names = ["p50", "p90", "p99"]
    near = R.sketch_percentiles(merged, keys=keys)
    exact = B.tx_percentiles(tx).select(*keys, *(F.col(n).alias(f"_{n}") for n in names))
    within = [(F.abs(F.col(n) - F.col(f"_{n}")) <= F.col(f"_{n}") * 0.0100001).alias(f"{n}_within") for n in names]
    return merged.select(*keys, "n").join(near, keys).join(exact, keys).select(*keys, "n", *(F.round(n, 6).alias(n) for n in names), *within)
