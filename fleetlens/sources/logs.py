"""Text logs into rows: step logs, benchmark result logs and result tables.

SURVEY #7, #8, #90. All parsing is ``regexp_extract`` / ``split`` in the
JVM; input is one row per line with its file keys and line number (as
``spark.read.text`` gives it, plus a line number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import carry_last

# Line formats of the tools that write these logs.
STEP_LINE = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] (INFO|WARN|ERROR): (.*)$"
STEP_MARK = r"^=== (.*) ===$"
RESULT_TX = r"^(\S+) info:\s+(\w+): OK=(\d+) Failed=(\d+) p50=(\d+)ms p90=(\d+)ms p99=(\d+)ms\s*$"
RESULT_FACTS = {
    "warehouses": (r"Scale: (\d+) warehouses", "int"),
    "measured_s": (r"Measured Duration: ([0-9.]+)s", "double"),
    "tpmc": (r"New-Order Throughput: ([0-9.]+) tpmC", "double"),
    "efficiency_pct": (r"Efficiency: ([0-9.]+)%", "double"),
    "total_failed": (r"Total Failed: (\d+)", "bigint"),
}
BOX_BAR = "\u2502"  # the vertical bar of box-drawn tables
FOOTER = r"^([A-Za-z][\w ]*): ([^*]+?)(\*?)\s*$"


def parse_step_log(lines: DataFrame) -> DataFrame:
    """``[time] LEVEL: text`` -> (ts, level, message); other lines keep a NULL level.

    ``=== name ===`` lines mark the start of a step (``step`` holds the name).
    """
    ok = F.col("line").rlike(STEP_LINE)
    return lines.select(
        *[c for c in lines.columns if c != "line"],
        F.when(ok, F.to_timestamp_ntz(F.regexp_extract("line", STEP_LINE, 1), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"),
        F.when(ok, F.regexp_extract("line", STEP_LINE, 2)).alias("level"),
        F.when(ok, F.regexp_extract("line", STEP_LINE, 3)).otherwise(F.col("line")).alias("message"),
        F.when(F.col("line").rlike(STEP_MARK), F.regexp_extract("line", STEP_MARK, 1)).alias("step"),
    )


def lines_in_steps(parsed: DataFrame, key: str = "op_id", chunk_lines: int = 100_000) -> DataFrame:
    """The parsed lines with the step each stands in: ``in_step`` its name, ``step_line`` the number of
    its mark, which tells repeated steps apart (both NULL ahead of the first mark; a mark stands in its own step).

    The last mark is carried along a log in chunks of ``chunk_lines`` line numbers, so one huge log is many tasks.
    """
    mark = F.when(F.col("step").isNotNull(), F.struct("line_no", "step"))
    got = carry_last(parsed, mark, "line_no", F.floor(F.col("line_no") / F.lit(chunk_lines)), (key,), "_mark")
    return got.select(*parsed.columns, F.col("_mark.step").alias("in_step"), F.col("_mark.line_no").alias("step_line"))


def step_times(lines: DataFrame, key: str = "op_id") -> DataFrame:
    """One row a step of a log: lines, errors and warnings, first and last time, and the seconds between."""
    at = lambda level: F.count_if(F.col("level") == level)
    s = lines.groupBy(key, "step_line", F.col("in_step").alias("step")).agg(
        F.count(F.lit(1)).alias("n_lines"), at("ERROR").alias("n_errors"), at("WARN").alias("n_warnings"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return s.withColumn("seconds", F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")))


def parse_result_log(lines: DataFrame, keys=("run_id",)) -> DataFrame:
    """Per-transaction lines of a result log -> (tx_type, ok, failed, p50, p90, p99)."""
    tx = lines.where(F.col("line").rlike(RESULT_TX))
    g = lambda i: F.regexp_extract("line", RESULT_TX, i)
    return tx.select(
        *keys, "line_no",
        g(2).alias("tx_type"),
        g(3).cast("bigint").alias("ok_count"),
        g(4).cast("bigint").alias("failed_count"),
        g(5).cast("int").alias("p50"),
        g(6).cast("int").alias("p90"),
        g(7).cast("int").alias("p99"),
    )


def parse_result_facts(lines: DataFrame, keys=("run_id",)) -> DataFrame:
    """Header lines of a result log -> one row of run facts per run (scale, duration, tpmC, ...)."""
    aggs = []
    for name, (pat, typ) in RESULT_FACTS.items():
        v = F.when(F.col("line").rlike(pat), F.regexp_extract("line", pat, 1)).cast(typ)
        aggs.append(F.max(v).alias(name))
    return lines.groupBy(*keys).agg(*aggs)


def parse_result_table(lines: DataFrame, keys=("run_id",)) -> tuple[DataFrame, DataFrame]:
    """Box-drawn result table -> (rows, footer).

    Rows: border lines dropped, the header dropped, ``is_total`` marks the
    TOTAL row (its percentile cells are empty -> NULL). Footer: ``key:
    value`` lines with a trailing ``*`` read as ``starred``.
    """
    data = lines.where(F.col("line").startswith(BOX_BAR))
    cells = F.split(F.col("line"), BOX_BAR)
    c = lambda i: F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit(""))
    rows = data.select(*keys, "line_no", c(1).alias("tx_type"), c(2).alias("_ok"), c(3).alias("_f"),
                       c(4).alias("_p50"), c(5).alias("_p90"), c(6).alias("_p99"))
    rows = rows.where(F.col("_ok").rlike(r"^\d+$")).select(
        *keys, "line_no", "tx_type",
        F.col("_ok").cast("bigint").alias("ok_count"), F.col("_f").cast("bigint").alias("failed_count"),
        F.col("_p50").cast("int").alias("p50"), F.col("_p90").cast("int").alias("p90"),
        F.col("_p99").cast("int").alias("p99"),
        (F.col("tx_type") == "TOTAL").alias("is_total"),
    )
    foot = lines.where(~F.col("line").startswith(BOX_BAR) & F.col("line").rlike(FOOTER)).select(
        *keys, "line_no",
        F.regexp_extract("line", FOOTER, 1).alias("key"),
        F.regexp_extract("line", FOOTER, 2).alias("value"),
        (F.regexp_extract("line", FOOTER, 3) == "*").alias("starred"),
    )
    return rows, foot
