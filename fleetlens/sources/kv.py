"""``KEY=value`` files read as a long table.

Input: one row per line, ``(<file keys>, line_no, line)``; e.g. from
``spark.read.text(paths).withColumn("file", F.input_file_name())`` plus a
line number. The reduction to one value per (file, key) is a grouped
``max_by`` / ``min_by``, so it is partially aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_ws


def parse_kv(lines: DataFrame, keep: str = "last", key_cols=("file_id",), defaults: dict[str, str | None] | None = None):
    """Parse ``KEY=value`` lines.

    ``keep='last'`` (inventory files): lines without ``=`` are ignored, the
    line is split at the first ``=``, whitespace is stripped from both sides, the last line
    of a key wins.

    ``keep='first'`` (marker files): carriage returns are removed, a line
    counts for ``key`` only when it starts with ``key=`` (no trimming), the
    first such line wins, and a wanted key that no line gives takes its
    default. ``defaults`` lists the wanted keys; a file that has no lines at
    all gives no rows (not the defaults).
    """
    keys = list(key_cols)
    if keep == "last":
        kv = lines.where(F.col("line").contains("=")).select(
            *keys, "line_no",
            strip_ws(F.substring_index("line", "=", 1)).alias("key"),
            strip_ws(F.expr("substr(line, instr(line, '=') + 1)")).alias("value"),
        )
        return kv.groupBy(*keys, "key").agg(F.max_by("value", "line_no").alias("value"))
    if keep != "first":
        raise ValueError("keep must be 'last' or 'first'")
    if not defaults:
        raise ValueError("keep='first' needs the wanted keys with their defaults")
    clean = lines.select(*keys, "line_no", F.regexp_replace("line", "\r", "").alias("line"))
    kv = clean.where(F.col("line").contains("=")).select(
        *keys, "line_no",
        F.substring_index("line", "=", 1).alias("key"),
        F.expr("substr(line, instr(line, '=') + 1)").alias("value"),
    ).where(F.col("key").isin(*defaults))
    found = kv.groupBy(*keys, "key").agg(F.min_by("value", "line_no").alias("value"))
    wanted = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("dflt"))
                       for k, v in defaults.items()])
    files = lines.select(*keys).distinct().select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.*")
    return files.join(found, [*keys, "key"], "left").select(
        *keys, "key", F.coalesce(F.col("value"), F.col("dflt")).alias("value"))
