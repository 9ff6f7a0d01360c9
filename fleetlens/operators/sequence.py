"""Exact running positions over ordered data without one task per group.

``row_number()`` over a window needs every row of a partition key in one
task; when one key holds a large share of all rows (one busy front end, one
noisy backend) that task becomes the job. The helpers here split each key
into chunks of a column that grows with the order (a time bucket, a probe
number block), compute positions inside each chunk, and carry the chunk
offsets across with a window over the chunk summaries - one row per chunk,
so small. Results are exact and equal to the single-window form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def ordered_index(df: DataFrame, order: list[str], chunk: Column, by: tuple[str, ...] = (),
                  out: str = "seq", total: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row within ``by`` in ``order``.

    ``chunk`` must not decrease along ``order`` (e.g. ``floor(ts / 1 hour)``
    when ordering by ``ts``). Rows are numbered inside ``(by, chunk)``; the
    counts per chunk are summed cumulatively per ``by`` and joined back.
    ``total`` names an optional column with the number of rows of the ``by``
    group, taken from the same chunk summary.
    """
    by = list(by)
    d = df.withColumn("_chunk", chunk)
    local = d.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(*order)))
    counts = d.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*by)))
    offsets = offsets.drop("_n")
    return local.join(offsets, [*by, "_chunk"]).withColumn(out, F.col("_off") + F.col("_local")).drop(
        "_chunk", "_local", "_off")


def carry_last(df: DataFrame, value: Column, order: str, chunk: Column, by: tuple[str, ...] = (), out: str = "last") -> DataFrame:
    """Add ``out`` = the last ``value`` that is not NULL at or before each row of ``by`` in ``order`` (unique).

    The rule is associative, so it is worked inside ``(by, chunk)`` and the last value of each
    chunk is carried over one row per chunk; ``chunk`` must not decrease along ``order``.
    """
    by = list(by)
    d = df.withColumn("_chunk", chunk).withColumn("_value", value)
    here = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_local", F.last("_value", ignorenulls=True).over(here))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(*by, "_chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    carried = ends.select(*by, "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return local.join(carried, [*by, "_chunk"]).withColumn(out, F.coalesce("_local", "_carried")).drop("_chunk", "_value", "_local", "_carried")


def running_sum(df: DataFrame, value: Column, order: str, chunk: list[str], by: list[str], out: str) -> DataFrame:
    """Add ``out`` = the sum of ``value`` over the rows of ``by`` ahead of each row; ``chunk`` are columns that
    order the chunks of ``by``, ``order`` the rows of a chunk. The chunks' sums are written, so that a sum
    over the result does not work out this one twice."""
    d = df.withColumn("_value", value)
    here = Window.partitionBy(*by, *chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.coalesce(F.sum("_value").over(here), F.lit(0)))
    before = Window.partitionBy(*by).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*by, *chunk).agg(F.sum("_value").alias("_sum"))
    carried = stored(sums.select(*by, *chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried")))
    return local.join(carried, [*by, *chunk]).withColumn(out, F.col("_local") + F.col("_carried")).drop("_value", "_local", "_carried")
