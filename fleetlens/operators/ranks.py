"""Exact percentiles of very large groups, and sketches that merge.

``rank_select`` finds values by rank without sorting a group: each pass cuts the values between two
bounds in cells of about equal numbers (at quantiles of a mergeable sketch), counts the cells exactly and goes
on inside the one that holds the rank. A group of all rows is sketched and counted by many tasks; what
is gathered in one place are the counts of at most ``CELLS`` cells for each wanted value, and in the end
at most ``AT_MOST`` values.

A sketch counts values in buckets whose bounds grow by a constant factor, so that every value of
a bucket is within ``accuracy`` of its middle. Sketches are a map column that can be stored; the
sketch of the whole is the sum of the sketches of its parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .bench import percentile_names

CELLS = 64
#: Values that may be sorted in one place for each wanted rank.
AT_MOST = 100_000
#: Groups times percentiles up to which the bounds are broadcast (a row of some 600 bytes each).
FEW = 10_000


def rank_select(rows: DataFrame, value: str, percentiles=(0.5, 0.9, 0.99), keys=(), cells: int = CELLS, at_most: int = AT_MOST) -> DataFrame:
    """``keys`` and a column a percentile (p50, ...): the smallest value that ``p`` of a group's values do not exceed.

    Values are worked as doubles; NULL and non-finite ones take no part, and a group without any has no row. The data
    are read once for the number of values and their range, then twice a pass; each pass leaves about one in ``cells`` of
    the values, whatever their distribution (cells end at values that occur, so equal values end at
    once). ``keys`` may be empty.
    """
    keys = list(keys)
    v = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v) AND abs(_v) < double('infinity')")
    if not keys:
        v = v.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    wanted = F.array(*(F.struct(F.lit(i).alias("_p"), F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(float(p)))).cast("bigint").alias("_rank"))
                       for i, p in enumerate(percentiles)))
    bounds = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    bounds = stored(bounds.select(*by, "_n", "_lo", "_hi", F.explode(wanted).alias("_w")).select(*by, "_w.*", "_n", "_lo", "_hi"))

    def inside(some: DataFrame) -> DataFrame:
        """The values between the bounds, beside each wanted rank they may be."""
        some = F.broadcast(some) if some.count() <= FEW else some
        return v.join(some, by).where("_v BETWEEN _lo AND _hi")

    open_ = (F.col("_n") > at_most) & (F.col("_lo") < F.col("_hi"))
    while not bounds.where(open_).isEmpty():
        some = bounds.where(open_)
        cuts = inside(some).groupBy(*by, "_p").agg(F.percentile_approx("_v", [i / cells for i in range(1, cells)], 20 * cells).alias("_cuts"))
        # the values of a cut are a cell of their own, so each pass takes some off
        cell = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        counts = inside(stored(some.join(cuts, [*by, "_p"]))).groupBy(*by, "_p", "_rank", cell.alias("_cell")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        held = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        held = held.withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("_n"))).select(bounds.columns)
        bounds = stored(bounds.where(~open_).unionByName(held))

    one = bounds.where("_lo = _hi").select(*by, "_p", F.col("_lo").alias("_v"))
    rest = inside(bounds.where("_lo < _hi")).withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_v")))
    found = one.unionByName(rest.where("_nth = _rank").select(*by, "_p", "_v"))
    names = percentile_names(percentiles)
    out = found.groupBy(*by).agg(*(F.max(F.when(F.col("_p") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)))
    return out.select(*keys, *names)


# ---------------------------------------------------------------- sketches


def bucket_of(value: Column, accuracy: float) -> Column:
    """Bucket b holds the values in (g**(b-1), g**b], g = (1 + accuracy) / (1 - accuracy); NULL for values of 0 or less."""
    g = (1 + accuracy) / (1 - accuracy)
    return F.when(value > 0, F.ceil(F.ln(value.cast("double")) / F.lit(math.log(g))).cast("int"))


def bucket_middle(bucket: Column, accuracy: float) -> Column:
    """The value that stands for a bucket: within ``accuracy`` of all that are in it."""
    g = (1 + accuracy) / (1 - accuracy)
    return F.coalesce(F.lit(2.0) * F.pow(F.lit(g), bucket) / F.lit(g + 1), F.lit(0.0))


ZERO = -(1 << 31)


def _gathered(counts: DataFrame, keys: list[str]) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(F.col("_b"), F.col("_n"))))  # one a bucket, some thousands at most
    return counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.map_from_entries(entries).alias("sketch"))


def sketch(rows: DataFrame, value: str, keys, accuracy: float = 0.01) -> DataFrame:
    """``keys, n, sketch``: a map from bucket to number of values (those of 0 or less are bucket ``ZERO``); NULL takes no part."""
    keys = list(keys)
    b = F.coalesce(bucket_of(F.col(value), accuracy), F.lit(ZERO))
    return _gathered(rows.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("_b")).agg(F.count(F.lit(1)).alias("_n")), keys)


def merge_sketches(sketches: DataFrame, keys) -> DataFrame:
    """The sketches of each group of ``keys`` added up: what ``sketch`` gives for all their rows."""
    keys = list(keys)
    entries = sketches.select(*keys, F.explode("sketch").alias("_b", "_n"))
    return _gathered(entries.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")), keys)


def sketch_percentiles(sketches: DataFrame, percentiles=(0.5, 0.9, 0.99), keys=(), accuracy: float = 0.01) -> DataFrame:
    """``keys`` and a column a percentile: each within ``accuracy`` of the exact value of that rank."""
    keys = list(keys)
    e = sketches.select(*keys, "n", F.explode("sketch").alias("_b", "_n"))
    e = e.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    at = [F.min(F.when(F.col("_upto") >= F.col("n") * F.lit(float(p)), F.col("_b"))).alias(name) for p, name in zip(percentiles, percentile_names(percentiles))]
    got = e.groupBy(*keys).agg(*at)
    return got.select(*keys, *(bucket_middle(F.nullif(F.col(n), F.lit(ZERO)), accuracy).alias(n) for n in percentile_names(percentiles)))
