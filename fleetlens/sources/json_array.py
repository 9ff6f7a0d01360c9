"""One very large JSON array of objects, read by many tasks.

A listing can be a single line of any length, so Spark can't split it at line ends. It is split
at closing braces instead (Spark's text source with a separator of its own, so each block of the
file is a task's), and what a piece means is found by scans along the file:

1. whether a piece begins inside a string: the parity of the quotes ahead of it;
2. how deep it ends: the brackets outside strings, added up;
3. which element it belongs to: the number of elements that ended ahead of it.

Each scan works inside a block and carries one row per block (``sequence.running_sum``). The
pieces of an element, which may lie in two blocks, are then put together and parsed by Spark.
The files are read and cut once: the pieces with their counts are a written table that the scans read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import running_sum
from ..session import stored
from .listings import element_schema


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _pieces(spark, path: str) -> DataFrame:
    """``file, block, pos, text`` of the pieces between closing braces; ``pos`` grows along a block."""
    t = spark.read.option("lineSep", "}").text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text"))


def array_elements(spark, path: str) -> DataFrame:
    """``source_file, element, doc``: the text of each object of the JSON arrays in a file or folder, numbered along its file.

    The arrays hold objects, nested as they like; white space between them does not matter. Files are
    UTF-8. An empty array has no row."""
    by, block = ["file"], ["block"]
    p = _pieces(spark, path)
    p = p.withColumn("_parts", F.split(F.regexp_replace("text", r"\\.", ""), '"', -1))  # without escaped characters, cut at the quotes
    p = p.withColumn("_quotes", F.size("_parts") - 1)

    def delta(start: int) -> Column:
        """Brackets of a piece that begins outside (0) or inside (1) a string, with the brace that ends it."""
        outside = F.array_join(F.filter("_parts", lambda x, i: i % 2 == start), "")
        closes = F.when((F.col("_quotes") + start) % 2 == 0, 1).otherwise(0)
        return _count(outside, "[{") - _count(outside, "]") - closes

    p = stored(p.withColumn("_d0", delta(0)).withColumn("_d1", delta(1)).drop("_parts"))
    p = running_sum(p, F.col("_quotes"), "pos", block, by, "_ahead")
    p = p.withColumn("_d", F.when(F.col("_ahead") % 2 == 0, F.col("_d0")).otherwise(F.col("_d1")))
    p = running_sum(p, F.col("_d"), "pos", block, by, "_depth")
    brace = (F.col("_ahead") + F.col("_quotes")) % 2 == 0
    p = p.withColumn("_ends", F.when(brace & (F.col("_depth") + F.col("_d") == 1), 1).otherwise(0))
    p = running_sum(p, F.col("_ends"), "pos", block, by, "element")
    whole = p.groupBy("file", "element").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "pos", "text"))), lambda x: x["text"]), "}").alias("_text"),
        F.max("_ends").alias("_ends"))
    doc = F.concat(F.regexp_replace("_text", r"^[\s,\[]+", ""), F.lit("}"))
    return whole.where("_ends = 1").select(F.col("file").alias("source_file"), "element", doc.alias("doc"))


def read_listing_array(spark, path: str, schema: str) -> DataFrame:
    """Listing files of any size, one JSON array a file: the rows of ``listings.read_listing_files``, read in parallel by size."""
    e = array_elements(spark, path).select("source_file", F.from_json("doc", element_schema(schema)).alias("_e"))
    return e.select("source_file", "_e.*")
