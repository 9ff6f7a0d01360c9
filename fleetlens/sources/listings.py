"""Cloud listings: JSON arrays of resources read into rows.

A listing document is text (a file per poll, or a column of a table). It is
decoded with ``from_json`` against a narrow schema - only the fields the
operators read, which is the JSON form of column pruning - and flattened
with ``inline``. Parsing runs in the JVM; no Python touches the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pick_ip

INSTANCE_SCHEMA = (
    "array<struct<id:string,name:string,status:string,labels:map<string,string>,"
    "network_interfaces:array<struct<primary_v4_address:struct<address:string,"
    "one_to_one_nat:struct<address:string>>>>>>"
)
DISK_SCHEMA = (
    "array<struct<id:string,name:string,status:string,labels:map<string,string>,"
    "instance_ids:array<string>>>"
)
IMAGE_SCHEMA = "array<struct<name:string,family:string,family_id:string>>"


def read_listing(docs: DataFrame, schema: str, text_col: str = "doc", keep=()) -> DataFrame:
    """One row per element of the JSON array in ``text_col`` (plus the ``keep`` columns)."""
    return docs.select(*keep, F.inline_outer(F.from_json(F.col(text_col), schema)))


def instance_rows(docs: DataFrame, text_col: str = "doc", keep=()) -> DataFrame:
    """Instances with status, deployment label and the picked address."""
    return listed_instances(read_listing(docs, INSTANCE_SCHEMA, text_col, keep), keep)


def listed_instances(rows: DataFrame, keep=()) -> DataFrame:
    """The same of listed resources that were read in another way (JSON lines, large arrays)."""
    return rows.where(F.col("name").isNotNull()).select(
        *keep, F.col("id").alias("instance_id"), "name", "status",
        F.col("labels")["deployment"].alias("label_deployment"),
        pick_ip("network_interfaces").alias("ip"),
    )


def disk_rows(docs: DataFrame, text_col: str = "doc", keep=()) -> DataFrame:
    r = read_listing(docs, DISK_SCHEMA, text_col, keep)
    return r.where(F.col("name").isNotNull()).select(
        *keep, F.col("id").alias("disk_id"), "name", "status",
        F.col("labels")["deployment"].alias("label_deployment"), "instance_ids",
    )


def image_rows(docs: DataFrame, text_col: str = "doc", keep=()) -> DataFrame:
    return read_listing(docs, IMAGE_SCHEMA, text_col, keep).where(F.col("name").isNotNull())


def element_schema(array_schema: str) -> str:
    """``array<struct<...>>`` -> ``struct<...>`` (the schema of one listed resource)."""
    assert array_schema.startswith("array<") and array_schema.endswith(">")
    return array_schema[len("array<"):-1]


def read_listing_lines(spark, path: str, schema: str) -> DataFrame:
    """Large listings stored one resource per line (JSON lines): the files are split by
    size and read in parallel, so no single document has to fit one task."""
    from pyspark.sql.types import _parse_datatype_string

    return spark.read.schema(_parse_datatype_string(element_schema(schema))).json(path)


def read_listing_files(spark, path: str, schema: str) -> DataFrame:
    """Listing files (one JSON array per file) from a folder, read in parallel by file.

    Each file is one value decoded by one task; files too large for that are read by
    :func:`fleetlens.sources.json_array.read_listing_array`, or as JSON lines by
    :func:`read_listing_lines`.
    """
    docs = spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc").withColumn(
        "source_file", F.input_file_name())
    return read_listing(docs, schema, keep=("source_file",))
