"""Output folders that change as a whole.

A job writes each version of an output into a folder of its own, under Spark's own commit of
tasks; then one small file that names the current version is put in place by an atomic
rename. A job that fails or is killed half way leaves the version before it whole and in
place; readers that began on it go on reading it. Folders that no longer are one of the last
versions are removed by the next publication.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

CURRENT = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Let ``write(folder)`` write a new version of the output ``path`` and make it the current one.

    Returns the folder of the version. ``keep`` versions stay, the new one included. If ``write`` fails its
    folder is removed and nothing changes."""
    jvm, folder, fs = _fs(spark, path)
    sub = lambda name: jvm.org.apache.hadoop.fs.Path(folder, name)
    name = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    target = f"{path.rstrip('/')}/{name}"
    try:
        write(target)
    except BaseException:
        fs.delete(sub(name), True)  # abort
        raise
    draft = sub(f".{name}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(name, "ascii"))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(draft, sub(CURRENT), overwrite)  # commit
    old = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version-"))
    for v in [v for v in old if v < name][: max(0, len([v for v in old if v <= name]) - keep)]:
        fs.delete(sub(v), True)
    return target


def published(spark: SparkSession, path: str) -> str:
    """The folder of the current version of the output ``path``."""
    jvm, folder, fs = _fs(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(folder, CURRENT)
    if not fs.exists(pointer):
        raise FileNotFoundError(f"nothing is published at {path}")
    stream = fs.open(pointer)
    name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{path.rstrip('/')}/{name}"
