"""Integer vectors in packed blocks, shared by the operators on embeddings.

A component c becomes ``floor(SCALE * c)``, cut to ``LIMIT`` either side (beyond it a
double can't tell integers apart). A block holds up to ``ROWS`` vectors of one
task as a matrix of the smallest integers that fit; a vector that is shorter
than the block's longest has zeros after its end. A vector that is null, or holds a
null or a non-finite component, takes no part. A null id stands after all ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64
LIMIT = 2.0**52
ROWS = 4096
NO_ID = (1 << 63) - 1
BLOCK = "block bigint, asks boolean, n int, width int, size int, ids binary, data binary"


def matrix(batch_col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integers) of a column of number lists."""
    if isinstance(batch_col, pa.ChunkedArray):
        batch_col = batch_col.combine_chunks()
    offsets = batch_col.offsets.to_numpy().astype(np.int64)
    values = batch_col.values.slice(offsets[0], offsets[-1] - offsets[0])
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes nan
    offsets = offsets - offsets[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~batch_col.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    n = np.diff(offsets)[rows]
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.clip(np.floor(SCALE * x), -LIMIT, LIMIT)
    out = np.zeros((len(rows), int(n.max(initial=0))), np.int64)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(rows)), n), place] = x[np.repeat(offsets[rows], n) + place].astype(np.int64)
    return rows, out


def smallest(x: np.ndarray) -> np.ndarray:
    """The matrix in the smallest integer type that holds it."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    for t in (np.int8, np.int16, np.int32):
        if np.iinfo(t).min <= low and high <= np.iinfo(t).max:
            return x.astype(t)
    return x


def unpacked(n: int, width: int, size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{size}").reshape(n, width)


def blocks(rows: DataFrame, id_col: str, vec_col: str, asks: Column | None = None, most: int = ROWS) -> DataFrame:
    """The packed vectors (``BLOCK``), ids ascending in a block; those with ``asks`` a second time, in blocks of their own."""

    def pack(stream):
        made = TaskContext.get().partitionId() << 36
        for batch in stream:
            ids, ask = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for low in range(0, batch.num_rows, most):
                own = slice(low, low + most)
                rows, x = matrix(batch.column(1).slice(low, most))
                mine, wanted = ids[own][rows], ask[own][rows]
                order = np.argsort(mine, kind="stable")
                out = []
                for kind, chosen in ((False, order), (True, order[wanted[order]])):
                    if len(chosen):
                        part = smallest(x[chosen])
                        out.append((made, kind, len(chosen), x.shape[1], part.itemsize, mine[chosen].astype("<i8").tobytes(), part.tobytes()))
                        made += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.bool_(), *[pa.int32()] * 3, *[pa.binary()] * 2))],
                        names=["block", "asks", "n", "width", "size", "ids", "data"])

    number = rows[vec_col].cast("array<double>")
    src = rows.select(F.coalesce(rows[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"), number.alias("vec"),
                      F.coalesce(asks if asks is not None else F.lit(False), F.lit(False)).alias("asks"))
    return src.mapInArrow(pack, BLOCK)
