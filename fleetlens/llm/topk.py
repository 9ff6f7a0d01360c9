"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of terms (its components that are not 0) with integer
weights. The rows are packed in blocks; a block's postings are the rows and weights
of each term. Queries meet every block: term after term, a query's weight
times the postings' weights is added to the scores, a dense array with a place for
every row of the block. Postings that most rows hold are whole columns, so
those terms are added as one product of matrices; the others are scattered.

Of each array the k best are selected by partition: the k-th best score is a
lower bound, rows below it (or below the k-th best found so far) are never sorted,
ties go to the smaller id. A task merges what its blocks give, a last window
merges the tasks.

The query set is put against all rows in blocks: pairs of blocks, not pairs of rows,
are what Spark joins, and a task holds two blocks and one array at a time. Stored
blocks cut the lineage: a lost task reads its two partitions again.

Sums are exact: in 32 or 64 bit floats while the norms prove that no sum leaves the
range in which these hold every integer, else in Python's integers (scores that don't
fit a long are cut to its ends).

Defined results: null vectors, and those with null or non-finite components, take no
part. Vectors of unequal length: missing components are 0; an empty vector scores 0.
A row with the query's id is the query's own, also if it is repeated; repeated query
rows each get their result. A null id asks nothing and stands after all ids. Other
columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .vectors import NO_ID, blocks, unpacked

K = 20
#: Share of a block's rows that hold a term from which on its postings are a whole column.
WHOLE = 0.25
#: Queries whose dense arrays a task holds at a time.
ASKED = 128
#: Bytes of packed vectors for each partition, query blocks whose best a task keeps.
PART, KEPT = 8 << 20, 32


class Postings:
    """A block's rows by term."""

    def __init__(self, x: np.ndarray):
        held = x != 0
        share = held.mean(0) if len(x) else np.zeros(x.shape[1])
        self.n, self.width = x.shape
        self.whole = np.flatnonzero(share >= WHOLE)
        self.columns = np.ascontiguousarray(x[:, self.whole].T)
        self.sparse = {int(t): (rows := np.flatnonzero(held[:, t]), x[rows, t]) for t in np.flatnonzero((share > 0) & (share < WHOLE))}
        self.norm = float(np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0.0)))

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Dense arrays of the queries' exact scores, one row a query."""
        q = q[:, : self.width]
        bound = 1.01 * self.norm * float(np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0.0)))
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        q = q.astype(int).astype(kind) if kind is object else q.astype(kind)
        if q.shape[1] < self.width:
            q = np.concatenate([q, np.zeros((len(q), self.width - q.shape[1]), kind)], axis=1)
        whole = self.columns.astype(int).astype(object) if kind is object else self.columns.astype(kind)
        out = q[:, self.whole] @ whole if len(self.whole) else np.zeros((len(q), self.n), kind)
        for t, (rows, weights) in self.sparse.items():
            asks = np.flatnonzero(q[:, t])
            if len(asks):
                weights = weights.astype(int).astype(object) if kind is object else weights.astype(kind)
                out[np.ix_(asks, rows)] += np.outer(q[asks, t], weights)
        return np.clip(out, -(1 << 63), (1 << 63) - 1) if kind is object else out


class Best:
    """The best rows of a block of queries so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.row, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.bound = np.full(len(ids), -np.inf)  # score of the k-th best

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from ``first`` on for the block's rows ``ids``, which ascend."""
        asks = np.arange(first, first + len(scores))
        left, right = np.searchsorted(ids, self.ids[asks], "left"), np.searchsorted(ids, self.ids[asks], "right")
        other = np.ones(scores.shape, bool) if (left < right).any() else None
        for i in np.flatnonzero(left < right):
            other[i, left[i]: right[i]] = False
        row, place = np.nonzero(self._hits(scores, other, self.bound[asks]))
        if len(row) > 4 * self.k * len(scores) and scores.shape[1] > self.k and scores.dtype != object:
            floor = scores if other is None else np.where(other, scores, scores.min(1, keepdims=True))
            cut = np.partition(floor, len(ids) - self.k, axis=1)[:, len(ids) - self.k].astype(float)
            row, place = np.nonzero(self._hits(scores, other, np.maximum(self.bound[asks], cut)))
            tie = scores[row, place].astype(float) == np.maximum(self.bound[asks], cut)[row]
            nth = np.cumsum(tie)
            begin = np.searchsorted(row, np.arange(len(scores)))
            before = np.concatenate([[0], nth])[begin]
            keep = ~tie | (nth - before[row] <= self.k)  # of ties, those with the smallest ids
            row, place = row[keep], place[keep]
        if len(row):
            self._merge(row + first, scores[row, place].astype(np.int64), ids[place])

    @staticmethod
    def _hits(scores, other, bound):
        hits = scores >= bound[:, None].astype(scores.dtype)
        return hits if other is None else hits & other

    def _merge(self, row, score, vec):
        row, score, vec = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, ~score, row))  # ~x falls as x grows, without overflow
        row, score, vec = row[order], score[order], vec[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        self.row, self.score, self.vec = row[keep], score[keep], vec[keep]
        full = nth == self.k - 1
        # a 64-bit score can round up as a float: one step down keeps the bound below it
        self.bound[row[full]] = np.where(np.abs(score[full]) < 2**53, score[full], np.nextafter(score[full].astype(float), -np.inf))

    def rows(self, block: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self.row), block)), pa.array(self.row.astype(np.int32)),
                                           pa.array(self.ids[self.row]), pa.array(self.vec), pa.array(self.score)],
                                          names=["block", "row", "query_id", "vec_id", "score"])


def _search(k: int):
    """Pairs of a query block and a block of rows -> the best rows of each query."""

    def run(stream):
        best: dict[int, Best] = {}
        last, postings, ids = None, None, None
        for batch in stream:
            for r in batch.to_pylist():
                if r["block"] != last:
                    postings = Postings(unpacked(r["n"], r["width"], r["size"], r["data"]))
                    last, ids = r["block"], np.frombuffer(r["ids"], "<i8")
                q = unpacked(r["q_n"], r["q_width"], r["q_size"], r["q_data"])
                if r["q_block"] not in best:
                    if len(best) >= KEPT:  # what goes out early is merged with the rest by the last window
                        gone = next(iter(best))
                        yield best.pop(gone).rows(gone)
                    best[r["q_block"]] = Best(np.frombuffer(r["q_ids"], "<i8"), k)
                for first in range(0, len(q), ASKED):
                    best[r["q_block"]].add(first, postings.scores(q[first: first + ASKED]), ids)
        for block, b in best.items():
            yield b.rows(block)

    return run


def exact_top_k(vectors: DataFrame, asks: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row with ``asks`` the k other rows with the greatest inner product."""
    packed = stored(blocks(vectors, id_col, vec_col, asks & vectors[id_col].isNotNull()))
    size = {bool(r.asks): r.bytes for r in packed.groupBy("asks").agg(F.sum(F.octet_length("data")).alias("bytes")).collect()}
    at_once = packed.sparkSession.sparkContext.defaultParallelism
    parts = lambda which, least: max(least, int(size.get(which, 0) // PART) + 1)
    rows = packed.where("NOT asks").repartition(parts(False, at_once), "block")
    queries = packed.where("asks").repartition(parts(True, 1), "block")
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "n", "width", "size", "ids", "data")))
    found = queries.crossJoin(rows.drop("asks")).mapInArrow(  # blocks of the query set against blocks of all rows
        _search(k), "block bigint, row int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
