"""Exchange of sampled grams: which places of a text may occur in another document too.

Shared by the exact substring operators. A window of text is represented by
its minimizer, the gram with the smallest hash inside it: equal windows have
equal minimizers, so a window that stands in two documents has a minimizer
that does. Only minimizers move (one gram in ten to twenty bytes, four words).

A task asks for each gram once however often its documents hold it, so a gram that
a third of all documents share costs its bucket one entry for each few
thousand documents. The places of grams that a task holds more than once need no
answer: they go to buckets by document, not to the gram's. Entries travel as packed arrays, a
row for each task and bucket; the number of buckets follows the input, so a bucket's size does not
grow with it. A bucket answers with the places of grams that several rows
hold. False answers (32 bits of hash within a bucket) only cost work: what
follows compares the windows themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text import U64, mix, short_batches, sliding, steps, text_bytes

#: Bytes of text whose grams a task gathers before it sends them.
GATHER = 16 << 20
#: Bytes of input text for each bucket.
BUCKET = 16 << 20
LEAST_BUCKETS = 32
SALTS = 8
NO_ID = (1 << 63) - 1


class Corpus:
    """base: (uid, id, text, rest), uid naming the id and text (64 bits, proved to be different for
    different ones of this input, else made with another salt), rest holding the other columns;
    copies: (uid) of rows whose whole text stands in a row with a smaller id; buckets: how many
    buckets fit the input."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, carry: bool = False):
        short_batches(docs.sparkSession)
        others = [F.col(c) for c in docs.columns if carry and c not in (id_col, text_col)]
        rest = F.struct(*others) if others else F.lit(None).cast("int")
        src = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"),
                          F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
        digest = F.unhex(F.md5(F.col("text").cast("binary")))
        seen = stored(src.select("id", digest.alias("digest"), F.octet_length("text").alias("n")))
        for salt in range(SALTS):
            uid = lambda d: F.xxhash64("id", d, F.lit(salt))  # noqa: B023, E731
            named = seen.groupBy(uid("digest").alias("uid")).agg(F.min(F.struct("id", "digest")).alias("low"), F.max(F.struct("id", "digest")).alias("high"))
            if named.where("low < high").isEmpty():
                break
        else:
            raise ValueError("rows can't be told apart by 64 bits")
        seen = seen.withColumn("uid", uid("digest"))
        self.base = src.select(uid(digest).alias("uid"), "id", "text", "rest")
        self.buckets = max(LEAST_BUCKETS, int((seen.agg(F.sum("n")).first()[0] or 0) // BUCKET))
        first = seen.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
        self.copies = seen.join(first, "digest").where("id > least").select("uid").distinct().withColumn("copy", F.lit(True))
        self.rows = self.base.join(self.copies, "uid", "left").select(
            "uid", "id", "text", "rest", F.coalesce("copy", F.lit(False)).alias("copy"))


def planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane: the zero planes of small numbers compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def batches_of(stream, most: int = GATHER):
    """Arrow batches joined to about ``most`` bytes of text (column ``text``)."""
    held, size = [], 0
    for batch in stream:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def minimizers(h: np.ndarray, offsets: np.ndarray, gram: int, window: int):
    """(selected, least): whether the gram at i is the minimizer of some window inside one
    document, and the smallest hash of the window that starts at i (0 where none does).

    h: 32-bit hashes of the grams that start at 0 .. n - gram; offsets: documents' places."""
    n = int(offsets[-1])
    span = window - gram + 1
    if n < window:
        return np.zeros(len(h), bool), np.zeros(0, np.uint32)
    least = sliding(h, span, np.minimum)
    edge = np.zeros(n + 1, np.int32)  # windows that start here would leave their document
    ends = offsets[1:]
    begin = np.maximum(offsets[:-1], ends - window + 1)
    np.add.at(edge, begin, 1)
    np.add.at(edge, ends, -1)
    least = np.where(np.cumsum(edge[: len(least)]) > 0, np.uint32(0), least)
    pad = np.zeros(span - 1, np.uint32)
    most = sliding(np.concatenate([pad, least, pad]), span, np.maximum)
    return (most == h) & (most > 0), least


def by_document(uid: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of what needs no answer."""
    return mix(uid.astype(np.int64).view(U64)) % U64(buckets)


SEEDS = "bucket int, h binary, uids binary, counts binary, at binary, kind int"


def _packed(bucket, h, uid, at, kind):
    """One row: entries in order of text, uids run by run, places as differences."""
    new = np.concatenate([[True], uid[1:] != uid[:-1]])
    cut = np.flatnonzero(new)
    step = np.where(new, at, np.diff(at, prepend=at[:1])).astype(np.int64)
    return (bucket, h.astype("<u4").tobytes(), uid[cut].tobytes(), planes(np.diff(np.append(cut, len(uid))).astype(np.uint32)),
            planes(step.astype(np.uint32)), kind)


def _unpacked(uids, counts, at):
    uid = np.frombuffer(uids, np.int64)
    n = from_planes(counts, np.uint32).astype(np.int64)
    total = np.cumsum(from_planes(at, np.uint32).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    before = np.concatenate([[0], total])[first]
    return np.repeat(uid, n), total - np.repeat(before, n)


def shared_places(rows: DataFrame, grams, buckets: int) -> DataFrame:
    """(uid, places): packed places of minimizers that another row may hold too.

    rows: (uid, id, text); grams(data, offsets) -> (64-bit hash, place in the document,
    document index) of the minimizers, in order of text."""

    def send(stream):
        for table in batches_of(stream):
            uids = table.column("uid").to_numpy()
            data, offsets = text_bytes(table.column("text"))
            parts = []
            for lo, hi in steps(offsets):
                h, at, doc = grams(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                parts.append((mix(h), at.astype(np.uint32), (doc + lo).astype(np.int32)))
            if not parts:
                continue
            h, at, doc = (np.concatenate(x) for x in zip(*parts))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            group = np.cumsum(new) - 1
            here = np.zeros(len(h), bool)  # it stands here more than once: known without asking
            here[order] = (np.bincount(group) > 1)[group]
            once = np.zeros(len(h), bool)
            once[order[new]] = True
            out = []
            for kind, chosen in ((1, np.flatnonzero(here)), (0, np.flatnonzero(once))):
                bucket = by_document(uids[doc[chosen]], buckets) if kind else (h[chosen] >> U64(32)) % U64(buckets)
                order = np.argsort(bucket, kind="stable")
                chosen, b = chosen[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
                for x, y in zip(cut, np.append(cut, len(b))[1:]):
                    own = chosen[x:y]
                    out.append(_packed(int(b[x]), h[own] & U64(0xFFFFFFFF), uids[doc[own]], at[own].astype(np.int64), kind))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()))],
                names=["bucket", "h", "uids", "counts", "at", "kind"])

    def answer(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        uid, at, h, known = [], [], [], []
        for i in range(table.num_rows):
            u, p = _unpacked(cols["uids"][i], cols["counts"][i], cols["at"][i])
            uid.append(u)
            at.append(p.astype(np.uint32))
            known.append(np.full(len(u), cols["kind"][i] == 1))
            h.append(np.frombuffer(cols["h"][i], "<u4"))
        uid, at, h, known = (np.concatenate(x) for x in (uid, at, h, known))
        asked = np.flatnonzero(~known)
        key = np.sort(h[asked].astype(U64) << U64(32) | asked.astype(U64))
        hs = key >> U64(32)
        same = hs[1:] == hs[:-1]
        several = np.zeros(len(key), bool)
        several[1:] |= same
        several[:-1] |= same
        hit = known
        hit[(key[several] & U64(0xFFFFFFFF)).astype(np.int64)] = True
        uid, at = uid[hit], at[hit]
        order = np.argsort(uid, kind="stable")
        uid, at = uid[order], at[order]
        cut = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])) if len(uid) else np.zeros(0, np.int64)
        ends = np.append(cut, len(uid))[1:]
        return pa.table({"uid": pa.array(uid[cut], pa.int64()),
                         "places": pa.array([at[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())})

    sent = rows.select("uid", "id", "text", "rest").mapInArrow(send, SEEDS)  # the columns of every use, so that the texts move once
    told = sent.groupBy("bucket").applyInArrow(answer, "uid bigint, places binary")
    return told.groupBy("uid").agg(F.collect_list("places").alias("places"))


def places_of(lists) -> np.ndarray:
    """Sorted distinct places of one document."""
    return np.unique(np.frombuffer(b"".join(lists), np.uint32)).astype(np.int64)
