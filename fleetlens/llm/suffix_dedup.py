"""Exact substring dedup on bytes by sorting sampled suffixes and inducing the rest.

Every string of ``LENGTH`` bytes that also starts in a document with a smaller id
is marked, wherever it stands; covered bytes go.

* Sampled suffixes are those that start at minimizers (``GRAM`` bytes), the
  content-defined counterpart of the suffixes an induced sort selects: about one
  in fourteen. Those whose gram stands in one row only are dropped (``passages``).
* The rest travel as tuples of key, context, id and place to shards by key. The
  queues between tasks and shards are Spark's shuffle files: sorted runs on disk.
* Inside a shard the sampled suffixes are sorted and the length of the common
  prefix with their neighbour is kept. The other suffixes of a window are induced
  from its sampled one: the string that starts ``back`` bytes before it equals
  another one exactly if the common prefix reaches ``LENGTH - back`` and the
  ``back`` bytes before are the same. So for each ``back`` the runs of the sorted
  order between shorter prefixes, split by the bytes before, are the classes of
  equal strings.

A task resolves its own tuples first and sends only strings that are first among
its documents, so a string that a third of all documents share costs a shard
one tuple for each few thousand documents. Whole copies are settled by digest.

Defined results: null texts are empty; a null id stands after all ids; rows
with the same id never remove from each other; repeated rows each get their row. Texts of any
length are worked whole. Other columns, whatever their names, are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import GATHER, NO_ID, Corpus, batches_of, by_document, from_planes, minimizers, places_of, planes, shared_places
from .text import BASE, U64, mix, powers, prefix_hash, steps, text_bytes

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: A tuple's context: the bytes before the sampled suffix and its first ``LENGTH``.
CONTEXT = SPAN - 1 + LENGTH


def _grams(data, offsets):
    """(hashes of every gram, selected, least by window)."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, U64), np.zeros(0, bool), np.zeros(0, np.uint32)
    g = prefix_hash(data, BASE)
    _, inv = powers(BASE, n + 1)
    h = mix((g[GRAM:] - g[:-GRAM]) * inv[: n - GRAM + 1])
    chosen, least = minimizers((h >> U64(32)).astype(np.uint32), offsets, GRAM, LENGTH)
    return h, chosen, least


def seeds(data, offsets):
    h, chosen, _ = _grams(data, offsets)
    p = np.flatnonzero(chosen)
    doc = np.searchsorted(offsets, p, side="right") - 1
    return h[p], p - offsets[doc], doc


def resolve(context: np.ndarray, open_: np.ndarray, ids: np.ndarray):
    """For each tuple and ``back`` (bits of ``open_``): (later, first) - whether its string also starts in a
    tuple with a smaller id, and whether none has a smaller one (ties included)."""
    m = len(ids)
    later, first = np.zeros(m, np.uint32), np.zeros(m, np.uint32)
    if not m:
        return later, first
    before, after = context[:, : SPAN - 1], context[:, SPAN - 1:]
    padded = np.zeros((m, -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = after
    order = np.lexsort(padded.view(">u8").T[::-1])  # the sampled suffixes in byte order
    common = np.full(m, 0)
    for a in range(0, m - 1, 1 << 16):
        differ = after[order[a: a + (1 << 16)]][: m - 1 - a] != after[order[a + 1: a + (1 << 16) + 1]]
        common[a + 1: a + 1 + len(differ)] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    p, _ = powers(BASE, SPAN)
    left = np.zeros(m, U64)  # hash of the ``back`` bytes before, one byte longer each time
    for back in range(SPAN):
        if back:
            left += before[:, SPAN - 1 - back].astype(U64) * p[back - 1]
        run = np.empty(m, np.int64)
        run[order] = np.cumsum(common < LENGTH - back)
        rows = np.flatnonzero(open_ >> np.uint32(back) & np.uint32(1))
        if not len(rows):
            continue
        s = SPAN - 1 - back
        h = mix(mix(left[rows]) + run[rows].astype(U64) * U64(0xD6E8FEB86659FD93))
        by = np.lexsort((ids[rows], h))
        rows, h = rows[by], h[by]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        least = rows[new][np.cumsum(new) - 1]
        dup = ids[least] < ids[rows]
        check = np.flatnonzero(dup)
        for a in range(0, len(check), 1 << 16):  # the bytes before, and the run, are compared themselves
            c = check[a: a + (1 << 16)]
            equal = (before[rows[c], s:] == before[least[c], s:]).all(1) & (run[rows[c]] == run[least[c]])
            dup[c[~equal]] = False
        bit = np.uint32(1 << back)
        later[rows[dup]] |= bit
        first[rows[~dup]] |= bit
    return later, first


TUPLES = "bucket int, uid binary, id binary, at binary, open binary, context binary, known binary"
MARKS = "uid bigint, marks binary"


def _send(buckets: int):
    def run(stream):
        for table in batches_of(stream, GATHER // 2):  # a tuple is far larger than the bytes it stands for
            uids, ids = table.column("uid").to_numpy(), table.column("id").to_numpy()
            places = table.column("places").to_pylist()
            data, offsets = text_bytes(table.column("text"))
            parts = []
            for lo, hi in steps(offsets):
                text, own = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
                h, _, least = _grams(text, own)
                if not len(least):
                    continue
                local = [places_of(places[d]) for d in range(lo, hi)]
                p = np.concatenate([x + own[i] for i, x in enumerate(local)])
                doc = np.repeat(np.arange(hi - lo), [len(x) for x in local])
                top = (h >> U64(32)).astype(np.uint32)
                open_ = np.zeros(len(p), np.uint32)
                for back in range(SPAN):
                    q = p - back
                    ok = (q >= 0) & (q < len(least))
                    ok[ok] = least[q[ok]] == top[p[ok]]
                    open_[ok] |= np.uint32(1 << back)
                some = open_ > 0
                p, doc, open_ = p[some], doc[some], open_[some]
                if not len(p):
                    continue
                context = np.zeros((len(p), CONTEXT), np.uint8)
                for a in range(0, len(p), 1 << 14):
                    part = slice(a, a + (1 << 14))
                    cells = p[part, None] + np.arange(1 - SPAN, LENGTH)[None, :]
                    inside = (cells >= own[doc[part]][:, None]) & (cells < own[doc[part] + 1][:, None])
                    context[part] = np.where(inside, text[np.clip(cells, 0, len(text) - 1)], 0)
                parts.append((h[p], (doc + lo).astype(np.int64), (p - own[doc]).astype(np.uint32), open_, context))
            if not parts:
                continue
            h, doc, at, open_, context = (np.concatenate(x) for x in zip(*parts))
            uid, own = uids[doc], ids[doc]
            known, ask = resolve(context, open_, own)
            bucket = np.where(ask > 0, mix(h) % U64(buckets), by_document(uid, buckets))  # what is known needs no shard
            keep = np.argsort(bucket, kind="stable")
            b = bucket[keep]
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            out = []
            for x, y in zip(cut, np.append(cut, len(b))[1:]):
                c = keep[x:y]
                c = c[np.argsort(ask[c] == 0, kind="stable")]  # asked tuples first: only they carry a context
                asked = c[ask[c] > 0]
                out.append((int(b[x]), planes(uid[c]), planes(own[asked]), planes(at[c]), planes(ask[asked]),
                            pa.compress(context[asked].tobytes(), codec="zstd", asbytes=True), planes(known[c])))
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 6))],
                                             names=["bucket", "uid", "id", "at", "open", "context", "known"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    col = {c: table.column(c).to_pylist() for c in table.column_names}
    uid, at, marks, where = [], [], [], []
    ids, open_, context = [], [], []
    seen = 0
    for i in range(table.num_rows):
        uid.append(from_planes(col["uid"][i], np.int64))
        at.append(from_planes(col["at"][i], np.uint32))
        marks.append(from_planes(col["known"][i], np.uint32))
        ids.append(from_planes(col["id"][i], np.int64))
        open_.append(from_planes(col["open"][i], np.uint32))
        raw = pa.decompress(col["context"][i], len(ids[-1]) * CONTEXT, codec="zstd", asbytes=True)
        context.append(np.frombuffer(raw, np.uint8).reshape(-1, CONTEXT))
        where.append(np.arange(len(ids[-1])) + seen)
        seen += len(uid[-1])
    uid, at, marks, where, ids, open_, context = (np.concatenate(x) for x in (uid, at, marks, where, ids, open_, context))
    later, _ = resolve(context, open_, ids)
    marks = marks.copy()
    marks[where] |= later
    hit = np.flatnonzero(marks)
    hit = hit[np.argsort(uid[hit], kind="stable")]
    uid = uid[hit]
    cut = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])) if len(uid) else np.zeros(0, np.int64)
    ends = np.append(cut, len(uid))[1:]
    rows = np.stack([at[hit], marks[hit]], axis=1).astype("<u4")
    return pa.table({"uid": pa.array(uid[cut], pa.int64()), "marks": pa.array([rows[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())})


def _cut(stream):
    for batch in stream:
        ids, copies, marks = (batch.column(i).to_pylist() for i in (0, 2, 3))
        data, offsets = text_bytes(batch.column(1))
        n, removed, spans, sha = [], [], [], []
        for i in range(len(ids)):
            text = data[offsets[i]: offsets[i + 1]]
            gone = np.zeros(len(text), bool)
            if copies[i] and len(text) >= LENGTH:
                gone[:] = True
            elif marks[i]:
                rows = np.frombuffer(b"".join(marks[i]), "<u4").reshape(-1, 2)
                at, bits = rows[:, 0].astype(np.int64), rows[:, 1]
                edge = np.zeros(len(text) + 1, np.int32)
                for back in range(SPAN):
                    start = at[bits >> np.uint32(back) & np.uint32(1) == 1] - back
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
            n.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(text) else 0)
            sha.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if x == NO_ID else x for x in ids], pa.int64()), *(pa.array(x, pa.int64()) for x in (n, removed, spans)),
             pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every text as UTF-8 bytes."""
    corpus = Corpus(docs, id_col, text_col)
    originals = corpus.rows.where(~F.col("copy"))
    places = shared_places(originals, seeds, corpus.buckets)
    tuples = corpus.base.join(places, "uid").select("uid", "id", "text", "places").mapInArrow(_send(corpus.buckets), TUPLES)
    marks = tuples.groupBy("bucket").applyInArrow(_answer, MARKS).groupBy("uid").agg(F.collect_list("marks").alias("marks"))
    whole = corpus.rows.join(marks, "uid", "left").select("id", "text", "copy", "marks")
    return whole.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
