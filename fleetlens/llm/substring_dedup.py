"""Substring dedup: relative Lempel-Ziv parsing against indexed reference blocks.

Words in windows of ``WINDOW`` are looked up in every reference block: the index
of all documents' windows is cut into blocks by window hash, and a window's
entry is its first place, (smallest id, position). Looking up only windows
whose minimizer stands in several documents (``passages``) skips the text that
can't repeat. Each document is then parsed greedily from the left: a factor is
the longest stretch whose windows follow one another in one referenced
document. A factor of ``WINDOW`` words or more is a duplicate span; windows that
straddle a factor's end were looked up on their own, so a passage that goes on
in another reference is found as well.

Exact copies of a whole text are settled by their digest first. Within a task
windows are resolved among its own documents, so a passage that a third of all
documents share sends one entry for each task batch to its block.

Defined results: a null or empty text has no words. A null id stands after all
ids. Rows with the same id never remove from each other unless they are read
``apart``: then other texts under one id are documents of their own, ordered by
uid, and only rows with the same text stand together. Windows are named by
96 bits: two different ones are taken for equal with probability n**2 / 2**97,
n being the windows looked up (6e-9 for 3e10). Texts of any length are worked whole. Other columns,
whatever their names, are not read (``rewrite_documents`` carries them along); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import NO_ID, Corpus, batches_of, by_document, from_planes, minimizers, places_of, planes, shared_places
from .text import U64, mix, steps, text_bytes, window_hashes, word_hashes, word_spans

WINDOW = 13
GRAM = 7


def _gram_hashes(data, offsets, gram: int, window: int):
    """Word-level minimizers: (hash of every gram, selected, least by window, word offsets, words)."""
    words, _, _, at = word_hashes(data, offsets)
    n = len(words)
    if n < window:
        return np.zeros(0, U64), np.zeros(0, bool), np.zeros(0, np.uint32), at, words
    h, _, _ = window_hashes(words, np.array([0, n]), gram)  # over all words; windows that cross documents don't count
    chosen, least = minimizers((h >> U64(32)).astype(np.uint32), at, gram, window)
    return h, chosen, least, at, words


def seeds(window: int, gram: int):
    def grams(data, offsets):
        h, chosen, _, at, _ = _gram_hashes(data, offsets, gram, window)
        p = np.flatnonzero(chosen)
        doc = np.searchsorted(at, p, side="right") - 1
        return h[p], p - at[doc], doc

    return grams


def _second(words: np.ndarray, window: int) -> np.ndarray:
    """32 more bits of each window's name, from other hashes of its words."""
    return (window_hashes(mix(words ^ U64(0xC2B2AE3D27D4EB4F)), np.array([0, len(words)]), window)[0] >> U64(32)).astype(np.uint32)


def _first(h, g, ids, uid, at, apart):
    """For every entry the entry with its hashes that has the smallest (id, place), or (id, uid, place)
    where the texts of an id stand apart."""
    order = np.lexsort((at, uid, ids, g, h) if apart else (at, ids, g, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
    out = np.empty(len(h), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


LOOKUP = "bucket int, h binary, g binary, uid binary, id binary, at binary, kind int, ref binary, ref_at binary"
HITS = "uid bigint, hits binary"


def _hits(uid, at, ref, ref_at):
    order = np.argsort(uid, kind="stable")
    uid = uid[order]
    cut = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])) if len(uid) else np.zeros(0, np.int64)
    ends = np.append(cut, len(uid))[1:]
    rows = np.empty(len(uid), dtype=[("at", "<u4"), ("ref_at", "<u4"), ("ref", "<i8")])
    rows["at"], rows["ref_at"], rows["ref"] = at[order], ref_at[order], ref[order]
    return pa.table({"uid": pa.array(uid[cut], pa.int64()),
                     "hits": pa.array([rows[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())})


def _look_up(window: int, gram: int, buckets: int, apart: bool):
    """Tasks: windows over shared minimizers, resolved among the task's documents; the first of
    each is sent to its block."""

    def run(stream):
        for table in batches_of(stream):
            uids, ids = table.column("uid").to_numpy(), table.column("id").to_numpy()
            places = table.column("places").to_pylist()
            data, offsets = text_bytes(table.column("text"))
            parts = []
            for lo, hi in steps(offsets):
                h, _, least, at, words = _gram_hashes(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], gram, window)
                if not len(least):
                    continue
                p = np.concatenate([places_of(places[d]) + at[d - lo] for d in range(lo, hi)])
                top = (h >> U64(32)).astype(np.uint32)
                wanted = np.zeros(len(least), bool)
                for back in range(window - gram + 1):  # windows whose minimizer stands at p
                    q = p - back
                    q, t = q[(q >= 0) & (q < len(least))], top[p[(q >= 0) & (q < len(least))]]
                    wanted[q[least[q] == t]] = True
                w = np.flatnonzero(wanted & (least > 0))
                if not len(w):
                    continue
                hashes, _, _ = window_hashes(words, np.array([0, len(words)]), window)
                doc = np.searchsorted(at, w, side="right") - 1
                parts.append((hashes[w], _second(words, window)[w], (doc + lo).astype(np.int32), (w - at[doc]).astype(np.uint32)))
            if not parts:
                continue
            h, g, doc, at = (np.concatenate(x) for x in zip(*parts))
            own, uid = ids[doc], uids[doc]
            first = _first(h, g, own, uid, at, apart)
            dup = uid[first] != uid if apart else own[first] < own
            out = []
            for kind, chosen in ((1, np.flatnonzero(dup)), (0, np.flatnonzero(~dup))):
                bucket = by_document(uid[chosen], buckets) if kind else (h[chosen] >> U64(20)) % U64(buckets)
                order = np.argsort(bucket, kind="stable")
                chosen, b = chosen[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
                for x, y in zip(cut, np.append(cut, len(b))[1:]):
                    c = chosen[x:y]
                    f = first[c]
                    out.append((int(b[x]), h[c].tobytes() if not kind else b"", g[c].tobytes() if not kind else b"", planes(uid[c]), planes(own[c]) if not kind else b"",
                                planes(at[c]), kind, planes(own[f]) if kind else b"", planes(at[f]) if kind else b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), *[pa.binary()] * 5, pa.int32(), *[pa.binary()] * 2))],
                names=["bucket", "h", "g", "uid", "id", "at", "kind", "ref", "ref_at"])

    return run


def _answer(table: pa.Table, apart: bool) -> pa.Table:
    """A block: the first place of each window; answers where it is in an earlier document."""
    col = {c: table.column(c).to_pylist() for c in table.column_names}
    asked = [i for i, k in enumerate(col["kind"]) if k == 0]
    known = [i for i, k in enumerate(col["kind"]) if k == 1]
    join = lambda name, rows, t: np.concatenate([np.zeros(0, t), *(from_planes(col[name][i], t) for i in rows)])
    h = np.frombuffer(b"".join(col["h"][i] for i in asked), U64)
    g = np.frombuffer(b"".join(col["g"][i] for i in asked), np.uint32)
    uid, ids, at = join("uid", asked, np.int64), join("id", asked, np.int64), join("at", asked, np.uint32)
    if len(h):
        first = _first(h, g, ids, uid, at, apart)
        dup = np.flatnonzero(uid[first] != uid if apart else ids[first] < ids)
        got = (uid[dup], at[dup], ids[first[dup]], at[first[dup]])
    else:
        got = (uid, at, ids, at)
    rest = (join("uid", known, np.int64), join("at", known, np.uint32), join("ref", known, np.int64), join("ref_at", known, np.uint32))
    return _hits(*(np.concatenate([a, b]) for a, b in zip(got, rest)))


def factorize(at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, window: int):
    """Greedy parse of a document: (starts, ends) in words of its factors. at ascending."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    follows = (at[1:] == at[:-1] + 1) & (ref[1:] == ref[:-1]) & (ref_at[1:] == ref_at[:-1] + 1)
    start = np.flatnonzero(np.concatenate([[True], ~follows]))
    last = np.append(start[1:], len(at)) - 1
    return at[start], at[last] + window


def _cut(window: int, keep_text: bool):
    def run(stream):
        for batch in stream:
            ids, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            hits, texts = batch.column(3).to_pylist(), batch.column(1).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            starts, ends, word_at = word_spans(data, offsets)
            n, removed, sha, factors, longest, kept_text = [], [], [], [], [], []
            for i in range(len(ids)):
                a, b = int(word_at[i]), int(word_at[i + 1])
                gone = np.zeros(b - a, bool)
                spans = (np.zeros(0, np.int64),) * 2
                if copies[i] and b - a >= window:
                    gone[:] = True
                    spans = (np.array([0]), np.array([b - a]))
                elif hits[i]:
                    rows = np.frombuffer(b"".join(hits[i]), dtype=[("at", "<u4"), ("ref_at", "<u4"), ("ref", "<i8")])
                    rows = rows[np.unique(rows["at"], return_index=True)[1]]
                    spans = factorize(rows["at"].astype(np.int64), rows["ref"], rows["ref_at"].astype(np.int64), window)
                    edge = np.zeros(b - a + 1, np.int32)
                    np.add.at(edge, spans[0], 1)
                    np.add.at(edge, spans[1], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                keep = np.flatnonzero(~gone) + a
                if len(keep):  # kept words with the byte after each, white space turned to a blank
                    size = ends[keep] - starts[keep] + 1
                    out = np.full(int(size.sum()), 0x20, np.uint8)
                    shift = np.cumsum(size) - size
                    src = np.arange(len(out)) + np.repeat(starts[keep] - shift, size)
                    real = np.ones(len(out), bool)
                    real[shift + size - 1] = False
                    out[real] = data[src[real]]
                    text = out[:-1].tobytes()
                else:
                    text = b""
                n.append(b - a)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                factors.append(len(spans[0]))
                longest.append(int((spans[1] - spans[0]).max()) if len(spans[0]) else 0)
                if keep_text:  # a text that loses nothing stays as it is
                    kept_text.append(text.decode() if removed[-1] else texts[i])
            ids = pa.array([None if x == NO_ID else x for x in ids], pa.int64())
            cols = [ids, *(pa.array(x, pa.int64()) for x in (n, removed)), pa.array(sha, pa.string()),
                    *(pa.array(x, pa.int64()) for x in (factors, longest))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "longest_factor"]
            if keep_text:
                cols += [pa.array(kept_text, pa.string()), batch.column(4)]
                names += ["kept_text", "rest"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _parsed(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str, keep_text: bool,
            apart: bool = False) -> DataFrame:
    corpus = Corpus(docs, id_col, text_col, carry=keep_text)
    originals = corpus.rows.where(~F.col("copy"))
    places = shared_places(originals, seeds(window, gram), corpus.buckets)
    asked = corpus.base.join(places, "uid").select("uid", "id", "text", "rest", "places")
    asked = asked.mapInArrow(_look_up(window, gram, corpus.buckets, apart), LOOKUP)
    answer = lambda table: _answer(table, apart)
    hits = asked.groupBy("bucket").applyInArrow(answer, HITS).groupBy("uid").agg(F.collect_list("hits").alias("hits"))
    whole = corpus.rows.join(hits, "uid", "left").select("id", "text", "copy", "hits", "rest")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_factors bigint, longest_factor bigint"
    if keep_text:
        schema += f", kept_text string, rest {whole.schema['rest'].dataType.simpleString()}"
    return whole.mapInArrow(_cut(window, keep_text), schema)


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_factors, longest_factor).

    A word goes if a window of ``window`` words over it also starts in a document
    with a smaller id; windows are judged on the input. ``kept_sha256`` is over
    the kept words joined by a blank."""
    return _parsed(docs, window, gram, id_col, text_col, False)


def rewrite_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
                      text_col: str = "text", apart: bool = False) -> DataFrame:
    """The documents, all columns, without their duplicate spans: a text that loses nothing stays
    as it is, else its kept words are joined by a blank. A null text comes out empty. ``apart``: other
    texts under one id are documents of their own."""
    got = _parsed(docs, window, gram, id_col, text_col, True, apart)
    of = {id_col: F.col("doc_id"), text_col: F.col("kept_text")}
    return got.select(*(of[c].alias(c) if c in of else F.col("rest").getField(c).alias(c) for c in docs.columns))
