"""Hidden Markov language model: Baum-Welch over all training documents, exact scores.

A token is a lower-cased word or the end of a document. Its class is given by
its last two bytes (``CLASSES``; the end has its own). Latent states emit
classes, a class emits its words by their training counts:

    P(text) = P_hmm(classes of the text) * product of (c + 1) / (C_k + V_k + 1)

with c the token's training count, C_k and V_k the tokens and types of its
class. Every training document is read in every round: tasks gather expected
counts, one aggregation adds them up, the driver gets the few hundred sums.
The forward recursion is scaled and exact for texts of any length: a text is
cut in blocks whose transfer matrices are multiplied in order.

Counts: tasks pack some megabytes of texts to a shard (place of each token in
the shard's sorted list of distinct words), written once. Each shard sends each
distinct word once to the bucket of its hash; a bucket adds up the training
counts and answers each shard. Frequent words so cost one entry a shard. Shards
and buckets have a fixed size; their number follows the input.

Defined results: null and empty texts are the end token alone. A null id learns
(its fold is not the held-out one). Repeated rows count, and are scored, once
each. Words are told apart by 64 bits. Other columns, whatever their names, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .passages import from_planes, planes
from .text import LOWER, U64, mix, remainder, short_batches, steps, text_bytes, word_hashes

STATES = 4
CLASSES = 256
END_CLASS = CLASSES - 1
END = U64(0xE0D0E0D0E0D0E0D1)
ROUNDS = 4
SHARD = 4 << 20
BUCKET = 16 << 20
LEAST_BUCKETS = 32
BLOCK = 64
RESCALE = 8


class Hmm:
    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(class_counts: np.ndarray, states: int = STATES) -> "Hmm":
        rng = np.random.default_rng(0)
        emit = (class_counts + 0.5)[None, :] * (0.5 + rng.random((states, len(class_counts))))
        move = np.full((states, states), 0.3 / max(1, states - 1))
        np.fill_diagonal(move, 0.7 if states > 1 else 1.0)
        return Hmm(np.full(states, 1.0 / states), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def from_counts(start, move, emit) -> "Hmm":
        norm = lambda x, s: (x + s) / (x + s).sum(-1, keepdims=True)
        return Hmm(norm(start, 0.01), norm(move, 0.01), norm(emit, 0.01))


class Blocks:
    """Documents (symbols, offsets; none empty) cut in blocks, the longest block first."""

    def __init__(self, offsets: np.ndarray):
        n = np.diff(offsets)
        per = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(n)), per)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = offsets[doc] + number * BLOCK
        length = np.minimum(BLOCK, offsets[doc + 1] - start)
        order = np.argsort(-length, kind="stable")
        self.start, self.length, self.first = start[order], length[order], (number == 0)[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.per, self.begin, self.place = per, np.cumsum(per) - per, place
        self.active = [int(np.searchsorted(-self.length, -t, side="left")) for t in range(BLOCK)]

    def nth(self, j: int):
        """Documents with more than j blocks, and where their block j is."""
        docs = np.flatnonzero(self.per > j)
        return docs, self.place[self.begin[docs] + j]


def _transfer(h: Hmm, sym: np.ndarray, blocks: Blocks):
    """(matrices, log scales): row vectors of state weights are taken through each block."""
    s = len(h.start)
    m = np.broadcast_to(np.eye(s), (len(blocks.start), s, s)).copy()
    scale = np.zeros(len(m))
    emit = np.ascontiguousarray(h.emit.T)
    for t in range(BLOCK):
        k = blocks.active[t]
        if not k:
            break
        moved = (m[:k].reshape(-1, s) @ h.move).reshape(k, s, s)
        if t == 0:  # a document's first token follows no move
            moved[blocks.first[:k]] = m[:k][blocks.first[:k]]
        m[:k] = moved * emit[sym[blocks.start[:k] + t]][:, None, :]
        if t % RESCALE == RESCALE - 1 or t == BLOCK - 1 or blocks.active[t + 1] < k:
            top = m[:k].max((1, 2))
            m[:k] /= top[:, None, None]
            scale[:k] += np.log(top)
    return m, scale


def log_likelihood(h: Hmm, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's symbols, by the scaled forward recursion."""
    if len(offsets) < 2:
        return np.zeros(0)
    blocks = Blocks(offsets)
    m, scale = _transfer(h, sym, blocks)
    v = np.broadcast_to(h.start, (len(offsets) - 1, len(h.start))).copy()
    out = np.zeros(len(v))
    for j in range(int(blocks.per.max(initial=0))):
        d, b = blocks.nth(j)
        v[d] = np.einsum("di,dij->dj", v[d], m[b])
        total = v[d].sum(1)
        v[d] /= total[:, None]
        out[d] += np.log(total) + scale[b]
    return out


def expected_counts(h: Hmm, sym: np.ndarray, offsets: np.ndarray):
    """(start, move, emit) expected counts of the documents: one E-step."""
    s = len(h.start)
    start, move, emit = np.zeros(s), np.zeros((s, s)), np.zeros((s, h.emit.shape[1]))
    if len(offsets) < 2:
        return start, move, emit
    blocks = Blocks(offsets)
    m, _ = _transfer(h, sym, blocks)
    n, nb = len(offsets) - 1, len(blocks.start)
    before, after = np.empty((nb, s)), np.ones((nb, s))
    v = np.broadcast_to(h.start, (n, s)).copy()
    most = int(blocks.per.max())
    for j in range(most):
        d, b = blocks.nth(j)
        before[b] = v[d]
        v[d] = np.einsum("di,dij->dj", v[d], m[b])
        v[d] /= v[d].sum(1, keepdims=True)
    w = np.ones((n, s))
    for j in range(most - 1, -1, -1):
        d, b = blocks.nth(j)
        after[b] = w[d]
        w[d] = np.einsum("dij,dj->di", m[b], w[d])
        w[d] /= w[d].sum(1, keepdims=True)
    b_of = np.ascontiguousarray(h.emit.T)
    alpha = np.empty((BLOCK, nb, s))
    a = before.copy()
    for t in range(BLOCK):
        k = blocks.active[t]
        if not k:
            break
        x = a[:k] @ h.move
        if t == 0:
            x[blocks.first[:k]] = a[:k][blocks.first[:k]]
        x *= b_of[sym[blocks.start[:k] + t]]
        x /= x.sum(1, keepdims=True)
        a[:k] = alpha[t, :k] = x
    beta = after
    gammas, symbols = [], []
    for t in range(BLOCK - 1, -1, -1):
        k = blocks.active[t]
        if not k:
            continue
        g = alpha[t, :k] * beta[:k]
        g /= g.sum(1, keepdims=True)
        here = sym[blocks.start[:k] + t]
        gammas.append(g)
        symbols.append(here)
        ahead = b_of[here] * beta[:k]
        prev = alpha[t - 1, :k] if t else before[:k]
        if t == 0:
            start += g[blocks.first[:k]].sum(0)
            ahead, prev = ahead[~blocks.first[:k]], prev[~blocks.first[:k]]
        z = np.einsum("bi,ij,bj->b", prev, h.move, ahead)
        move += h.move * ((prev / z[:, None]).T @ ahead)
        if t:
            x = ahead @ h.move.T
            beta[:k] = x / x.sum(1, keepdims=True)
    g, here = np.concatenate(gammas), np.concatenate(symbols)
    for i in range(s):
        emit[i] = np.bincount(here, weights=g[:, i], minlength=emit.shape[1])
    return start, move, emit


PACKED = ("kind int, bucket int, shard bigint, h binary, counts binary, classes binary, "
          "ids binary, no_id binary, held binary, offsets binary, at binary, symbols binary")
NAMES = [x.split()[0] for x in PACKED.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 9]


def _classes(data, starts, ends):
    last = data[ends - 1].astype(np.uint32)
    second = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint32)
    x = (last * np.uint32(0x9E3779B1)) ^ (second * np.uint32(0x85EBCA77))
    return ((x ^ (x >> np.uint32(13))) % np.uint32(END_CLASS)).astype(np.uint8)


def _shard(ids, no_id, held, data, offsets, buckets):
    """Rows of one shard: its distinct words by bucket, then its documents."""
    n = len(offsets) - 1
    hashes, sym, sizes = [], [], []
    for lo, hi in steps(offsets):
        text = LOWER[data[offsets[lo]: offsets[hi]]]
        h, starts, ends, at = word_hashes(text, offsets[lo: hi + 1] - offsets[lo])
        c = _classes(text, starts, ends)
        stop = at[1:]  # the end token goes after each document's last word
        hashes.append(np.insert(h, stop, END))
        sym.append(np.insert(c, stop, np.uint8(END_CLASS)))
        sizes.append(np.diff(at) + 1)
    h, sym, sizes = np.concatenate(hashes), np.concatenate(sym), np.concatenate(sizes)
    token_at = np.concatenate([[0], np.cumsum(sizes)])
    key = mix(h)
    bucket_of = key % U64(buckets)
    words, first, place = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(bucket_of[first], kind="stable")  # words by bucket, then by hash
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words, first, place = words[order], first[order], rank[place]
    learned = np.repeat(~held, sizes)
    counts = np.bincount(place[learned], minlength=len(words)).astype(np.uint32)
    b = bucket_of[first]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    name = int.from_bytes(os.urandom(8), "little") >> 1  # the rows are written once, so any name will do
    none = [b""] * 6
    rows = [(0, int(b[x]), name, words[x:y].tobytes(), planes(counts[x:y]), sym[first[x:y]].tobytes(), *none)
            for x, y in zip(cut, np.append(cut, len(words))[1:])]
    rows.append((1, -1, name, b"", b"", b"", ids.tobytes(), no_id.tobytes(), held.tobytes(),
                 token_at.astype(np.int64).tobytes(), planes(place.astype(np.uint32)), sym.tobytes()))
    return rows, n


def _pack(buckets: int):
    def rows_of(held_batches):
        table = pa.Table.from_batches(held_batches).combine_chunks()
        ids = table.column("id")
        data, offsets = text_bytes(table.column("text"))
        no_id = ids.is_null().to_numpy(zero_copy_only=False) if not isinstance(ids, pa.ChunkedArray) else \
            ids.combine_chunks().is_null().to_numpy(zero_copy_only=False)
        rows, _ = _shard(ids.fill_null(0).to_numpy().astype(np.int64), np.asarray(no_id, bool),
                         np.asarray(table.column("held").to_numpy(), bool), data, offsets, buckets)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    def run(stream):
        have, size = [], 0
        for batch in stream:
            if not batch.num_rows:
                continue
            have.append(batch)
            size += batch.nbytes
            if size >= SHARD:
                yield rows_of(have)
                have, size = [], 0
        if have:
            yield rows_of(have)

    return run


COUNTED = "shard bigint, bucket int, counts binary, class int, tokens bigint, types bigint"


def _count(table: pa.Table) -> pa.Table:
    """A bucket: training counts of its words, for each shard in the order it sent them; sums by class."""
    col = {c: table.column(c).to_pylist() for c in ("bucket", "shard", "h", "counts", "classes")}
    h = [np.frombuffer(x, U64) for x in col["h"]]
    n = np.concatenate([from_planes(x, np.uint32) for x in col["counts"]]).astype(np.int64)
    words, first, place = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
    total = np.bincount(place, weights=n, minlength=len(words)).astype(np.int64)
    cls = np.frombuffer(b"".join(col["classes"]), np.uint8)[first]
    known = total > 0
    tokens = np.bincount(cls[known], weights=total[known], minlength=CLASSES).astype(np.int64)
    types = np.bincount(cls[known], minlength=CLASSES)
    some = np.flatnonzero(types)
    at = np.concatenate([[0], np.cumsum([len(x) for x in h])])
    back = [planes(total[place[x:y]]) for x, y in zip(at, at[1:])]
    k = len(some)
    return pa.table([pa.array([*col["shard"], *[None] * k], pa.int64()), pa.array([*col["bucket"], *[None] * k], pa.int32()),
                     pa.array([*back, *[None] * k], pa.binary()), pa.array([*[None] * len(back), *some.tolist()], pa.int32()),
                     pa.array([*[None] * len(back), *tokens[some].tolist()], pa.int64()),
                     pa.array([*[None] * len(back), *types[some].tolist()], pa.int64())],
                    names=["shard", "bucket", "counts", "class", "tokens", "types"])


def _learning(offsets, held, sym):
    """Symbols and offsets of the documents that are learned from."""
    keep = ~held
    n = np.diff(offsets)
    return sym[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])])


def train(packed: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """Baum-Welch over the packed training documents."""
    model = Hmm.initial(class_counts, states)
    rows = packed.where("kind = 1").select("offsets", "held", "symbols")
    for _ in range(rounds):
        h = model

        def gather(batches):
            sums = None
            for batch in batches:
                for off, held, sym in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    got = expected_counts(h, *_learning(np.frombuffer(off, np.int64), np.frombuffer(held, bool), np.frombuffer(sym, np.uint8))[0:2])
                    sums = got if sums is None else tuple(a + b for a, b in zip(sums, got))
            if sums is not None:
                flat = np.concatenate([x.ravel() for x in sums])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "x"])

        got = rows.mapInArrow(gather, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # states * (classes + states + 1) sums
        flat = np.zeros(states * (1 + states + CLASSES))
        for r in got:
            flat[r.i] = r.x
        model = Hmm.from_counts(flat[:states], flat[states: states + states * states].reshape(states, states),
                                flat[states + states * states:].reshape(states, CLASSES))
    return model


def score_documents(docs: DataFrame, held_out, rounds: int = ROUNDS, states: int = STATES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    held_out: boolean Column; its rows are scored, not learned from. Scores are
    log10 probabilities; ``base_score`` is the add-one unigram model."""
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                      F.coalesce(held_out, F.lit(False)).alias("held"))
    short_batches(spark)
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = stored(src.mapInArrow(_pack(max(LEAST_BUCKETS, int(size // BUCKET))), PACKED))
    sent = packed.where("kind = 0").select("bucket", "shard", "h", "counts", "classes")
    counted = stored(sent.groupBy("bucket").applyInArrow(_count, COUNTED))
    sums = counted.where("class IS NOT NULL").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)  # one row a class
    for r in sums:
        tokens[r["class"]], types[r["class"]] = r.tokens, r.types
    total, distinct = int(tokens.sum()), int(types.sum())
    model = train(packed, tokens, rounds, states)
    log_class = np.log10(tokens + types + 1)

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy())
        blobs = right.column("counts").to_pylist()
        c = np.concatenate([from_planes(blobs[i], np.int64) for i in order])
        out = []
        for ids, no_id, held, offsets, at, sym in zip(*(left.column(x).to_pylist() for x in ("ids", "no_id", "held", "offsets", "at", "symbols"))):
            offsets, sym = np.frombuffer(offsets, np.int64), np.frombuffer(sym, np.uint8)
            mine = c[from_planes(at, np.uint32)]
            first = offsets[:-1]
            words = np.add.reduceat(np.log10(mine + 1.0), first)
            n = np.diff(offsets)
            base = words - n * np.log10(total + distinct + 1.0)
            full = words - np.add.reduceat(log_class[sym], first) + log_likelihood(model, sym, offsets) / np.log(10.0)
            out.append(pa.table([pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(no_id, bool)), pa.array(np.frombuffer(held, bool)),
                                 pa.array(n), pa.array(np.add.reduceat((mine > 0).astype(np.int64), first)),
                                 pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(full)],
                                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    texts = packed.where("kind = 1").select("shard", "ids", "no_id", "held", "offsets", "at", "symbols")
    answers = counted.where("shard IS NOT NULL").select("shard", "bucket", "counts")
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the fold, score all of them."""
    return score_documents(docs, remainder("doc_id", 7) == 2)
