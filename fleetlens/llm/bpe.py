"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is
itself a token costs one probe. Tier two merges the bytes of any other
pre-token: a heap of adjacent pairs, ordered by rank and then by place, over a
doubly linked list of symbols. Texts are split by the pre-token pattern and
every pre-token is encoded on its own; ids decode back to the exact bytes.

A scan with no shuffle. The vocabulary is a file of fixed size given by its
path (``MAX_VOCAB`` bounds it); it is broadcast once. The memo of pre-tokens
seen by a task holds at most ``MEMO`` entries, is emptied when full and never
changes a result.

Nulls and empty texts have no tokens. Repeated rows and null ids each get their own row. Texts of any
length are encoded whole (a pre-token too: its heap grows with it). Other columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .text import short_batches

MAX_VOCAB = 1_000_000
MEMO = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file (base64 token, space, rank; one a line)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().split(b"\n")))}
    if len(ranks) > MAX_VOCAB:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCAB} are broadcast")
    return ranks


def _hash(key: bytes) -> tuple[int, int]:
    h = int.from_bytes(hashlib.blake2b(key, digest_size=16).digest(), "little")
    return h & 0xFFFFFFFFFFFFFFFF, h >> 64


class PerfectHash:
    """Hash and displace: n keys in exactly n slots.

    The first half of a key's hash names its bucket. A bucket of several keys
    stores the displacement that sends them all to free slots; a bucket of one
    key stores its slot itself (as ``-1 - slot``).
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        halves = [_hash(k) for k in keys]
        for i, (a, _) in enumerate(halves):
            members[a % self.buckets].append(i)
        self.shift = [0] * self.buckets
        taken = bytearray(n)
        slots = [-1] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) < 2:
                break
            d = 0
            while True:
                at = [self._slot(*halves[i], d) for i in own]
                if len(set(at)) == len(at) and not any(taken[x] for x in at):
                    break
                d += 1
            self.shift[b] = d
            for i, x in zip(own, at):
                taken[x], slots[x] = 1, i
        free = (x for x in range(n) if not taken[x])
        for b, own in enumerate(members):
            if len(own) == 1:
                x = next(free)
                self.shift[b], slots[x] = -1 - x, own[0]
        self.slots = slots

    def _slot(self, a: int, b: int, d: int) -> int:
        return (b + d * (a >> 17 | 1)) % self.n

    def index(self, key: bytes) -> int:
        """The only index that ``key`` can have; the caller compares the key."""
        a, b = _hash(key)
        d = self.shift[a % self.buckets]
        return self.slots[-1 - d] if d < 0 else self.slots[self._slot(a, b, d)]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.keys = list(ranks)
        self.ids = [ranks[k] for k in self.keys]
        self.table = PerfectHash(self.keys)
        self.pattern = pattern
        self.token = {v: k for k, v in ranks.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_memo", "_split", "_ranks")}

    def lookup(self, piece: bytes) -> int | None:
        i = self.table.index(piece)
        return self.ids[i] if i >= 0 and self.keys[i] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary."""
        rank = self.ranks.get
        n = len(piece)
        end = list(range(1, n + 1))  # the symbol at i is piece[i:end[i]]; 0: merged into an earlier one
        prev = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank(piece[i: i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapify(heap)
        while heap:
            r, i, e = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != e or mid >= e:
                continue  # one side has been merged since
            end[i], end[mid] = e, 0
            if e < n:
                prev[e] = i
                r = rank(piece[i: end[e]])
                if r is not None:
                    heappush(heap, (r, i, end[e]))
            left = prev[i]
            if left >= 0:
                r = rank(piece[left: e])
                if r is not None:
                    heappush(heap, (r, left, e))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i: end[i]]))
            i = end[i]
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        memo = self.__dict__.setdefault("_memo", {})
        split = self.__dict__.get("_split")
        if split is None:
            split = self._split = regex.compile(self.pattern)
        parts = []
        for piece in split.findall(text):
            got = memo.get(piece)
            if got is None:
                raw = piece.encode()
                one = self.lookup(raw)
                got = np.array(self.merge(raw) if one is None else [one], dtype="<u4").tobytes()
                if len(memo) >= MEMO:
                    memo.clear()
                memo[piece] = got
            parts.append(got)
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text or ""), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _scan(encoder, batches, keep_ids: bool):
    enc = encoder.value
    for batch in batches:
        ids, n, id_hash, text_hash = [], [], [], []
        for text in batch.column(1).to_pylist():
            packed = enc.packed(text or "")
            tokens = np.frombuffer(packed, dtype="<u4").tolist()
            n.append(len(tokens))
            if keep_ids:
                ids.append(tokens)
            id_hash.append(hashlib.sha256(packed).hexdigest())
            text_hash.append(hashlib.sha256(enc.decode(tokens)).hexdigest())
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols.append(pa.array(ids, pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` over the bytes that the ids decode to. A null text is
    an empty one.
    """
    spark: SparkSession = docs.sparkSession
    short_batches(spark)
    encoder = spark.sparkContext.broadcast(Encoder(load_ranks(ranks_path), pattern))
    src = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<bigint>"
    return src.mapInArrow(lambda batches: _scan(encoder, batches, keep_ids), schema)
