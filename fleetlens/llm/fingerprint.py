"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph is a non-empty line. Each is hashed to a wide vector and the
vectors of a document are added lane by lane: ``EQUAL`` lanes modulo 2**64,
expanded from a 128-bit digest, decide equality; ``NEAR`` lanes modulo 2**32
count its runs of three words with random signs and give likeness. Sums don't
depend on order; ``combine`` and ``remove`` insert and delete paragraphs without
reading the rest of a document.

Likeness is the cosine of the near lanes read as signed numbers, cut to 0..1
(standard error about ``1 / sqrt(NEAR)``); 1 for equal fingerprints. A lane holds
the sums of up to 2**31 - 1 runs, more than a text of Spark's 2 GB can have.

Null and empty texts have the zero fingerprint. Rows with equal ids are
ordered by text; a null id stands below every id. Texts of any length are taken whole. Other
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, mix, short_batches, window_hashes, word_hashes, word_spans

EQUAL = 16
NEAR = 128
RUN = 3
LANES = (np.arange(1, EQUAL + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))[None, :]
NEWLINE = np.ones(256, dtype=bool)
NEWLINE[0x0A] = False
LOWEST = -(1 << 63)


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(equal lanes, near lanes) of each text, one row a text."""
    n = len(texts)
    equal, near = np.zeros((n, EQUAL), U64), np.zeros((n, NEAR), np.uint32)
    seeds, owner = [], []
    for i, text in enumerate(texts):
        own = [hashlib.blake2b(p, digest_size=16).digest() for p in text.split(b"\n") if p]
        seeds += own
        owner.append(len(own))
    if not seeds:
        return equal, near
    at = np.concatenate([[0], np.cumsum(owner)])
    seed = np.frombuffer(b"".join(seeds), dtype="<u8").reshape(-1, 2)
    has = np.flatnonzero(np.diff(at))
    for first in range(0, EQUAL, 4):  # few lanes at a time: bounded memory for long texts
        lanes = LANES[:, first: first + 4]
        wide = mix(seed[:, :1] + lanes) ^ mix(seed[:, 1:] * U64(3) + lanes)
        equal[has, first: first + 4] = np.add.reduceat(wide, at[:-1][has], axis=0)

    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    offsets[-1] -= 1
    line_start, line_end, line_at = word_spans(data, np.array([0, len(data)]), NEWLINE)
    bounds = np.append(line_start, len(data))
    words, _, _, word_at = word_hashes(data, bounds)
    runs, _, run_at = window_hashes(words, word_at, RUN)
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    few = np.diff(word_at) < RUN  # a short line is one run
    whole = mix(np.add.reduceat(np.append(words, U64(0)), word_at[:-1])[few]) if few.any() else np.zeros(0, U64)
    whole = whole[np.diff(word_at)[few] > 0]
    features = np.concatenate([runs, whole])
    doc = np.concatenate([np.repeat(line_doc, np.diff(run_at)), line_doc[few][np.diff(word_at)[few] > 0]])
    lane = doc * NEAR + (features % U64(NEAR)).astype(np.int64)
    sign = 1.0 - 2.0 * ((features >> U64(40)) & U64(1)).astype(float)
    sums = np.bincount(lane, weights=sign, minlength=n * NEAR)
    near[:] = (sums.astype(np.int64) & 0xFFFFFFFF).astype(np.uint32).reshape(n, NEAR)
    return equal, near


def render(equal: np.ndarray, near: np.ndarray) -> str:
    return equal.astype("<u8").tobytes().hex() + near.astype("<u4").tobytes().hex()


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * EQUAL], "<u8").copy(), np.frombuffer(raw[8 * EQUAL:], "<u4").copy()


def fingerprint(text: str | None) -> str:
    equal, near = vectors([(text or "").encode()])
    return render(equal[0], near[0])


def combine(a: str, b: str) -> str:
    """Fingerprint of the paragraphs of both."""
    (x, p), (y, q) = parse(a), parse(b)
    return render(x + y, p + q)


def remove(a: str, b: str) -> str:
    """Fingerprint of a without the paragraphs of b."""
    (x, p), (y, q) = parse(a), parse(b)
    return render(x - y, p - q)


def likeness(equal_a, near_a, equal_b, near_b) -> np.ndarray:
    """Row by row, 0 to 1."""
    a, b = near_a.astype(np.int32).astype(float), near_b.astype(np.int32).astype(float)
    norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.divide((a * b).sum(1), norm, out=np.zeros(len(a)), where=norm > 0)
    same = (equal_a == equal_b).all(1) & (near_a == near_b).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches):
    """Each row of a bucket with the text that follows it in descending order of ids.

    Rows come sorted by bucket; in a bucket first the carried row, then
    ascending ids, so the following document is the one before."""
    bucket, before = None, None
    for batch in batches:
        ids, texts, nexts = [], [], []
        for b, carried, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b != bucket:
                bucket, before = b, None
            if not carried:
                ids.append(doc_id)
                texts.append(text or "")
                nexts.append(before or "")
            before = text
        if not ids:
            continue
        edited = [_edited(t, f).encode() for t, f in zip(texts, nexts)]
        own = vectors([t.encode() for t in texts])
        new, other = vectors(edited), vectors([f.encode() for f in nexts])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
             pa.array([render(*x) for x in zip(*own)], pa.string()),
             pa.array([render(*x) for x in zip(*new)], pa.string()),
             pa.array(likeness(*own, *new), pa.float64()), pa.array(likeness(*own, *other), pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text; a scan."""
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = vectors([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(*x) for x in zip(*rows)], pa.string())],
                                             names=["doc_id", "fingerprint"])

    src = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, fingerprint string")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose second half is the start
    of the next document's (descending ids; the first follows the last).

    The texts move once: ids are cut into ranges at quantiles (as many as
    shuffle partitions; only ids are read for it), a range is read in order, and
    the last document of a range is also sent to the range that it precedes.
    """
    spark = docs.sparkSession
    short_batches(spark)
    src = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = src.select(key.alias("key"))
    cuts = ids.where(F.col("key") != LOWEST).stat.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)
    cuts = np.unique(np.array(cuts, dtype=np.float64))

    @F.pandas_udf("bigint")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(dtype=np.float64), side="right"))

    # one row for each range, at most as many as shuffle partitions
    last = {r.b: r.top for r in ids.groupBy(place("key").alias("b")).agg(F.max("key").alias("top")).collect()}
    order = sorted(last)
    carry = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    tops = np.array([last[b] for b in order], dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def targets(key: pd.Series) -> pd.Series:
        keys = key.to_numpy(dtype=np.int64)
        own = np.searchsorted(cuts, keys.astype(np.float64), side="right")
        at = np.searchsorted(tops, keys)
        hit = (at < len(tops)) & (tops[np.minimum(at, len(tops) - 1)] == keys) if len(tops) else np.zeros(len(keys), bool)
        return pd.Series([[b, carry[b]] if h else [b] for b, h in zip(own.tolist(), hit.tolist())])

    dealt = (src.withColumn("key", key).select(F.posexplode(targets("key")).alias("carried", "bucket"), "key", "doc_id", "text")
             .repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("carried"), "key", "text")
             .select("bucket", "carried", "doc_id", "text"))
    return dealt.mapInArrow(_pairs, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double")
