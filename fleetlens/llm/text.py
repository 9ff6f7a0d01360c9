"""Vectorised text helpers shared by the operators of this subpackage.

Tasks see texts as the UTF-8 bytes of an Arrow column, never as Python
strings: one ``uint8`` array with document offsets. Words, n-grams and their
64-bit hashes are array expressions over it. A null text is an empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (bytes in a word, words in a window).
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
MASK = (1 << 64) - 1

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of the word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Rows of an Arrow batch sent to a Python worker at most. Texts can be long, so batches are short; long rows
#: are bounded by Spark's own limit on an Arrow batch's bytes.
BATCH_ROWS = 400
#: Bytes of text that one vectorised step works on at a time.
STEP_BYTES = 1 << 21


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of each Arrow batch of this session, to one number for all operators: frames are
    lazy, so the order in which they are built must not matter. A lower bound of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; document i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> list[tuple[int, int]]:
    """Cut documents into consecutive runs of about ``most`` bytes (one long document is a run)."""
    out, first = [], 0
    n = len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        out.append((first, last))
        first = last
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.ones(size, dtype=U64)
            done, step = 1, b & MASK
            while done < size:  # p[done:2 done] = p[:done] * b**done
                p[done: 2 * done] = p[:done] * U64(step)
                done *= 2
                step = step * step & MASK
            both.append(p)
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, with a leading zero."""
    p, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values.astype(U64, copy=False) * p[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end], independent of where the range stands."""
    _, inv = powers(base, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACE_WORD):
    """(starts, ends, word_offsets): byte ranges of the words and, by document, their index range."""
    n_docs = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(n_docs + 1, np.int64)
    w = is_word[data]
    before = np.empty(len(w), bool)
    before[0] = False
    before[1:] = w[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(len(w), bool)
    after[-1] = False
    after[:-1] = w[1:]
    inner = cuts[cuts > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACE_WORD):
    """(hashes, starts, ends, word_offsets) of the words of some documents."""
    starts, ends, at = word_spans(data, offsets, is_word)
    if not len(starts):
        return np.zeros(0, U64), starts, ends, at
    return range_hash(prefix_hash(data, BASE), starts, ends, BASE), starts, ends, at


def window_hashes(words: np.ndarray, at: np.ndarray, k: int):
    """Hashes of all windows of k consecutive words inside one document.

    Returns (hashes, index of the first word, window_offsets by document)."""
    n = np.maximum(0, np.diff(at) - k + 1)
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    if not offsets[-1]:
        return np.zeros(0, U64), np.zeros(0, np.int64), offsets
    first = np.arange(offsets[-1]) + np.repeat(at[:-1] - offsets[:-1], n)
    g = prefix_hash(words, WORD_BASE)
    return range_hash(g, first, first + k, WORD_BASE), first, offsets


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over a[i:i + width], for every full window."""
    have = 1
    while have * 2 <= width:
        a = pick(a[:-have], a[have:])
        have *= 2
    rest = width - have
    return pick(a[:-rest], a[rest:]) if rest else a


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def remainder(id_col, modulus: int):
    """crc32 of the id as text, modulo a number: the fold rule of the held-out queries."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)
