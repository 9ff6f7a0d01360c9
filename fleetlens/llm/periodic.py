"""Periodic runs of words: seeds on diagonals, extended to maximal repetitions.

A run is a stretch of one document's words that repeats with its smallest period q,
holds at least ``TIMES`` periods and ``LEAST`` words, and can't be made longer. On the
diagonal of lag q (word i against word i + q) a run is a stretch of equal pairs, at
least ``overlap`` of them whatever q is.

* Seeds: the grams of that many words are indexed by document. Every pair of equal
  grams is a seed on the diagonal of its lag, so no run is without one.
* Pairs are enumerated nearest first: in step s every gram meets its s-th next occurrence,
  all grams of a document at once. Lags over a third of the document can't hold a
  run. A seed whose words don't also repeat one lag before or after is none.
* What a found run makes needless is not enumerated. From the second period of a run
  (q, s, e) on, a pair whose second gram starts before e - q has no run of a longer
  period (it would share a stretch of both periods with this one, so their
  greatest common divisor would be a period of both). And the inner grams of a run
  of a period up to half a gram are not paired over long lags: a longer period
  that holds such a run repeats its first or last gram, and these are paired. So a text
  of one word, or of one line, costs a step or two, not a pair for every two places.
* A seed is extended both ways as far as its diagonal goes. A table by lag holds how far
  that diagonal is covered, and seeds below it are dropped.
* Stretches with the same ends belong to one run, its period is the smallest lag.

Words are compared by numbers that a dictionary of the batch gives them (equal numbers,
equal words); hashes only find seeds. Documents are independent: a scan without a shuffle.
One document must fit a worker.

Defined results: a null or empty text has no words and no run. A null id has no checksum,
so the query leaves its text unchanged; repeated rows and ids each get their row. Texts
of any length are worked whole; ties in the greatest length / period go to the smallest start,
then the smallest period. Other columns, whatever their names, are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACE_WORD, U64, mix, steps, text_bytes, window_hashes, word_spans

LEAST = 24
TIMES = 3


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """Equal pairs on its diagonal that a run of any period has."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = np.ascontiguousarray(data[SPACE_WORD[data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy()


class Diagonals:
    """The diagonals of one document: seeds in, maximal stretches out."""

    def __init__(self, w: np.ndarray, least: int, times: int):
        self.w, self.least, self.times = w, least, times
        self.runs: dict[tuple[int, int], int] = {}

    def _end(self, i: int, lag: int) -> int:
        """The first place from i on that differs from the word a lag ahead."""
        w, n, step = self.w, len(self.w) - lag, 64
        while i < n:
            stop = min(n, i + step)
            differ = w[i:stop] != w[i + lag: stop + lag]
            if differ.any():
                return i + int(differ.argmax())
            i, step = stop, step * 4
        return n

    def _begin(self, i: int, lag: int) -> int:
        """The first place of the stretch of equal pairs that ends before i."""
        w, step = self.w, 64
        while i > 0:
            stop = max(0, i - step)
            differ = w[stop:i] != w[stop + lag: i + lag]
            if differ.any():
                return i - int(differ[::-1].argmax())
            i, step = stop, step * 4
        return 0

    def likely(self, i: np.ndarray, lag: np.ndarray, k: int) -> np.ndarray:
        """Seeds (i, i + lag) that a run can hold: each of their words stands once more, a lag before or after."""
        if self.times < 3:
            return np.ones(len(i), bool)
        w, n = self.w, len(self.w)
        ok = np.ones(len(i), bool)
        for d in (0, k - 1, *range(1, k - 1)):
            a, q = i[ok] + d, lag[ok]
            after = a + 2 * q
            here = w[a]
            ok[ok] = ((after < n) & (w[np.minimum(after, n - 1)] == here)) | ((a >= q) & (w[np.maximum(a - q, 0)] == here))
            if not ok.any():
                break
        return ok

    def extend(self, i: np.ndarray, lag: np.ndarray) -> None:
        """All seeds at once, so that each diagonal is walked from left to right."""
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        cut = np.flatnonzero(np.concatenate([[True], lag[1:] != lag[:-1]])) if len(lag) else []
        covered: dict[int, int] = {}
        for a, b in zip(cut, np.append(cut, len(lag))[1:]):
            q, places = int(lag[a]), i[a:b]
            covered[q] = 0
            t = 0
            while t < len(places):
                s, e = self._begin(int(places[t]), q), self._end(int(places[t]), q)
                covered[q] = e
                if e + q - s >= max(self.least, self.times * q):
                    known = self.runs.get((s, e + q))
                    self.runs[s, e + q] = q if known is None else min(known, q)
                t = int(np.searchsorted(places, covered[q]))


def _classes(h: np.ndarray, chosen: np.ndarray):
    """(places, class ends): the chosen places by gram, ascending, and for each where its gram's places end."""
    order = chosen[np.argsort(h[chosen], kind="stable")]
    g = h[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(g)))
    return order, np.repeat(new + sizes, sizes), np.repeat(np.arange(len(new)), sizes)


def document_runs(w: np.ndarray, h: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one document, by start, then period.

    w: numbers of its words; h: hashes of its grams of ``overlap`` words."""
    n, k = len(w), overlap(least, times)
    most = n // times
    d = Diagonals(w, least, times)
    near = least  # lags up to here are enumerated without exception
    places, ends, _ = _classes(h, np.arange(len(h)))
    now = np.arange(len(places))
    found_i, found_lag = [], []
    step = 0
    while len(now):
        step += 1
        now = now[now + step < ends[now]]
        lag = places[now + step] - places[now]
        go = lag <= (most if step == 1 else min(near, most))
        now, lag = now[go], lag[go]
        ok = d.likely(places[now], lag, k)
        found_i.append(places[now][ok])
        found_lag.append(lag[ok])
        if step == 1:
            now = now[lag <= near]
    i, lag = np.concatenate([np.zeros(0, np.int64), *found_i]), np.concatenate([np.zeros(0, np.int64), *found_lag])
    d.extend(i, lag)
    if most > near:
        inner = np.zeros(len(h), bool)
        until, beyond = np.zeros(len(h), np.int64), np.full(len(h), n, np.int64)
        for (s, e), q in d.runs.items():
            if 2 * q <= k:
                inner[s + 1: max(s + 1, e - k)] = True
            own = slice(s + q, max(s + q, e - k + 1))
            later = until[own] < e - q
            until[own] = np.where(later, e - q, until[own])
            beyond[own] = np.where(later, q, beyond[own])
        places, ends, number = _classes(h, np.flatnonzero(~inner))
        key = number * (n + 1) + places
        at = lambda rows, place: np.searchsorted(key, number[rows] * (n + 1) + place, side="right")
        now = np.arange(len(places))
        now = now[now + 1 < ends]
        to = at(now, places[now] + near)
        found_i, found_lag = [i], [lag]
        while len(now):
            go = to < ends[now]
            now, to = now[go], to[go]
            p = places[now]
            skip = (places[to] - p > beyond[p]) & (places[to] <= until[p])
            if skip.any():
                to[skip] = at(now[skip], until[p[skip]])
                continue
            q = places[to] - p
            go = q <= most
            now, to, p, q = now[go], to[go], p[go], q[go]
            ok = d.likely(p, q, k)
            found_i.append(p[ok])
            found_lag.append(q[ok])
            to = to + 1
        d.extend(np.concatenate(found_i), np.concatenate(found_lag))
    return sorted((s, e - s, q) for (s, e), q in d.runs.items())


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def refold(n: int, h: int) -> np.ndarray:
    """Numbers of the words that the query's edit puts in place of 0 .. n - 1; h is the id's checksum."""
    i = np.arange(n)
    if h % 10 or not n:
        return i
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i >= a, a + (i - a) % p, i)


OUT = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
       "collapsed_sha256 string, n_words bigint, n_dropped bigint, collapsed string")


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text",
                  fold=None, keep_text: bool = False) -> DataFrame:
    """One row a document (``OUT``): its runs, the greatest of them, and the words without repeated periods.

    ``fold``: a Column with a checksum after which the words are repeated first (``refold``); ``keep_text``:
    also the collapsed text."""
    k = overlap(least, times)

    def run(stream):
        for batch in stream:
            ids, folds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            rows = []
            for lo, hi in steps(offsets):
                part = data[offsets[lo]: offsets[hi]]
                starts, ends, at = word_spans(part, offsets[lo: hi + 1] - offsets[lo])
                words = word_numbers(part, starts, ends) if len(starts) else np.zeros(0, np.int32)
                source = np.arange(len(words))
                for i in range(hi - lo):
                    if folds[lo + i] is not None:
                        source[at[i]: at[i + 1]] = at[i] + refold(int(at[i + 1] - at[i]), folds[lo + i])
                words = words[source]
                grams, _, gram_at = window_hashes(mix(words.astype(U64) + U64(1)), at, k)
                for i in range(hi - lo):
                    a, b = int(at[i]), int(at[i + 1])
                    h = grams[gram_at[i]: gram_at[i + 1]]
                    runs = document_runs(words[a:b], h, least, times) if b - a >= least and _repeats(h) else []
                    gone = repeated_words(b - a, runs)
                    kept = source[a:b][~gone]
                    text = b" ".join(part[x:y].tobytes() for x, y in zip(starts[kept].tolist(), ends[kept].tolist()))
                    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                    s, length, q = greatest(runs) or (None, None, None)
                    rows.append((ids[lo + i], len(runs), s, length, q, None if q is None else 1000 * length // q, hashlib.sha256(listed.encode()).hexdigest(),
                                 hashlib.sha256(text).hexdigest(), b - a, int(gone.sum()), text.decode() if keep_text else None))
            if rows:
                types = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in OUT.split(", ")])

    src = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"),
                      (F.lit(None) if fold is None else fold).cast("bigint").alias("fold"))
    return src.mapInArrow(run, OUT)


def _repeats(h: np.ndarray) -> bool:
    s = np.sort(h)
    return bool((s[1:] == s[:-1]).any())


def collapse_edited(docs: DataFrame) -> DataFrame:
    """Every document with the words of some repeated after the checksum of their id."""
    return periodic_runs(docs, fold=F.crc32(docs["doc_id"].cast("string").cast("binary"))).drop("collapsed")
