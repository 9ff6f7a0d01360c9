"""Language mixtures: expectation-maximisation over n-gram likelihoods.

Training counts character trigrams (lower case, every non-letter read as a
blank) in ``BINS`` hashed bins for each language of the labelled texts. A text
is a mixture: every trigram is drawn from one of the languages, whose
proportions are fitted by EM. The language set is chosen by penalised
likelihood: languages are added in order of their proportion while the log
likelihood grows by more than half the log of the number of trigrams.

The counts are summed inside each task, then once by (language, bin): at most
``BINS * MAX_LANGUAGES`` rows, the size that is broadcast. Prediction is a scan.

A null text or one without a letter is ``und`` with score 0 and no
proportions. Rows without a language are not learned from. With nothing to
learn from, every text is ``und``. Repeated rows and null ids each get their own row. Equal proportions
go to the language that comes first by name. Texts of any length are counted whole, in pieces.
Other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import remainder, short_batches

BINS = 1 << 16
MAX_LANGUAGES = 256
ROUNDS = 12
UNDETERMINED = "und"
STEP_CHARS = 1 << 20
_LETTER: list = []


def _letter_table() -> np.ndarray:
    """Code point -> itself for letters of the basic plane, a blank for the rest."""
    if not _LETTER:
        _LETTER.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32))
    return _LETTER[0]


def trigram_bins(text: str) -> np.ndarray:
    """Bin of each trigram with a letter, in order."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(chars < 0x10000, _letter_table()[np.minimum(chars, 0xFFFF)], chars)
    blank = np.full(1, 32, np.uint32)
    chars = np.concatenate([blank, chars, blank])
    if len(chars) < 3:
        return np.zeros(0, np.uint16)
    h = chars[:-2] * np.uint32(0x9E3779B1) + chars[1:-1] * np.uint32(0x85EBCA77) + chars[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.uint16)[chars[1:-1] != 32]


def _pieces(text: str):
    """A long text in pieces that overlap by nothing but the blank at their ends."""
    for i in range(0, len(text), STEP_CHARS):
        yield text[i: i + STEP_CHARS]


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of a whole text."""
    if len(text) <= STEP_CHARS:
        b = np.sort(trigram_bins(text), kind="stable")  # 16-bit keys: a radix sort
        if not len(b):
            return b, np.zeros(0, np.float32)
        cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        return b[cut], np.diff(np.append(cut, len(b))).astype(np.float32)
    total = np.zeros(BINS, np.int64)
    for piece in _pieces(text):
        total += np.bincount(trigram_bins(piece), minlength=BINS)
    bins = np.flatnonzero(total)
    return bins.astype(np.uint16), total[bins].astype(np.float32)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """language -> trigram probabilities, from the rows that have a language."""
    short_batches(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(BINS, np.int64)
                for piece in _pieces(text):
                    sums[lang] += np.bincount(trigram_bins(piece), minlength=BINS)
        for lang, c in sums.items():
            bins = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins.astype(np.int64)),
                                              pa.array(c[bins])], names=["lang", "bin", "n"])

    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the counts would not be of bounded size")
    # at most BINS * MAX_LANGUAGES rows of integers
    table = counts.toArrow()
    langs, bins, n = (table.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    out = {}
    for lang in sorted(set(langs)):
        c = np.full(BINS, 0.5)
        c[bins[langs == lang].astype(np.int64)] += n[langs == lang]
        out[str(lang)] = c / c.sum()
    return out


def _em(p, weight, starts, doc, pi, rounds):
    """Proportions and log likelihood of documents, all at once.

    p: (features, languages); weight: counts; doc: owner of each feature."""
    total = np.add.reduceat(weight, starts)
    mass = None
    for _ in range(rounds):
        part = p * pi[doc]
        mass = part.sum(1)
        part *= (weight / np.maximum(mass, 1e-30))[:, None]
        pi = np.add.reduceat(part, starts, axis=0) / total[:, None]
    mass = np.einsum("ij,ij->i", p, pi[doc])
    return pi, np.add.reduceat(weight * np.log(np.maximum(mass, 1e-30)), starts)


def mixtures(texts: list[str], probs: np.ndarray) -> list[list[tuple[int, float]]]:
    """Per text the chosen (language index, proportion), largest first; empty without a trigram."""
    n_lang = probs.shape[1]
    counted = [_counted(t) for t in texts]
    out: list[list[tuple[int, float]]] = [[] for _ in texts]
    live = [i for i, (b, _) in enumerate(counted) if len(b)]
    if not live:
        return out
    bins = np.concatenate([counted[i][0] for i in live])
    weight = np.concatenate([counted[i][1] for i in live])
    sizes = np.array([len(counted[i][0]) for i in live])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(live)), sizes)
    p = probs[bins]
    pi, _ = _em(p, weight, starts, doc, np.full((len(live), n_lang), 1.0 / n_lang, np.float32), ROUNDS)
    order = np.argsort(-pi, axis=1, kind="stable")
    penalty = 0.5 * np.log(np.maximum(np.add.reduceat(weight, starts), 2.0))
    every = np.arange(len(live))
    best = np.zeros((len(live), n_lang), np.float32)
    best[every, order[:, 0]] = 1.0
    like = np.add.reduceat(weight * np.log(np.maximum(p[np.arange(len(p)), order[doc, 0]], 1e-30)), starts)
    growing = every
    for k in range(2, n_lang + 1):  # only documents whose last language was worth its penalty go on
        growing = growing[pi[growing, order[growing, k - 1]] * np.add.reduceat(weight, starts)[growing] >= 1.0]
        if not len(growing):
            break
        pick = np.isin(doc, growing)
        own = np.searchsorted(growing, doc[pick])
        first = np.concatenate([[0], np.cumsum(sizes[growing])[:-1]])
        allowed = np.zeros((len(growing), n_lang), np.float32)
        for j in range(k):
            allowed[np.arange(len(growing)), order[growing, j]] = pi[growing, order[growing, j]] + 1e-3
        allowed /= allowed.sum(1, keepdims=True)
        got, new = _em(p[pick], weight[pick], first, own, allowed, ROUNDS // 2)
        better = new - like[growing] > penalty[growing]
        growing, got, new = growing[better], got[better], new[better]
        best[growing], like[growing] = got, new
    for j, i in enumerate(live):
        langs = np.argsort(-best[j], kind="stable")
        out[i] = [(int(x), float(best[j, x])) for x in langs if best[j, x] > 0]
    return out


def identify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture) of every text; score is the proportion of lang_pred."""
    spark = docs.sparkSession
    short_batches(spark)
    names = list(model)
    probs = spark.sparkContext.broadcast(np.stack([model[x] for x in names], axis=1).astype(np.float32) if names else None)

    def predict(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            texts = [t if any(map(str.isalpha, t)) else "" for t in texts]
            got = mixtures(texts, probs.value) if names else [[] for _ in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([names[m[0][0]] if m else UNDETERMINED for m in got], pa.string()),
                 pa.array([min(1.0, m[0][1]) if m else 0.0 for m in got], pa.float64()),
                 pa.array([[(names[x], w) for x, w in m] for m in got], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "mixture"])

    src = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(predict, "doc_id bigint, lang_pred string, score double, mixture map<string,double>")


def label_documents(docs: DataFrame, model: dict[str, np.ndarray], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents whose language can be told, all columns; a null language becomes the predicted one.

    Documents that are ``und`` (null text, or no letter) are rejected. A scan."""
    spark = docs.sparkSession
    short_batches(spark)
    names = list(model)
    probs = spark.sparkContext.broadcast(np.stack([model[x] for x in names], axis=1).astype(np.float32) if names else None)
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        for batch in batches:
            texts = [t if t and any(map(str.isalpha, t)) else "" for t in batch.column(at_text).to_pylist()]
            got = mixtures(texts, probs.value) if names else [[] for _ in texts]
            known = batch.column(at_lang)
            told = [x if x is not None else names[m[0][0]] if m else None for x, m in zip(known.to_pylist(), got)]
            batch = batch.set_column(at_lang, batch.schema.field(at_lang), pa.array(told, known.type))
            yield batch.filter(pa.array([bool(m) if names else bool(t) for m, t in zip(got, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out_prediction(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all of them."""
    model = train(docs.where(F.coalesce(remainder("doc_id", 4), F.lit(0)) != 2))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred",
                      "score", "mixture")


