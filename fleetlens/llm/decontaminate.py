"""Benchmark decontamination: short test items inside long documents.

Size-partitioned MinHash containment search, in DataFrame functions only.

* An item's set holds its distinct runs of ``WIDTH`` words (lower case, letters
  and digits); an item of fewer words is one run, its whole word sequence. Items are partitioned by
  the power of two below their set size.
* An item is indexed under its smallest shingle hashes, a bottom-k MinHash: as many as it may
  lack and one more, so that a document that holds ``CONTAINMENT`` percent of the item holds one of
  them; at most ``SKETCH``. Up to 79 shingles no item is missed; beyond that an item that is at
  least 80 % contained is missed with probability below 0.2**16 = 7e-12.
* The largest indexed hash of a size partition is its threshold: the index of large items holds only
  their very small hashes, whatever the length of a document. A document's hash probes the partitions
  whose threshold it does not pass, and those alone, by partition and hash. Before that a bitmap of
  the index (``BITS`` bits at most, a constant of the plan) drops nearly all hashes that are in no sketch.
* Candidates are verified on the shingle texts: an item is found in a document
  that holds at least ``CONTAINMENT`` percent of the item's shingles.

The document side streams: words, hashes and the filters are array
expressions of one projection, only kept hashes become rows. The index, the
items' shingles and the candidates are written as tables first, so Spark knows
their sizes: it broadcasts them under ``spark.sql.autoBroadcastJoinThreshold``,
so that documents don't move, and shuffles beyond it.

Defined results: null and empty texts, and items without a word, match nothing. Rows that
share an id are one document (or item) with the runs of all of them. A row without an id is a
document (or item) of its own, told by its text: equal texts without an id are told once. Columns of other
names are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

WIDTH = 5
SKETCH = 16
CONTAINMENT = 80
#: Bits of the bitmap: 32 for each indexed hash, within these bounds.
LEAST_BITS, BITS = 1 << 12, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "")


def _widths(items: DataFrame) -> list[int]:
    """``WIDTH`` and the numbers of words of shorter items (at most ``WIDTH`` numbers)."""
    n = items.select(F.size(_words(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < WIDTH)).distinct()
    return sorted({r.n for r in n.collect()} | {WIDTH})


def _starts(width: int, first: int, whole: bool) -> Column:
    """Places at which a run of so many words of ``w`` starts; none in a text that is short. ``whole``: shorter
    runs only where they are the whole text."""
    fits = F.size("w") == width if whole and width < WIDTH else F.size("w") >= width
    return F.when(fits, F.sequence(F.lit(first), F.size("w") - width + first)).otherwise(F.array().cast("array<int>"))


def _runs(rows: DataFrame, widths: list[int], *keep: str, whole: bool = False) -> DataFrame:
    """(*keep, runs): the hashes of all runs of words of the column ``text``."""
    words = rows.select(*keep, F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    words = words.where(F.size("w") >= min(widths))
    hashed = lambda n: lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(n)))
    runs = [F.transform(_starts(n, 0, whole), hashed(n)) for n in widths]
    return words.select(*keep, (F.concat(*runs) if len(runs) > 1 else runs[0]).alias("runs"))


def _texts(rows: DataFrame, widths: list[int], *keep: str, whole: bool = False) -> DataFrame:
    """(*keep, shingle): the distinct runs of words themselves, one a row."""
    words = rows.select(*keep, _words(F.col("text")).alias("w")).where(F.size("w") >= min(widths))
    joined = lambda n: lambda i: F.concat_ws(" ", F.slice(F.col("w"), i, n))
    runs = [F.transform(_starts(n, 1, whole), joined(n)) for n in widths]
    return words.select(*keep, F.explode(F.array_distinct(F.concat(*runs) if len(runs) > 1 else runs[0])).alias("shingle")).distinct()


def _named(rows: DataFrame, id_col: str, name: str, text_col: str) -> DataFrame:
    """(name, text): rows with an id are named by it, others by their text."""
    text = rows[text_col].cast("string")
    own = F.concat(F.lit("#"), F.md5(text.cast("binary")))
    return rows.select(F.coalesce(rows[id_col].cast("bigint").cast("string"), own).alias(name), text.alias("text")).where("text IS NOT NULL")


def _id(name: str) -> Column:
    """The id behind a name; null for a row that has none."""
    return F.when(~F.col(name).startswith("#"), F.col(name).cast("bigint"))


def index(items: DataFrame, widths: list[int], containment: int = CONTAINMENT) -> DataFrame:
    """(item, hash, part, threshold) of (item, text): the partitioned bottom-k sketches."""
    sets = _runs(items, widths, "item", whole=True).select("item", F.explode("runs").alias("hash")).distinct()
    sizes = sets.groupBy("item").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("hash"))
    low = sets.withColumn("rank", rank).where(F.col("rank") <= SKETCH)
    lacks = F.col("n") - F.ceil(F.col("n") * F.lit(containment) / 100)
    sketch = low.join(sizes, "item").where(F.col("rank") <= lacks + 1).select("item", "hash", F.floor(F.log2("n")).cast("int").alias("part"))
    bounds = sketch.groupBy("part").agg(F.max("hash").alias("threshold"))
    return sketch.join(bounds, "part").select("item", "hash", "part", "threshold")


def _bitmap(sketches: DataFrame) -> tuple[Column, int]:
    """(words of 64 bits as a constant, their number): bit h modulo the bits of every indexed hash."""
    n = sketches.count()
    bits = min(BITS, max(LEAST_BITS, 1 << int(32 * n).bit_length()))
    bit = F.pmod("hash", F.lit(bits))
    got = sketches.select(F.floor(bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int")).alias("mask"))
    words = {r.word: r.mask for r in got.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()}  # BITS / 64 rows at most
    text = ",".join(str(words.get(i, 0)) for i in range(bits // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>"), bits


def candidates(docs: DataFrame, sketches: DataFrame, widths: list[int]) -> DataFrame:
    """(doc, item, hits) of (doc, text): the items of which a document holds an indexed hash."""
    bounds = {r.part: r.threshold for r in sketches.select("part", "threshold").distinct().collect()}  # a row a power of two
    if not bounds:
        return docs.select("doc", F.lit("").alias("item"), F.lit(0).alias("hits")).where("false")
    words, bits = _bitmap(sketches)
    bit = lambda h: F.pmod(h, F.lit(bits))
    marked = lambda h: F.getbit(F.get(words, F.floor(bit(h) / 64).cast("int")), F.pmod(bit(h), F.lit(64)).cast("int")) == 1
    top = F.lit(max(bounds.values()))
    probes = _runs(docs, widths, "doc").select("doc", F.explode(F.filter("runs", lambda h: (h <= top) & marked(h))).alias("hash"))
    parts = F.filter(F.array(*(F.when(F.col("hash") <= F.lit(t), F.lit(p)) for p, t in sorted(bounds.items()))), lambda p: p.isNotNull())
    probes = probes.select("doc", "hash", F.explode(parts).alias("part"))
    return probes.join(sketches.select("item", "part", "hash"), ["part", "hash"]).groupBy("doc", "item").agg(F.count("*").alias("hits"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", containment: int = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) of every item found in a document."""
    docs, items = _named(docs, id_col, "doc", text_col), _named(items, item_col, "item", item_text)
    widths = _widths(items)
    sketches = stored(index(items, widths, containment))
    found = stored(candidates(docs, sketches, widths).select("doc", "item"))
    shingles = stored(_texts(items, widths, "item", whole=True))
    sizes = shingles.groupBy("item").agg(F.count("*").alias("n_item"))
    read_again = docs.join(found.select("doc").distinct(), "doc", "left_semi")
    common = _texts(read_again, widths, "doc").join(shingles, "shingle").groupBy("doc", "item").agg(F.count("*").alias("n_common"))
    out = common.join(found, ["doc", "item"], "left_semi").join(sizes, "item").where(F.col("n_common") * 100 >= F.col("n_item") * containment)
    return out.select(_id("doc").alias("doc_id"), _id("item").alias("item_id"), "n_item", "n_common",
                      (F.col("n_common") / F.col("n_item")).alias("containment"))
