"""A corpus pipeline over ``documents``: five stages, each one operator of ``fleetlens.llm``.

1. language_id: documents without a recognisable language go; a missing language is filled in.
2. near_dedup: of each group of near duplicates (five words, similarity 0.8 or more) the smallest id stays.
3. substring_dedup: words of passages of 13 words or more that stand in a document with a smaller id go.
4. decontamination: documents that hold a benchmark item (80 % of its runs of five words) go.
5. byte_bpe: the remaining texts are encoded and decoded again.

Near duplicates and benchmark items are judged row by row: rows with other texts under the same id, rows
without an id and repeated rows are told apart by a number that each row gets when the stage's
input is written (``numbered``; a column of the user's may have any name). In stage 3 a document is an id with
a text, and rows that repeat both stand together. "Smaller id" means the smaller id, then
the smaller row number; a null id stands after all ids.

Every stage works on all that the one before it kept. All but the last return
the columns of ``documents``; ``run`` writes each stage as a Parquet table in
the shared folder and reads it again. No stage can be put in SQL as a whole (the
first and the last can't), so ORACLE_SQL is None and tests compare the result
with a brute-force pipeline.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, decontaminate, language_id, near_dedup, substring_dedup
from fleetlens.session import ship_package, stored

THRESHOLD = 80


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written once, with a number for each row; and the column that holds it."""
    row = "row"
    while row in docs.columns:
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id())), row


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language_id.label_documents(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs, row = numbered(docs)
    judged = near_dedup.near_duplicates(docs, THRESHOLD, id_col=row).where("n_shingles > 0")
    judged = judged.select(F.col("doc_id").alias("gone"), "component_id")
    ids = docs.select(F.col(row).alias("gone"), F.col("doc_id").cast("bigint").alias("id"))
    judged = stored(judged.join(ids, "gone"))
    first = judged.groupBy("component_id").agg(F.min(F.struct(F.isnull("id"), "id", "gone"))["gone"].alias("gone"))
    gone = judged.select("gone").join(first, "gone", "left_anti")
    return docs.join(gone, docs[row] == gone["gone"], "left_anti").drop(row)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    out = substring_dedup.rewrite_documents(docs, apart=True)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    docs, row = numbered(docs)
    found = decontaminate.contaminated(docs, items, id_col=row).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(found, docs[row] == found["gone"], "left_anti").drop(row)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", identify_languages), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_passages),
          ("decontamination", decontaminate_documents), ("byte_bpe", encode_documents)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
