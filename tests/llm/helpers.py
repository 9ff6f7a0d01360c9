"""Frames and brute-force forms for the operator tests."""

import re

import duckdb

SF = "/root/testdata/sf0.001"
#: Cases that every operator on documents must survive: nulls, empty and long texts, repeated rows and ids.
DOCS = [(0, "Under the MIT License.\nAll rights reserved\n\nunder the mit license"), (1, None), (2, ""), (3, " \t\n "), (4, "x"),
        (5, "the end of the line " * 4000), (6, "the end of the line " * 4000), (7, "ä" * 70000), (7, "ä" * 70000),
        (8, "Ünïcode 漢字 🙂 and tabs\tand\x0bmore"), (9, "no licence at all, 12345"), (9, "another text of the same id"),
        (None, "a text without an id"), (-3, "negative id\nnegative id")]
SCHEMA = "doc_id long, text string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    """The rows with more columns, named like the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", True, [1], None) for i, t in rows],
                                 SCHEMA + ", n int, key string, bucket boolean, hashes array<int>, lang string")


def small_docs():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").df()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def key(row):
    return tuple((v is not None, v) if not isinstance(v, float) else (True, round(v, 9)) for v in row)
