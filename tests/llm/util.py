"""Fixtures of the corpus operators' tests: a small table with every awkward row."""

import re

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Small documents with null ids, texts and sources, empty and very long texts, repeated rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = ("lorem ipsum dolor sit amet " * 8000).strip()
    rows = [
        (None, "no id at all, but words enough to count", "en", "src1", 1), (100_001, None, None, None, None), (100_002, "", "en", "", 0), (100_003, long, "en", "src0", len(long)),
        (100_004, "twice the same row", "en", "src0", 18), (100_004, "twice the same row", "en", "src0", 18), (100_004, "the id once more, another text", "en", "src0", 30),
        (100_005, "\n\n \t\n", "de", "src2", 5), (100_006, "é\x0bü\x1cß   x", "fr", "src2", 9), (100_007, "a" * 30_000, None, "src2", 30_000),
    ]
    return docs.unionByName(spark.createDataFrame(rows, SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crowded(docs):
    """Extra columns with names that operators use themselves."""
    names = ["size", "score", "n", "mark", "keys", "kept", "ids", "n_words", "n_lines", "slot", "h", "k", "a", "b", "drop", "out", "bucket", "fingerprint", "decoded"]
    return docs.withColumns({c: F.lit("x") for c in names})


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
