import pytest
from pyspark.sql import types as T

#: Columns that the operators use inside, to clash with, in both cases.
CLASHING = ("id", "BLOCK", "segment", "label", "score", "entry", "site", "k1", "bin", "codes", "words", "_gone", "gone", "_Row")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while twenty three old ships sail past the quiet harbour at dawn " * 3
ROWS = [
    (1, None, "s1"), (2, "", "s1"), (3, " \n\t ", None), (4, LONG, "s1"), (5, BASE, "s2"), (6, BASE, "s2"),
    (6, BASE, "s2"), (7, BASE + "and one more", "s2"), (8, BASE.upper(), "s2"), (9, "one two", "s1"),
    (10, "é日本 语 x's  12-3\n\nb", "s1"), (None, "nobody's own text of a few words", None),
    (11, "Header line\nown eleven\nHeader line", "s3"), (12, "Header line\n  own twelve", "s3"),
    (13, "Header line \nown thirteen", "s3"), (14, "Header line\nown fourteen", "s3"),
    (15, "Header line\nown fifteen", "s3"), (16, "Header line", "s3"), (17, LONG + " tail", "s4"),
    (18, "x" * 70_000, "s4"), (19, "Released under the MIT License. The Apache License, Version 2.0; mit license", "s4"),
]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING])


def frame(spark, rows, parts=3):
    full = [(i, t, None if i == 5 else "en", s, len(t or ""), *("c" for _ in CLASHING)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
