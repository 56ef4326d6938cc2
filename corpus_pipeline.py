"""From raw documents to token ids: five stages, each on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatloom.llm import byte_bpe, decontaminate, line_dedup, quality, shingle_join
from repeatloom.llm.queries import rank_file, table
from repeatloom.operators.durable import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on a bounded sample of the labels, doesn't reject."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that more than a tenth of their source's distinct texts, and ``MIN_PAGES`` at least, share.

    Copies go in a later stage; here they count once, so that the one that stays keeps its lines.  ``n_chars`` follows
    the text.
    """
    return line_dedup.drop_boilerplate(docs, copies_once=True).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are alike to 0.8 or more."""
    return shingle_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def _ids(ids: str, decoded: bytes) -> tuple[np.ndarray, str]:
    return np.array(ids.split(",") if ids else [], np.int32), decoded.decode("utf-8", "replace")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the text decoded from them."""
    return byte_bpe.encoded(
        docs, rank_file(), public_tokenizers.PATTERN, describe=_ids,
        fields=[T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line_dedup", drop_site_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", tokenise),
]

#: SQL can express neither the trained classifier nor the merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
