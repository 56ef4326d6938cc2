"""Shared k-mers: frequencies, similar pairs, degrees and groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from repeatloom.functions import scans, wordsets
from repeatloom.functions.motifs import let
from repeatloom.functions.scalars import revcomp
from repeatloom.operators.durable import cut, stored


def kmer_list(seq: Column, k: int) -> Column:
    """All k-mers of a text in order; empty for shorter texts."""
    n = F.length(seq)
    words = let(seq.cast("binary"), lambda raw: F.transform(
        F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(raw, i, k).cast("string")))
    return F.when(n >= k, words).otherwise(F.array().cast("array<string>"))


def kmer_set(seq: Column, k: int) -> Column:
    """Distinct k-mers of both strands."""
    return F.array_union(kmer_list(seq, k), kmer_list(revcomp(seq), k))


def document_frequency(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Per k-mer: number of sequences with it, and occurrences.

    Tasks count the words of whole Arrow batches and send each word once per batch, or once at all where a table of
    all words is small; Spark sums.
    """
    counted = df.select(F.col(seq).cast("string")).mapInArrow(scans.word_counts(k), scans.WORD_COUNTS)
    return counted.groupBy("kmer").agg(F.sum("n_seqs").alias("n_seqs"), F.sum("n_total").alias("n_total"))


def _text_key(seq: Column) -> Column:
    """Same for a text and for its reverse complement."""
    return F.sha2(F.least(seq, revcomp(seq)), 256)


def distinct_sets(df: DataFrame, k: int, min_len: int, seq: str = "seq", by: str = "id") -> DataFrame:
    """One row per distinct text with its smallest id, its copies and the length of its k-mers.

    Copies of a text, in either direction, become one row before any k-mer is made.
    """
    texts = df.where((F.length(seq) >= min_len) & (F.length(seq) >= k)).select(
        by, F.col(seq).alias("seq"), _text_key(F.col(seq)).alias("set_key"))
    return stored(texts.groupBy("set_key").agg(
        F.min(by).alias("rep"), F.count("*").alias("copies"), F.any_value("seq").alias("seq")), "texts").withColumn(
        "k", F.lit(k))


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct sets whose overlap is a ``threshold`` share of the smaller.

    Exact.  Every pair of texts is counted, so time grows with the square of the input, but no k-mer and no pair that
    stays below the threshold is ever a row: blocks of texts meet each other, and a task counts what two of them share.
    Words over A, C, G, T and N of up to 27 letters are numbered; others are compared as 64-bit hashes.
    """
    total = sets.agg(F.sum(F.length("seq")).alias("n"), F.max("k").alias("k"),
                     F.bool_or(F.col("seq").rlike("[^ACGTN]")).alias("other")).first()
    k, plain = total["k"] or 1, not total["other"] and (total["k"] or 1) <= wordsets.LONGEST_NUMBERED
    letters = total["n"] or 0
    n_blocks = max(1, -(-letters // wordsets.BLOCK), min(8, letters >> 17))
    rep = sets.schema["rep"].dataType.simpleString()
    block = f"block long, reps array<{rep}>, lengths array<int>, sizes array<int>, n_bytes long, letters binary"
    blocks = stored(sets.select("rep", "seq").repartition(n_blocks).mapInArrow(
        wordsets.packed(_arrow(block), k, plain, wordsets.BLOCK), block), "blocks")
    side = lambda x: blocks.select(*[F.col(c).alias(f"{x}_{c}") for c in blocks.columns])
    pair = f"x {rep}, y {rep}, nx int, ny int, shared int"
    found = (
        side("x").join(side("y").hint("shuffle_replicate_nl"), F.col("x_block") <= F.col("y_block"))
        .mapInArrow(wordsets.shared(_arrow(pair), k, plain, threshold), pair))
    first = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    return stored(found, "pairs").select(
        F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"),
        "shared", (F.col("shared") / F.least("nx", "ny")).alias("overlap"))


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def degrees(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of similar partners of each distinct set, copies counted."""
    size = sets.select("rep", "copies")
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    partners = (
        ends.join(size.select(F.col("rep").alias("other"), "copies"), "other")
        .groupBy("rep").agg(F.sum("copies").alias("_p")))
    return size.join(partners, "rep", "left").select(
        "rep", "copies", (F.coalesce("_p", F.lit(0)) + F.col("copies") - 1).alias("degree"))


def components(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Connected groups: ``rep, label`` with the smallest member as the label.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so long chains collapse in a few rounds.  Every round is cut
    with a reliable checkpoint.
    """
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = cut(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    labels = cut(vertices.select("rep", F.col("rep").alias("label")))
    while True:
        best = (
            edges.join(labels.withColumnRenamed("rep", "src"), "src")
            .groupBy(F.col("dst").alias("rep")).agg(F.min("label").alias("_m")))
        lowered = labels.join(best, "rep", "left").select(
            "rep", F.col("label").alias("old"), F.least("label", "_m").alias("label"))
        jump = lowered.select(F.col("rep").alias("label"), F.col("label").alias("_up"))
        moved = cut(lowered.join(jump, "label").select("rep", "old", F.col("_up").alias("label")))
        labels = moved.select("rep", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def group_sizes(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Size of each group, copies counted."""
    return (
        labels.join(sets.select("rep", "copies"), "rep")
        .groupBy("label").agg(F.sum("copies").alias("size")))


def size_statistics(sizes: DataFrame) -> DataFrame:
    """Singletons, groups of at least 3 and 10, and the largest one."""
    s = F.col("size")
    return sizes.agg(
        F.count("*").alias("n_groups"),
        F.count_if(s == 1).alias("n_singletons"),
        F.count_if(s >= 3).alias("n_ge3"),
        F.count_if(s >= 10).alias("n_ge10"),
        F.max(s).alias("largest"),
    )


def members(df: DataFrame, k: int, min_len: int, seq: str = "seq", by: str = "id") -> DataFrame:
    """Which distinct text each sequence has."""
    return df.where((F.length(seq) >= min_len) & (F.length(seq) >= k)).select(
        by, _text_key(F.col(seq)).alias("set_key"))
