"""Toxicity: a linear classifier on character n-grams that are scaled by their naive Bayes log-count ratios.

How often a labelled text of either class holds an n-gram gives the n-gram's log-count ratio.  A text is the set of its
n-grams, each with its ratio as value; a logistic regression on these values is the model.  So an n-gram that marks one
class counts much from the start, and the regression settles what several of them in a text say together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatloom.llm.blocks import written
from repeatloom.llm.quality import Training as Updates
from repeatloom.llm.quality import _logistic, ftrl, training_sample
from repeatloom.llm.rows import map_texts, quoted

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Characters of a text whose n-grams are made at once.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Training:
    """``sample``: bound of labelled rows that the model is fitted on; ``bits``: size of the hashed space;
    ``sizes``: lengths of the n-grams; ``smoothing``: documents without a sign that each n-gram gets, dealt to the
    classes by their size, so that an unseen n-gram has ratio 0; ``least``: smallest ratio, by amount, of an n-gram
    that the regression sees; ``passes``, ``rate``, ``l1``: of the regression."""

    sample: int = 12_000
    bits: int = 20
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    smoothing: float = 10.0
    least: float = 1.0
    passes: int = 4
    rate: float = 0.3
    l1: float = 0.05


@dataclass(frozen=True)
class Model:
    """Weight of each n-gram (ratio times regression weight) and the intercept."""

    weights: np.ndarray
    intercept: float


def ngrams(text: bytes | None, how: Training, worth: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct numbers of the hashed n-grams of the whole lower-cased text, a space on either side.

    With ``worth``, only those whose entry there isn't 0.
    """
    if not text:
        return np.zeros(0, np.int64)
    chars = np.frombuffer(f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    longest, found = max(how.sizes), [np.zeros(0, np.int64)]
    for begin in range(0, len(chars), CHUNK):
        part = chars[begin:begin + CHUNK + longest - 1].astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(part), np.uint64)
        for size in range(1, min(longest, len(part)) + 1):
            h = h[:len(part) - size + 1] * _BASE + part[size - 1:]
            if size in how.sizes:
                g = h[:CHUNK]
                at = (((g ^ (g >> np.uint64(29))) * _MIX) >> np.uint64(64 - how.bits)).astype(np.int64)
                found.append(np.unique(at) if worth is None else np.unique(at[worth[at] != 0]))
    return np.unique(np.concatenate(found))


def log_ratios(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int, how: Training) -> np.ndarray:
    """Log-count ratio of each n-gram from the numbers of documents of either class that hold it; 0 below ``least``."""
    total = n_positive + n_negative
    if not n_positive or not n_negative:
        return np.zeros(len(positive))
    up, down = how.smoothing * n_positive / total, how.smoothing * n_negative / total
    r = np.log((positive + up) / (negative + down)) - np.log(n_positive / n_negative)
    return np.where(np.abs(r) >= how.least, r, 0.0)


def regression(rows: list[tuple[np.ndarray, int]], ratios: np.ndarray, how: Training) -> Model:
    """Fits the logistic regression on rows of n-gram numbers, in the given order."""
    updates = Updates(bits=how.bits, alpha=how.rate, l1=how.l1, l2=0.01, passes=how.passes)
    w, bias = ftrl([(at, ratios[at], label) for at, label in rows], updates)
    return Model((w * ratios).astype(np.float32), bias)


def probability(at: np.ndarray, model: Model) -> float:
    """Of class 1, from a text's n-grams."""
    if model.intercept == -np.inf:
        return 0.0
    return float(_logistic(float(model.weights[at].sum(dtype=np.float64)) + model.intercept))


def _sample(docs: DataFrame, labels: DataFrame, how: Training, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``key, text, label`` of the sample, one row for each id (of several texts the smallest), in few partitions."""
    chosen = F.broadcast(training_sample(labels, id_col, label_col, how.sample))
    return (
        docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")).join(chosen, "_id")
        .groupBy("_id").agg(F.min("_text").alias("text"), F.min("_label").alias("label"))
        .select(F.col("_id").cast("string").alias("key"), "text", "label").coalesce(max(1, how.sample // 2048)))


def _document_counts(how: Training):
    """``at, up, down``: documents of either class that hold an n-gram; ``at`` -1 for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << how.bits) + 1), np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").cast(pa.large_binary()), batch.column("label").to_pylist()):
                counts[label, ngrams(text.as_py(), how)] += 1
                counts[label, -1] += 1
        at = np.flatnonzero(counts.sum(0))
        number = np.where(at == 1 << how.bits, -1, at)
        for begin in range(0, len(at), CHUNK):
            some = slice(begin, begin + CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[some]), pa.array(counts[1, at[some]]), pa.array(counts[0, at[some]])],
                names=["at", "up", "down"])
    return run


def train(
    docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fits the model on at most ``how.sample`` labelled rows that aren't held out.

    The sample is written to the shared folder.  Its document counts are summed by Spark; what comes to the driver are
    the ratios that aren't 0, at most 2 ** ``how.bits`` numbers.  A text's n-grams with such a ratio then go to one
    task, which takes them through the updates in a fixed order.  Without labelled rows nothing is known to be of
    class 1, and every score is 0.
    """
    sample = written(_sample(docs, labels, how, id_col, text_col, label_col), "labelled")
    counts = written(
        sample.select("text", "label").mapInArrow(_document_counts(how), "at long, up long, down long")
        .groupBy("at").agg(F.sum("up").alias("up"), F.sum("down").alias("down")), "ngram-counts")
    total = counts.where("at < 0").first()
    size = 1 << how.bits
    if total is None:
        return Model(np.zeros(size, np.float32), -np.inf)
    ratios = np.zeros(size)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, up, down = (c.to_numpy() for c in batch.columns)
            r = log_ratios(up, down, total.up, total.down, how)
            yield pa.RecordBatch.from_arrays([pa.array(at[r != 0]), pa.array(r[r != 0])], names=["at", "ratio"])

    for r in counts.where("at >= 0").mapInArrow(rated, "at long, ratio double").toLocalIterator():
        ratios[r.at] = r.ratio
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def start():
        def each(key, text, label):
            yield label, crc32(key), key.decode(), ngrams(text, how, sent.value).astype(np.int32)
        return each

    vectors = map_texts(sample, ["key", "text", "label"], T.StructType([
        T.StructField("label", T.IntegerType()), T.StructField("turn", T.LongType()),
        T.StructField("key", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]), start)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(turn, key, at.values.to_numpy().astype(np.int64), label)
                for b in batches for label, turn, key, at in zip(
                    b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3))]
        rows.sort(key=lambda r: r[:2])
        model = regression([r[2:] for r in rows], sent.value, how)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(model.weights[at].astype(float), model.intercept))],
            names=["at", "w"])

    weights, intercept = np.zeros(size, np.float32), 0.0
    for r in vectors.repartition(1).mapInArrow(fit, "at long, w double").toLocalIterator():
        if r.at < 0:
            intercept = r.w
        else:
            weights[r.at] = r.w
    sent.destroy()
    return Model(weights, intercept)


def score(
    docs: DataFrame, model: Model, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col, score``: probability of label 1 for every row.

    Null and empty texts score by the intercept.  Null ids stay null, repeated rows are scored each, an empty table
    gives no rows; columns other than the two named aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = sent.value

        def each(key, text):
            yield key, probability(ngrams(text, how, known.weights), known)
        return each

    return map_texts(docs, [id_col, text_col], T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]), start)
