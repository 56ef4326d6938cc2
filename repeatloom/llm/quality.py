"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader steps."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatloom.llm.rows import map_texts, quoted, release

#: Runs of letters, digits and non-ASCII bytes, and runs of other signs.
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Training:
    """``sample``: bound of labelled rows that the model is fitted on; ``bits``: size of the hashed space."""

    sample: int = 12_000
    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.01
    passes: int = 4


def features(text: bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs and signs of the whole text, with log counts scaled to length 1.

    All pairs of a word and the same word share one feature, whatever the word is.
    """
    tokens = _TOKEN.findall(text or b"")
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    single = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    pairs = (single[:-1] * _MIX + single[1:]) * _MIX >> np.uint64(64 - bits)
    pairs[single[:-1] == single[1:]] = 0
    index, counts = np.unique(
        np.concatenate([single * _MIX >> np.uint64(64 - bits), pairs]), return_counts=True)
    value = np.log1p(counts)
    return index.astype(np.int64), value / np.sqrt(value @ value)


def ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], how: Training) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``passes`` over the rows in the given order."""
    rows = list(rows)
    size = 1 << how.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi, penal = z[at], np.where(at == size, 0.0, how.l1)
        w = (np.sign(zi) * penal - zi) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)
        return np.where(np.abs(zi) <= penal, 0.0, w)

    for _ in range(how.passes):
        for index, value, label in rows:
            at, x = np.append(index, size), np.append(value, 1.0)
            w = weights(at)
            g = (_logistic(w @ x) - label) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids that are not held out, by hash of the id; of several labels the smallest."""
    return (
        labels.select(quoted(id_col).alias("_id"), quoted(label_col).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(bound))


def train(
    docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> tuple[np.ndarray, float]:
    """Fits the model on a bounded sample.

    The sample's ids (at most ``how.sample``) are broadcast, its texts become sparse vectors where they lie, and after
    a shuffle of these one task takes the vectors through the sequential updates.  What comes back are the weights that are not 0, at most
    2 ** ``how.bits``.  Without labels all weights are 0 and each score is 0.5.
    """
    chosen = F.broadcast(training_sample(labels, id_col, label_col, how.sample))
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")).join(chosen, "_id")
    bits = how.bits

    def start():
        def each(key, text, label):
            index, value = features(text, bits)
            yield label, crc32(str(key).encode()), str(key), index.astype(np.int32), value.astype(np.float32)
        return each

    vectors = map_texts(rows, ["_id", "_text", "_label"], T.StructType([
        T.StructField("label", T.IntegerType()), T.StructField("turn", T.LongType()),
        T.StructField("key", T.StringType()), T.StructField("index", T.ArrayType(T.IntegerType())),
        T.StructField("value", T.ArrayType(T.FloatType()))]), start)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = []
        for batch in batches:
            label, turn, key, index, value = batch.columns
            for i in range(batch.num_rows):
                table.append((turn[i].as_py(), key[i].as_py(), index[i].values.to_numpy().astype(np.int64),
                              value[i].values.to_numpy().astype(float), label[i].as_py()))
        table.sort(key=lambda r: (r[0], r[1], r[4], len(r[2])))
        w, bias = ftrl([r[2:] for r in table], how)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(w[at], np.float32(bias)).astype(np.float32))],
            names=["at", "w"])

    w, bias = np.zeros(1 << bits, np.float32), 0.0
    for r in vectors.repartition(1).mapInArrow(fit, "at long, w float").toLocalIterator():
        if r.at < 0:
            bias = r.w
        else:
            w[r.at] = r.w
    return w, bias


def score(
    docs: DataFrame, model: tuple[np.ndarray, float], how: Training = Training(), id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, score``: probability of label 1 for every row; null and empty texts score by the intercept."""
    sent, bits = docs.sparkSession.sparkContext.broadcast(model), how.bits

    def start():
        w, bias = sent.value

        def each(key, text):
            index, value = features(text, bits)
            yield key, float(_logistic(float(w[index] @ value) + bias))
        return each

    return map_texts(docs, [id_col, text_col], T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]), start)


def accepted(
    docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, how: Training = Training(),
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all columns, that score ``threshold`` or more; nothing is shuffled or joined."""
    sent, bits = docs.sparkSession.sparkContext.broadcast(model), how.bits
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value
        for batch in batches:
            keep = []
            for text in batch.column(at).cast(pa.large_binary()):
                index, value = features(text.as_py(), bits)
                keep.append(_logistic(float(w[index] @ value) + bias) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
