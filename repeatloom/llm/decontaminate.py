"""Benchmark decontamination with one automaton over the benchmark's word windows.

The normalised words of the items are numbered; every window of ``width`` consecutive words of an item (or the whole
item if it is shorter) is one pattern of an Aho-Corasick automaton over those numbers.  Each text is scanned once.
Matches are word ranges, which map back to characters of the original text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatloom.llm.rows import WORD_TABLE, free_name, map_texts, plain_words, quoted, release

#: Words of the benchmark that one automaton takes; a larger benchmark is scanned for in several blocks.
BLOCK_WORDS = 2_000_000


class WindowAutomaton:
    """Automaton over word numbers; 0 stands for all words that no item has."""

    def __init__(self, items: list[tuple], width: int):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in plain_words(text or b"")]
            size = min(width, len(words))
            for at in range(len(words) - size + 1 if words else 0):
                windows[tuple(words[at:at + size])].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, of in windows.items():
            self.automaton.add_word(window, (len(window), frozenset(of)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged ranges of hit words (begin, end) and the items that occur."""
        if self.empty:
            return [], set()
        numbers = self.numbers
        ids = tuple([numbers.get(w, 0) for w in words])
        ranges: list[tuple[int, int]] = []
        items: set = set()
        for end, (size, of) in self.automaton.iter(ids):
            begin = end + 1 - size
            while ranges and ranges[-1][1] >= begin:  # a later match may be longer and begin earlier
                begin = min(begin, ranges.pop()[0])
            ranges.append((begin, end + 1))
            items |= of
        return ranges, items


_SPANS = re.compile(rb"[^ ]+")


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of the word ranges."""
    places = [m.span() for m in _SPANS.finditer(text.translate(WORD_TABLE))]
    out = []
    for begin, end in ranges:
        first = len(text[:places[begin][0]].decode("utf-8", "replace"))
        out.append((first, first + len(text[places[begin][0]:places[end - 1][1]].decode("utf-8", "replace"))))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``block_words`` words (or one item); one block is on the driver at a time."""
    block, words = [], 0
    rows = benchmark.select(quoted(item_col).cast("string").alias("i"), quoted(text_col).alias("t"))
    for r in rows.distinct().orderBy("i", "t").toLocalIterator():
        data = (r.t or "").encode()
        size = len(plain_words(data))
        if block and words + size > block_words:
            yield block
            block, words = [], 0
        block.append((r.i, data))
        words += size
    yield block


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``n_words, n_hit, items`` (sorted item ids as strings) and ``spans``.

    ``spans`` are the hit passages as ``begin, end`` pairs of code points in the original text, one flat array.
    Null and empty texts have no words and no hits; items without words match nothing; items with the same id count
    as one.  Repeated rows are scanned each.  A benchmark of more than ``block_words`` words is scanned for
    in blocks, and the blocks' word ranges are united per row by (id, digest of the text), so nothing broadcast is
    larger than one block.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("ranges", T.ArrayType(T.LongType()))])

    def scanned(block: list[tuple], df: DataFrame, columns: list[str], out: T.StructType) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def start():
            automaton = WindowAutomaton(sent.value, width)

            def each(key, text, *more):
                words = plain_words(text or b"")
                ranges, items = automaton.scan(words)
                yield (key, len(words), sum(e - b for b, e in ranges), sorted(items),
                       [x for s in (char_spans(text, ranges) if ranges else ()) for x in s],
                       [x for r in ranges for x in r], *more)
            return each

        return map_texts(df, columns, out, start)

    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scanned(first, docs, [id_col, text_col], schema).drop("ranges")

    place = free_name(docs, "_row")
    rows = docs.select(quoted(id_col), quoted(text_col), F.xxhash64(quoted(text_col)).alias(place))
    wide = T.StructType([*schema.fields, T.StructField(place, T.LongType())])
    parts = [scanned(b, rows, [id_col, text_col, place], wide) for b in (first, second, *blocks)]
    copies = free_name(docs, "_copies")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    pairs = lambda c: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(c)), lambda i: (i % 2 == 0) & (i < F.size(c))),
        lambda i: F.struct(F.get(c, i).alias("b"), F.get(c, i + 1).alias("e")))
    merged = lambda c: F.aggregate(
        F.array_sort(F.flatten(F.collect_list(pairs(F.col(c))))), F.expr("cast(array() as array<struct<b:bigint,e:bigint>>)"),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= r["b"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["b"].alias("b"), F.greatest(F.element_at(acc, -1)["e"], r["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(r))))
    flat = lambda c: F.flatten(F.transform(c, lambda r: F.array(r["b"], r["e"])))
    return (
        union.groupBy(quoted(id_col), F.col(place)).agg(
            F.first("n_words").alias("n_words"), merged("ranges").alias("_r"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            merged("spans").alias("_s"), (F.count("*") / len(parts)).cast("int").alias(copies))
        .select(id_col, "n_words",
                F.aggregate("_r", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["b"]).alias("n_hit"),
                "items", flat(F.col("_s")).alias("spans"),
                F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).drop(copies))


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window of the benchmark; nothing is shuffled or joined.

    A benchmark of several blocks is a chain of filters, one for each.
    """
    at = docs.columns.index(text_col)

    def without(df: DataFrame, block: list[tuple]) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = WindowAutomaton(sent.value, width)
            for batch in batches:
                keep = [not automaton.scan(plain_words(t.as_py() or b""))[0]
                        for t in batch.column(at).cast(pa.large_binary())]
                yield batch.filter(pa.array(keep, pa.bool_()))
            release()

        return df.mapInArrow(run, df.schema)

    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        docs = without(docs, block)
    return docs
