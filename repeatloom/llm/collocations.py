"""Phrase collocations by SETM: sorted occurrence relations that are joined with themselves and thinned, length by length.

The relation of length k has a row for each place of a text where a frequent phrase of k words begins: (block, place,
group).  Places count words; between two pieces one place stays free, so neighbours in place are neighbours in a piece.
A block holds the places of some MB of text of one language in order, as arrays, and the relations are tables in
buckets of the block, written with few blocks in a row group, so that no task decodes a whole file.  One length further:

- merge-join: the relation and that of single words meet block by block, in place, at place and place + k - 1;
- group-count: the joined groups, counted within each block first, are summed by Spark;
- semi-join: groups that are frequent enough get a number, and only their places make up the next relation.

Every part of a frequent phrase is as frequent as the phrase, so the count tables hold all that the scores ask for.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.llm.blocks import TOGETHER, block_numbers, bucketed, numbers, table_of, written
from repeatloom.llm.rows import LOWER_TABLE, quoted, release

#: Bytes of text in a block, and of text that waits in a task for its language's block to fill.
BLOCK, WAITING = 2 << 20, 6 << 20
#: Frequent groups of one length up to which every task gets them; more meet the blocks by a shuffle.
SENT = 1_000_000
#: Bytes of text that are split into words at once.
SLICE = 1 << 20
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0x0A if c in _ENDS else 0x20 if c == 0x09 else LOWER_TABLE[c] for c in range(256))
_END = re.compile(b"[" + re.escape(_ENDS) + b"]")


class _Words(dict):
    """Word -> number in its block; an empty word is 0 and the end of a piece 1."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _slices(data: bytes) -> Iterator[bytes]:
    """Some MB each, cut at spaces."""
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + SLICE)
        end = len(data) if end < 0 else end
        yield data[begin:end]
        begin = end + 1


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, number of the word at each occurrence, and the occurrences' places."""
    known, parts = _Words(), []
    data = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    for part in _slices(data):
        words = part.split(b" ")
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    codes = codes[codes > 0]
    solid = codes > 1
    return list(known)[2:], codes[solid] - 2, np.flatnonzero(solid).astype(np.int64)


def pieces_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about a block, cut where pieces end; a piece itself is never cut."""
    begin = 0
    while len(text) - begin > BLOCK:
        end = _END.search(text, begin + BLOCK)
        if end is None:
            break
        yield text[begin:end.start()]
        begin = end.end()
    yield text[begin:] if begin else text


_RAW = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())),
                  ("word", pa.list_(pa.int32())), ("step", pa.list_(pa.int32()))])
_RAW_DDL = "block long, lang string, words array<string>, word array<int>, step array<int>"


def _raw_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh, waiting, sizes = block_numbers(), defaultdict(list), Counter()

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        sizes.pop(lang)
        words, word, place = numbered_words(waiting.pop(lang))
        if words:
            yield pa.RecordBatch.from_arrays([
                pa.array([next(fresh)]), pa.array([lang]),
                pa.array([pa.array(words, pa.binary()).cast(pa.string())], _RAW.field("words").type),
                pa.array([word], _RAW.field("word").type),
                pa.array([np.diff(place, prepend=0)], _RAW.field("step").type)], schema=_RAW)
        release()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            for part in pieces_of(text.as_py() or b""):
                waiting[lang].append(part)
                sizes[lang] += len(part) + 1
                if sizes[lang] >= BLOCK:
                    yield from flush(lang)
                elif sizes.total() >= WAITING:
                    yield from flush(sizes.most_common(1)[0][0])
    for lang in sorted(waiting):
        yield from flush(lang)


_COUNT_WORDS_DDL = "block long, lang string, code long, word string, n long"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column("words")[i].values
            n = np.bincount(numbers(batch.column("word"), i), minlength=len(words))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), batch.column("block")[i].as_py())),
                pa.array([batch.column("lang")[i].as_py()] * len(n), pa.string()),
                pa.array(np.arange(len(n))), words, pa.array(n)],
                names=["block", "lang", "code", "word", "n"])
        release()


_KEPT = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("step", pa.list_(pa.int32())),
                   ("group", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
_KEPT_DDL = "block long, lang string, step array<int>, `group` array<int>, ids array<long>"


def _thinned(block: int, lang: str, place: np.ndarray, code: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> pa.Table:
    """The relation's places whose code is among ``codes`` (sorted); groups are numbered in their order."""
    if not len(codes) or not len(code):
        return _KEPT.empty_table()
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    held = codes[at] == code
    return table_of(_KEPT, [[block], [lang], [np.diff(place[held], prepend=0).astype(np.int32)],
                            [at[held].astype(np.int32)], [ids]])


def _sorted(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes = found.column("code").to_numpy()
    order = np.argsort(codes)
    return codes[order], found.column("gid").to_numpy()[order]


def _name(rows: pa.Table | pa.RecordBatch, i: int) -> tuple[int, str]:
    return rows.column("block")[i].as_py(), rows.column("lang")[i].as_py()


def _word_places(rows: pa.Table | pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.cumsum(numbers(rows.column("step"), i), dtype=np.int64), numbers(rows.column("word"), i).astype(np.int64))


def _frequent_words(raw: pa.Table, found: pa.Table) -> pa.Table:
    """Semi-join of a block's words with the frequent ones that a shuffle brought to it."""
    if not raw.num_rows:
        return _KEPT.empty_table()
    return _thinned(*_name(raw, 0), *_word_places(raw, 0), *_sorted(found))


def _frequent_words_sent(sent):
    """The same with words that every task has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                block, lang = _name(batch, i)
                if lang not in known:
                    continue
                words, ids = known[lang]
                at = pc.index_in(batch.column("words")[i].values, value_set=words)
                codes = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                ids = ids[at.drop_null().to_numpy()]
                yield from _thinned(block, lang, *_word_places(batch, i), codes, ids).to_batches()
    return run


class Groups:
    """Numbers of frequent groups by key, to look many up at once."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each group, -1 where it isn't frequent."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], -1)


def _joined(batch: pa.RecordBatch | pa.Table, i: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of row i's relation with single words: place, code, and the ids of both sides with the width."""
    place = np.cumsum(numbers(batch.column("step"), i), dtype=np.int64)
    group = numbers(batch.column("group"), i)
    word_place = np.cumsum(numbers(batch.column("word_step"), i), dtype=np.int64)
    word = numbers(batch.column("word"), i)
    word_ids = numbers(batch.column("word_ids"), i)
    at = np.searchsorted(word_place, place + (k - 1))
    at[at == len(word_place)] = 0
    meet = word_place[at] == place + (k - 1) if len(word_place) else np.zeros(len(place), bool)
    code = group[meet].astype(np.int64) * max(1, len(word_ids)) + word[at[meet]]
    return place[meet], code, numbers(batch.column("ids"), i), word_ids, np.int64(max(1, len(word_ids)))


_COUNT_DDL = "block long, code long, key long, n long"


def _group_counts(k: int, n_words: int):
    """A block's groups with their counts; the key of a group is ``head * n_words + tail``.

    Rows leave in order of the key: what lies side by side then is alike, and the shuffle's files are smaller.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, code, ids, word_ids, width = _joined(batch, i, k)
                code, n = np.unique(code, return_counts=True)
                key = ids[code // width] * n_words + word_ids[code % width]
                order = np.argsort(key)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(code), batch.column("block")[i].as_py())), pa.array(code[order]),
                    pa.array(key[order]), pa.array(n[order])], names=["block", "code", "key", "n"])
            release()
    return run


def _frequent_groups(k: int):
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _KEPT.empty_table()
        place, code, *_ = _joined(blocks, 0, k)
        return _thinned(*_name(blocks, 0), place, code, *_sorted(found))
    return run


def _frequent_groups_sent(k: int, n_words: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                place, code, ids, word_ids, width = _joined(batch, i, k)
                codes = np.unique(code)
                gid = sent.value.find(ids[codes // width] * n_words + word_ids[codes % width])
                yield from _thinned(*_name(batch, i), place, code, codes[gid >= 0], gid[gid >= 0]).to_batches()
            release()
    return run


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written, with the numbers 0, 1, ... in ``gid``, and how many rows there are.

    A row's number is its place in its task plus the rows of the tasks before; one count per task reaches the driver.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    made = written(df.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), name)
    sizes = sorted((r["_part"], r["n"]) for r in made.groupBy("_part").agg(F.count("*").alias("n")).collect())
    firsts = np.cumsum([0] + [n for _, n in sizes]).tolist()
    begin = df.sparkSession.createDataFrame(
        [(part, first) for (part, _), first in zip(sizes, firsts)], "_part int, _first long")
    return (made.join(F.broadcast(begin), "_part").withColumn("gid", F.col("_first") + F.col("_place"))
            .drop("_part", "_first", "_place")), firsts[-1]


def phrase_counts(
    docs: DataFrame, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang", sent: int = SENT,
) -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, a`` of all phrases of up to ``longest`` words that occur ``least`` times or more (single
    words too), and ``lang, n`` with the number of word occurrences.

    Runs jobs: the relations and count tables are written to the shared folder.  The frequent groups of a length are
    counted; up to ``sent`` of them go to every task (16 bytes each), more are joined with the blocks' groups.
    """
    sc = docs.sparkSession.sparkContext
    raw = written(docs.select(F.coalesce(quoted(lang_col), F.lit("und")).alias("lang"), quoted(text_col).alias("text"))
                  .mapInArrow(_raw_blocks, _RAW_DDL), "words", TOGETHER)
    counted = raw.mapInArrow(_word_counts, _COUNT_WORDS_DDL)
    totals = raw.groupBy("lang").agg(F.sum(F.size("word").cast("long")).alias("n"))
    words, n_words = _numbered(
        counted.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "word-counts")
    n_heads = n_words
    if n_words <= sent:
        table = words.select("lang", "word", "gid").toArrow()
        known = sc.broadcast({
            lang: (part.column("word").combine_chunks(), part.column("gid").to_numpy())
            for lang in pc.unique(table.column("lang")).to_pylist()
            for part in [table.filter(pc.equal(table.column("lang"), lang))]})
        places = raw.mapInArrow(_frequent_words_sent(known), _KEPT_DDL)
    else:
        found = counted.join(words, ["lang", "word"]).select("block", "code", "gid")
        places = raw.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_frequent_words, _KEPT_DDL)
    single, forget = bucketed(places, "places", "block")
    forgotten = [forget]
    tables = [words.select("lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), "a", "gid")]
    beside = single.select(F.col("block").alias("_b"), F.col("step").alias("word_step"), F.col("group").alias("word"),
                           F.col("ids").alias("word_ids"))
    relation = single
    for k in range(2, longest + 1):
        pairs = relation.join(beside, relation.block == beside._b).drop("_b")
        if n_heads * n_words >= 1 << 63:
            raise OverflowError(f"{n_heads} groups of {k - 1} words and {n_words} words have no keys of 64 bits")
        counted = pairs.mapInArrow(_group_counts(k, n_words), _COUNT_DDL)
        groups, n_heads = _numbered(
            counted.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "group-counts")
        head, tail = F.expr(f"key div {max(1, n_words)}").alias("head"), (F.col("key") % max(1, n_words)).alias("tail")
        heads = tables[-1].select("lang", F.col("gid").alias("head"), F.col("phrase").alias("_head"))
        tails = words.select(F.col("gid").alias("tail"), F.col("word").alias("_tail"))
        tables.append(
            groups.select("a", "gid", head, tail).join(heads, "head").join(tails, "tail")
            .select("lang", F.lit(k).alias("size"), F.concat_ws(" ", "_head", "_tail").alias("phrase"), "a", "gid"))
        if k == longest:
            break
        if n_heads <= sent:
            table = groups.select("key", "gid").toArrow()
            known = sc.broadcast(Groups(*(table.column(c).to_numpy() for c in ("key", "gid"))))
            places = pairs.mapInArrow(_frequent_groups_sent(k, n_words, known), _KEPT_DDL)
        else:
            found = counted.join(groups, "key").select("block", "code", "gid")
            places = pairs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_frequent_groups(k), _KEPT_DDL)
        relation, forget = bucketed(places, "places", "block")
        forgotten.append(forget)
    counts = tables[0]
    for table in tables[1:]:
        counts = counts.unionByName(table)
    counts = written(counts.drop("gid"), "phrases")
    for forget in forgotten:
        forget()
    return counts, totals


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang",
    sent: int = SENT,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` best phrases.

    A-Z are lower-cased, texts split at ``.,;:!?`` and line ends into pieces and these at spaces and tabs into words.
    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut that scores lowest (ties: the first),
    ``score = floor(2000000 a / (l + r))``.  A phrase goes if a longer one of at least 80 % of its count holds it.
    Null and empty texts have no words; a null language is ``und``; a repeated row counts each time; an empty table
    gives no rows; columns other than the two named aren't read.
    """
    counts, totals = phrase_counts(docs, longest, least, text_col, lang_col, sent)
    part = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    phrases = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = (
        phrases.select("lang", "size", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
        .select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("_first"),
                part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("_rest")))
    of = lambda name, out: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(out))
    scored = (
        cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"])
        .withColumn("_double", _wide(F.lit(2_000_000) * _wide(F.col("a"))))
        .withColumn("_parts", _wide(_wide(F.col("l")) + _wide(F.col("r"))))
        .withColumn("score", F.expr("_double div _parts").cast("long"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_low"))
        .select("lang", "phrase", "a", "_low.l", "_low.r", "_low.score"))
    longer = (
        phrases.where("size > 2")
        .select("lang", F.col("a").alias("_longer"), "words", "size",
                F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_size"))
        .select("lang", "_longer", "words", "_size",
                F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_size") + 1)).alias("_begin"))
        .groupBy("lang", part(F.col("_begin"), F.col("_size")).alias("phrase")).agg(F.max("_longer").alias("_longer")))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (_wide(F.col("_longer")) * 100 < _wide(F.col("a")) * 80))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
