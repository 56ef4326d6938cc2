"""Exact Jaccard join of word shingle sets with token-combination prefixes.

Tokens (shingles) are ordered by how many documents have them, rare ones first.  A prefix of that order is long enough
once it holds one token more than two similar sets can differ by; such sets then share something in their prefixes.
Rare tokens are indexed alone.  Frequent tokens (``2 ** RARE`` documents or more) are dealt to small classes by hash,
the prefix is extended by one token per class, and pairs of one class are indexed: if more than one of a class must
be common, a pair is.  Tokens of one document only are never indexed.

Pairs that share an index entry are verified on all tokens that more than one document has.  First each entry's
members are compared with the most central one only, its hub (fewest tokens of its own); groups that this connects need
no more comparisons inside.  Then what is still in different groups and can be alike is compared.  Copies are one document throughout, and no pair inside a connected
group is ever made.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatloom.llm import packed
from repeatloom.llm.rows import free_name, quoted
from repeatloom.operators.durable import scratch_path
from repeatloom.operators.kmers import components

#: Frequent tokens: in at least 2 ** RARE documents.
RARE = 4
#: Sets of fewer than 2 ** SMALL tokens are indexed by single tokens only.
SMALL = 4
#: Stands for a null id; it comes before all others.
NO_ID = -(1 << 63)
COUNTED = 1
_PAIR = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(words: packed.BlockWords, width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; a text of fewer words has its whole sequence as the only one."""
    runs = words.runs(0, width)
    out = []
    for begin, n in zip(words.starts.tolist(), words.counts.tolist()):
        if n >= width:
            out.append(np.unique(runs[begin:begin + n - width + 1]))
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in words.hashes[0][begin:begin + n]:
                    short = short * _PAIR + h
            out.append(packed.mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class _Sets:
    """Shingle sets of the block's documents that stand for their copies."""

    def __init__(self, docs: pa.Table, right: pa.Table, width: int, plan: packed.Layout):
        stands = {(r["segment"], r["other"]) for r in right.select(["segment", "kind", "other"]).to_pylist()
                  if r["kind"] == 0}
        keys = list(zip(docs.column("id").to_pylist(), docs.column("d1").to_pylist()))
        rows, seen = [], set()
        for i, key in enumerate(keys):
            if key in stands and key not in seen:
                seen.add(key)
                rows.append(i)
        texts = packed.texts_of(docs.take(pa.array(rows, pa.int64())))
        self.keys = [keys[i] for i in rows]
        self.sets = shingle_sets(packed.BlockWords(texts, lower=True), width)
        both = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        self.counters, self.of, self.times = np.unique(
            both >> np.uint64(64 - plan.bits), return_inverse=True, return_counts=True)
        self.cuts = packed.cut(self.counters, plan.first_of(plan.bits))


def _count(plan: packed.Layout, width: int):
    def block(docs: pa.Table, right: pa.Table) -> pa.Table:
        w, number = _Sets(docs, right, width, plan), docs.column("block")[0].as_py()
        return packed.message(
            [(s, number, e - b, packed.pack_sorted(w.counters[b:e]) + packed.planes(w.times[b:e].astype(np.uint64)))
             for s, b, e in w.cuts], packed.SENT)
    return block


def _frequency(sent: pa.Table) -> pa.Table:
    """For each counter of each block, the binary logarithm of its sum, in one byte."""
    rows = sent.to_pylist()
    values = np.concatenate([packed.unpack_sorted(r["data"][:8 * r["n"]], r["n"]) for r in rows])
    counts = np.concatenate([packed.from_planes(r["data"][8 * r["n"]:], r["n"]) for r in rows])
    _, of = np.unique(values, return_inverse=True)
    code = np.floor(np.log2(np.bincount(of, weights=counts)))[of].astype(np.uint8)
    out, at = [], 0
    for r in rows:
        out.append((r["block"], r["segment"], COUNTED, 0, code[at:at + r["n"]].tobytes()))
        at += r["n"]
    return packed.message(out, REPLY)


def size_classes(n: int, num: int, den: int) -> range:
    """Binary logarithms of the sizes that a set similar to one of ``n`` tokens can have."""
    least = -(-num * n // den)
    return range(least.bit_length() - 1, (den * n // num).bit_length())


def signatures(tokens: np.ndarray, codes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index entries of one set; ``codes`` are the logarithms of the tokens' frequencies."""
    n = len(tokens)
    may_differ = n - -(-num * n // den)
    if np.count_nonzero(codes == 0) > may_differ:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, codes))
    tokens, codes = tokens[order], codes[order]
    entries: list[np.ndarray] = []
    for size in size_classes(n, num, den):
        if size < SMALL:
            single, often = slice(0, may_differ + 1), tokens[:0]
        else:
            rare = int(np.searchsorted(codes, RARE))
            single, often = slice(0, min(rare, may_differ + 1)), tokens[:0]
            if rare <= may_differ:
                rest = tokens[rare:]
                kind = (rest >> np.uint64(40)) & np.uint64((1 << (size - SMALL)) - 1)
                gain = np.ones(len(rest), np.int64)
                gain[np.unique(kind, return_index=True)[1]] = 0
                upto = int(np.searchsorted(np.cumsum(gain), may_differ + 1 - rare)) + 1
                often, kind = rest[:upto], kind[:upto]
        entries.append(tokens[single][codes[single] > 0])
        if len(often):
            by_kind: dict[int, list[int]] = {}
            for k, t in zip(kind.tolist(), often):
                by_kind.setdefault(k, []).append(t)
            pairs = [p for of in by_kind.values() for p in combinations(of, 2)]
            if pairs:
                two = np.array(pairs, np.uint64)
                entries.append(packed.mixed(two[:, 0] * _PAIR + two[:, 1]))
    return np.unique(np.concatenate(entries))


REPLY = pa.schema([("block", pa.int64()), ("segment", pa.int64()), ("kind", pa.int32()), ("other", pa.int64()),
                   ("data", pa.binary())])
REPLY_DDL = "block long, segment long, kind int, other long, data binary"
INDEXED = pa.schema([("id", pa.int64()), ("d1", pa.int64()), ("n", pa.int64()), ("own", pa.int64()),
                     ("entries", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
INDEXED_DDL = "id long, d1 long, n long, own long, entries array<long>, tokens array<long>"


def _index(plan: packed.Layout, width: int, num: int, den: int):
    def block(docs: pa.Table, right: pa.Table) -> pa.Table:
        w = _Sets(docs, right, width, plan)
        found = packed.answers(right, COUNTED)
        if len(found) != len(w.cuts):
            raise ValueError(f"{len(found)} answers to {len(w.cuts)} messages")
        codes = np.frombuffer(b"".join(found), np.uint8)[w.of] if found else np.zeros(0, np.uint8)
        out, at = [], 0
        for (key, d1), tokens in zip(w.keys, w.sets):
            mine = codes[at:at + len(tokens)]
            at += len(tokens)
            entries = signatures(tokens, mine, num, den) if len(tokens) else tokens
            out.append((key, d1, len(tokens), int(np.count_nonzero(mine == 0)), entries.view(np.int64),
                        tokens[mine > 0].view(np.int64) if len(entries) else None))
        return packed.message(out, INDEXED)
    return block


def _alike(common: Column, n1: Column, n2: Column, num: int, den: int) -> Column:
    return den * common >= num * (n1 + n2 - common)


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` of ``a, b`` with both sizes, the number of common tokens, and what ``b`` has besides ``a``."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"), F.col("tokens").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select(
        "a", "b", "na", "nb", "ob", F.size(F.array_intersect("ta", "tb")).alias("common"),
        F.array_except("tb", "ta").alias("besides"))


def links(sets: DataFrame, num: int, den: int, written) -> tuple[DataFrame, DataFrame]:
    """Verified links between documents, and the groups they make (``id, label``) where there are any.

    Every entry's members are compared with its hub.  Two members x and y that this leaves in different groups have in
    common what both have of the hub, at most min(|x & hub|, |y & hub|), and what both have besides it.  So they
    are compared only if that minimum is enough, or if they share a token that the hub lacks.
    """
    entries = sets.select("id", "n", "own", F.explode("entries").alias("entry"))
    me = F.struct((F.col("own") / F.col("n")).alias("share"), "id")
    hubs = entries.groupBy("entry").agg(F.min(me).alias("hub"), F.count("*").alias("members")).where(
        "members > 1").select("entry", F.col("hub.id").alias("hub"))
    beside = entries.join(hubs, "entry")
    star = written(_beside(
        beside.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sets), "star")
    first = star.where(_alike(F.col("common"), F.col("na"), F.col("nb"), num, den)).select("a", "b")
    labels = groups(first)

    def named(df: DataFrame, key: str, out: str) -> DataFrame:
        own = labels.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        return df.join(own, F.col(key) == F.col("_id"), "left").withColumn(
            out, F.coalesce("_label", F.col(key))).drop("_id", "_label")

    placed = named(named(star.select(
        F.col("a").alias("hub"), F.col("b").alias("id"), F.col("nb").alias("n"), F.col("ob").alias("own"), "common",
        "besides"), "id", "label"), "hub", "hub_label")
    placed = written(placed, "placed")
    plain = placed.drop("besides")
    in_entry = entries.select("id", "entry").join(hubs, "entry").join(plain, ["hub", "id"])
    by_token = placed.select("*", F.explode("besides").alias("token")).drop("besides")
    cross = _between(in_entry, ["entry"], F.lit(0), num, den).unionByName(_between(
        by_token, ["hub", "token"],
        F.least(F.col("n") - F.col("common") - F.col("own"), F.col("n1") - F.col("common1") - F.col("own1")), num, den))
    known = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = written(
        _beside(cross.distinct().join(known, ["a", "b"], "left_anti"), sets)
        .where(_alike(F.col("common"), F.col("na"), F.col("nb"), num, den)).select("a", "b"), "more-links")
    if second.isEmpty():
        return first, labels
    merged = named(named(second, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    upper = groups(merged).select(F.col("id").alias("label"), F.col("label").alias("top"))
    everyone = labels.unionByName(
        upper.select(F.col("label").alias("id"), "label").join(labels, "id", "left_anti"))
    final = everyone.join(upper, "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    return first.unionByName(second), final


def _between(rows: DataFrame, keys: list[str], besides: Column, num: int, den: int) -> DataFrame:
    """Pairs of one key and different groups that can be alike; one of the two is outside the hub's group."""
    outside = rows.where("label != hub_label").select(
        *keys, F.col("id").alias("a"), *[F.col(c).alias(f"{c}1") for c in ("n", "own", "common", "label")])
    most = F.least("common", "common1") + besides
    return (
        outside.join(rows, keys)
        .where((F.col("label1") != F.col("label")) & ((F.col("label") == F.col("hub_label")) | (F.col("a") < F.col("id")))
               & _alike(most, F.col("n1"), F.col("n"), num, den))
        .select("a", F.col("id").alias("b")))


def groups(pairs: DataFrame) -> DataFrame:
    """``id, label``: smallest id reachable, for the ids of the pairs."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    return components(ends, pairs).select(F.col("rep").alias("id"), "label")


def similar_documents(
    df: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = 4 << 20, segment_shingles: int = 1 << 20,
) -> DataFrame:
    """``id_col, n_shingles, n_links, component_id`` per row of ``df``.

    A set is the distinct ``width``-word shingles of the text with A-Z lower-cased (the whole sequence where there
    are fewer words).  Two documents link when ``den * |common| >= num * |union|``.  ``component_id`` is the smallest
    id reachable by links; ``n_links`` counts the links found to documents of other text (inside a connected group not
    all are looked for).  Null and empty texts, and texts without words, have no shingles and stand alone.  Texts that are equal are one
    document with the smallest of their ids, rows with one id are one document, and a null id comes before all
    others (its ``component_id`` is null).  Ids are integers.  Extra columns are not read.

    Intermediate tables go to the session's checkpoint folder.
    """
    spark = df.sparkSession

    def written(part: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        part.write.parquet(path)
        return spark.read.parquet(path)

    plan = packed.layout(df, text_col, block_bytes, segment_shingles)
    key = F.coalesce(quoted(id_col).cast("long"), F.lit(NO_ID))
    text = F.coalesce(quoted(text_col), F.lit(""))
    d1, d2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    named = df.select(key.alias("id"), text.alias("text"))
    rows = packed.dealt(named, "id", "text", plan.blocks).withColumn("d1", F.xxhash64("text"))
    slim = df.select(key.alias("id"), d1.alias("d1"), d2.alias("d2"),
                     F.pmod(F.xxhash64(key, text), F.lit(plan.blocks)).alias("block"))
    stands = slim.groupBy("d1", "d2").agg(F.min(F.struct("id", "block")).alias("rep"))
    chosen = stands.select(
        F.col("rep.block").alias("block"), F.col("rep.id").alias("segment"), F.lit(0).alias("kind"),
        F.col("d1").alias("other"), F.lit(None).cast("binary").alias("data")).repartition("block")
    counted = (
        rows.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(_count(plan, width), packed.SENT_DDL)
        .groupBy("segment").applyInArrow(_frequency, REPLY_DDL))
    sets = written(
        rows.groupBy("block").cogroup(chosen.unionByName(counted).groupBy("block")).applyInArrow(
            _index(plan, width, num, den), INDEXED_DDL), "sets")
    found, labels = links(sets.where(F.size("entries") > 0), num, den, written)
    ends = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id")))
    facts = (
        sets.select("id", "d1", "n").join(labels, "id", "left")
        .join(ends.groupBy("id").agg(F.count("*").alias("links")), "id", "left"))
    by_text = stands.select("d1", "d2", F.col("rep.id").alias("id")).join(facts, ["id", "d1"]).select(
        "d1", "d2", F.col("id").alias("first"), "n", "label", "links")
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("label", "first"))
    back = lambda c: F.nullif(c, F.lit(NO_ID)).cast(df.schema[id_col].dataType)
    return slim.select("id", "d1", "d2").join(by_text, ["d1", "d2"]).select(
        back(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).alias("n_links"),
        back(alone).alias("component_id"))


#: Ids that are broadcast at most; more are joined by a shuffle.
FEW = 1_000_000


def one_of_each(
    df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``df``, with all columns, without the near duplicates of a document of smaller id.

    Of each group of linked documents, and of each set of equal texts, the row of the smallest id stays; rows that
    share this id stay together.  Texts without words stay.
    """
    spark = df.sparkSession
    found = similar_documents(df, width, num, den, id_col, text_col)
    path, name = scratch_path(spark, "duplicates"), free_name(df, "gone")
    found.where(~quoted(id_col).eqNullSafe(F.col("component_id"))).select(quoted(id_col).alias(name)).distinct(
        ).write.parquet(path)
    gone = spark.read.parquet(path)
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return df.join(gone, quoted(id_col).eqNullSafe(F.col(name)), "left_anti")
