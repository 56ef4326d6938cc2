"""Substring dedup behind a count-min prefilter.

First pass: each block of documents counts its word windows in a sketch, and the sketches are merged by segment.  The
sketch has about 32 counters for each window of the input and one row; it is kept as the sorted numbers of the
counters that are not 0, so its size follows the input and no task needs all of it.  A merged counter can be too
large (two windows may share it) and never too small.  Second pass: only windows whose counter is at least 2 are
grouped exactly, by 128-bit hash, to find where each stands first.  Third pass: every other place goes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.llm import packed
from repeatloom.llm.rows import quoted, space_words

#: Stands for a null id; it comes before all others.
NO_ID = -(1 << 63)
COUNTED, GROUPED = 1, 2


class _Windows:
    """Windows of a block: their counters, and with the counters' answers the candidates."""

    def __init__(self, docs: pa.Table, width: int, plan: packed.Layout, streams: int):
        self.texts = packed.texts_of(docs)
        self.ids = np.array([NO_ID if i is None else i for i in docs.column("id").to_pylist()], np.int64)
        self.words = packed.BlockWords(self.texts, streams=streams)
        self.width, self.plan, self.streams = width, plan, streams
        self.places = self.words.run_places(width)
        self.h1 = self.words.runs(0, width)[self.places] if len(self.places) else np.zeros(0, np.uint64)
        self.counters, self.of, self.times = np.unique(
            self.h1 >> np.uint64(64 - plan.bits), return_inverse=True, return_counts=True)
        self.cuts = packed.cut(self.counters, plan.first_of(plan.bits))

    def candidates(self, replies: pa.Table) -> None:
        """Keeps windows counted twice or more; sorts them by hash, id and start."""
        often = packed.flags(replies, COUNTED, [e - b for _, b, e in self.cuts]) | (self.times > 1)
        chosen = np.flatnonzero(often[self.of])
        places = self.places[chosen]
        h1 = self.h1[chosen]
        h2 = self.words.runs(1, self.width)[places] if len(places) else np.zeros(0, np.uint64)
        doc = np.searchsorted(self.words.starts, places, side="right") - 1
        while len(doc) and (idle := self.words.counts[doc] == 0).any():  # texts without words begin at the same word
            doc = np.where(idle, doc - 1, doc)
        start = places - self.words.starts[doc]
        order = np.lexsort((start, self.ids[doc], h2, h1))
        self.c_place, self.c_h1, self.c_h2 = places[order], h1[order], h2[order]
        self.c_id, self.c_start = self.ids[doc][order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.c_h1[1:] != self.c_h1[:-1]) | (self.c_h2[1:] != self.c_h2[:-1])
        self.heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.c_cuts = packed.cut(self.c_h1[self.heads], self.plan.first_of(64))


def _count(plan: packed.Layout, width: int):
    def block(docs: pa.Table) -> pa.Table:
        w, number = _Windows(docs, width, plan, 1), docs.column("block")[0].as_py()
        return packed.message(
            [(s, number, e - b, packed.pack_sorted(w.counters[b:e])) for s, b, e in w.cuts], packed.SENT)
    return block


def _merge(sent: pa.Table) -> pa.Table:
    """One bit per counter of each block: whether another block has it too."""
    rows = sent.to_pylist()
    values = np.concatenate([packed.unpack_sorted(r["data"], r["n"]) for r in rows])
    _, of, times = np.unique(values, return_inverse=True, return_counts=True)
    twice, out, at = times[of] > 1, [], 0
    for r in rows:
        out.append((r["block"], r["segment"], COUNTED, np.packbits(twice[at:at + r["n"]]).tobytes()))
        at += r["n"]
    return packed.message(out, packed.ANSWER)


def _candidates(plan: packed.Layout, width: int):
    def block(docs: pa.Table, replies: pa.Table) -> pa.Table:
        w, number = _Windows(docs, width, plan, 2), docs.column("block")[0].as_py()
        w.candidates(replies)
        out = []
        for s, b, e in w.c_cuts:
            h = w.heads[b:e]
            out.append((s, number, e - b, b"".join([
                packed.pack_sorted(w.c_h1[h]), w.c_h2[h].tobytes(),
                packed.planes(w.c_id[h].view(np.uint64)), packed.planes(w.c_start[h].astype(np.uint64))])))
        return packed.message(out, packed.SENT)
    return block


def _first(sent: pa.Table) -> pa.Table:
    """One bit per window of each block: whether it stands nowhere earlier."""
    rows = sent.to_pylist()
    parts = []
    for r in rows:
        n, d = r["n"], r["data"]
        parts.append((packed.unpack_sorted(d[:8 * n], n), np.frombuffer(d[8 * n:16 * n], np.uint64),
                      packed.from_planes(d[16 * n:24 * n], n).view(np.int64), packed.from_planes(d[24 * n:], n)))
    h1, h2, ids, start = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((start, ids, h2, h1))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (h1[a] != h1[b]) | (h2[a] != h2[b])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first = np.zeros(len(order), bool)
    first[order] = (ids[order] == ids[head]) & (start[order] == start[head])
    out, at = [], 0
    for r in rows:
        out.append((r["block"], r["segment"], GROUPED, np.packbits(first[at:at + r["n"]]).tobytes()))
        at += r["n"]
    return packed.message(out, packed.ANSWER)


KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _remove(plan: packed.Layout, width: int):
    def block(docs: pa.Table, replies: pa.Table) -> pa.Table:
        w = _Windows(docs, width, plan, 2)
        w.candidates(replies)
        first = packed.flags(replies, GROUPED, [e - b for _, b, e in w.c_cuts])
        head = w.heads[w.group] if len(w.group) else w.group
        stays = (first[w.group] & (w.c_id == w.c_id[head]) & (w.c_start == w.c_start[head])) if len(head) else head
        edge = np.zeros(len(w.words.hashes[0]) + 1, np.int64)
        gone_at = w.c_place[~stays] if len(head) else head
        np.add.at(edge, gone_at, 1)
        np.add.at(edge, gone_at + width, -1)
        kept = np.cumsum(edge)[:-1] == 0
        out = []
        for i, (text, begin, n) in enumerate(zip(w.texts, w.words.starts.tolist(), w.words.counts.tolist())):
            mine, words = kept[begin:begin + n], space_words(text or b"")
            removed = n - int(np.count_nonzero(mine))
            left = b" ".join(compress(words, mine.tolist()) if removed else words)
            out.append((docs.column("id")[i].as_py(), n, removed, left.decode("utf-8", "replace")))
        return packed.message(out, KEPT)
    return block


def remove_repeats(
    df: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20,
    segment_windows: int = 1 << 20,
) -> DataFrame:
    """``id_col, n_words, n_removed, kept`` per row of ``df``; ``kept`` joins the words that stay by one space.

    A word goes if a window of ``width`` words that covers it stands earlier too: in a row of smaller id, or in the
    same id with an earlier start.  Windows are judged on the input.  Ids are integers; a null id comes before
    all others, and rows with one id are one document in different versions (equal starts in them are equally early,
    so a repeated row loses nothing to its twin).  Null and empty texts have no words.  Extra columns are not read.
    """
    plan = packed.layout(df, text_col, block_bytes, segment_windows)
    docs = packed.dealt(df, id_col, text_col, plan.blocks)
    counted = (
        docs.groupBy("block").applyInArrow(_count(plan, width), packed.SENT_DDL)
        .groupBy("segment").applyInArrow(_merge, packed.ANSWER_DDL).repartition("block"))
    grouped = (
        docs.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_candidates(plan, width), packed.SENT_DDL)
        .groupBy("segment").applyInArrow(_first, packed.ANSWER_DDL))
    replies = counted.unionByName(grouped)
    out = docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _remove(plan, width), "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept")
