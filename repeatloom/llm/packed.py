"""Hashes of word runs in blocks of documents, and their exchange in packed form.

Documents are dealt out to blocks of a few MB by a hash of the row.  A block hashes all its word runs at once with
numpy.  What has to meet across blocks is sorted, cut by value into segments and sent as one binary row per
(block, segment); the segment's task answers with one code per entry sent.  So millions of runs move as a few thousand
rows, no task holds more than a block or a segment, and a task that is lost is simply done again: nothing depends on
where or when it ran.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.llm.rows import LOWER_TABLE, quoted, release

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word that are hashed by table; longer words are hashed by digest.
SHORT = 64
#: For each hash stream a random number for each byte at each place of a short word: sums of these have no structure
#: that texts could hit, as sums of powers modulo 2 ** 64 have.
_BYTE = [np.random.default_rng(seed).integers(0, 2**64, SHORT * 256, np.uint64) for seed in (1, 2)]
#: Multipliers (odd) of words in runs.
_WORD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Bytes hashed at once inside a block.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Layout:
    """How many blocks and segments there are, and how many bits a counter's number has."""

    blocks: int
    segments: int
    bits: int

    def first_of(self, bits: int) -> np.ndarray:
        """Smallest ``bits``-bit value of each segment, and the end."""
        return np.array([-(-(s << bits) // self.segments) for s in range(self.segments)], np.uint64)


def layout(df: DataFrame, text_col: str, block_bytes: int, segment_runs: int) -> Layout:
    """Sizes from the bytes of all texts (one sum): counters are 32 times as many as runs can be, about."""
    total = df.agg(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0
    runs = max(1, total // 5)
    return Layout(max(1, math.ceil(total / block_bytes)), max(1, math.ceil(runs / segment_runs)),
                  min(60, max(24, math.ceil(math.log2(runs)) + 5)))


def dealt(df: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """``block, id, text``; the block hangs on the whole row, so that rows of one id need not meet."""
    return df.select(
        F.pmod(F.xxhash64(quoted(id_col), quoted(text_col)), F.lit(blocks)).alias("block"),
        quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class BlockWords:
    """Word hashes (64 bits for each stream) of a list of texts, in order."""

    def __init__(self, texts: Sequence[bytes | None], lower: bool = False, streams: int = 1):
        hashes: list[list[np.ndarray]] = [[] for _ in range(streams)]
        counts: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text or b"")
            size += len(group[-1])
            if size >= CHUNK:
                self._add(group, lower, hashes, counts)
                group, size = [], 0
        if group:
            self._add(group, lower, hashes, counts)
        empty = np.zeros(0, np.uint64)
        self.hashes = [np.concatenate(h) if h else empty for h in hashes]
        #: Words of each text.
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    @staticmethod
    def _add(group: list[bytes], lower: bool, hashes: list, counts: list) -> None:
        data = b" ".join(group) + b" "
        raw = np.frombuffer(data.translate(LOWER_TABLE) if lower else data, np.uint8)
        blank = _SPACES[raw]
        begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        text_ends = np.cumsum([len(t) + 1 for t in group])
        upto = np.searchsorted(begins, text_ends)
        counts.append(np.diff(upto, prepend=0))
        if not len(begins):
            return
        ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        lengths = ends - begins
        solid = raw[~blank]
        offsets = np.cumsum(lengths) - lengths
        place = (np.arange(len(solid)) - np.repeat(offsets, lengths)) % SHORT * 256 + solid
        long = np.flatnonzero(lengths > SHORT)
        for s, out in enumerate(hashes):
            h = mixed(np.add.reduceat(_BYTE[s][place], offsets) + lengths.astype(np.uint64))
            for i in long:
                word = raw[begins[i]:ends[i]].tobytes()
                h[i] = int.from_bytes(blake2b(word, digest_size=8, salt=bytes([s])).digest(), "little")
            out.append(h)

    def runs(self, stream: int, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word on; the last ``width - 1`` places of the block are left out."""
        h, q = self.hashes[stream], _WORD[stream]
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        done, covered = None, 0
        step, of, power = 1, h, q
        left = width
        while left:
            if left & 1:  # the run so far, then ``step`` more words
                if done is None:
                    done, covered = of, step
                else:
                    m = min(len(done), len(of) - covered)
                    done, covered = done[:m] * power + of[covered:covered + m], covered + step
            left >>= 1
            if left:
                of = of[:-step] * power + of[step:]
                with np.errstate(over="ignore"):
                    step, power = step * 2, power * power
        return mixed(done[:n])

    def run_places(self, width: int) -> np.ndarray:
        """Words at which a run of ``width`` words of one text begins."""
        own = np.maximum(self.counts - width + 1, 0)
        return np.arange(own.sum()) + np.repeat(self.starts - (np.cumsum(own) - own), own)


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, so that equal high bytes lie together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, n), dtype=np.uint64)


def cut(values: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, begin, end) of the non-empty segments of sorted values."""
    at = np.append(np.searchsorted(values, firsts), len(values))
    return [(s, int(at[s]), int(at[s + 1])) for s in range(len(firsts)) if at[s] < at[s + 1]]


def message(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    release()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) \
        if rows else schema.empty_table()


def texts_of(table: pa.Table) -> list[bytes | None]:
    column = table.column("text")
    return column.cast(pa.large_binary()).to_pylist()


SENT = pa.schema([("segment", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
SENT_DDL = "segment long, block long, n long, data binary"
ANSWER = pa.schema([("block", pa.int64()), ("segment", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
ANSWER_DDL = "block long, segment long, kind int, data binary"


def answers(table: pa.Table, kind: int) -> list[bytes]:
    """Payloads of one kind in order of segment, which is the order of the values sent."""
    rows = sorted((r["segment"], r["data"]) for r in table.to_pylist() if r["kind"] == kind)
    return [d for _, d in rows]


def flags(table: pa.Table, kind: int, sizes: list[int]) -> np.ndarray:
    """Answers of one bit per entry; ``sizes``: entries sent to each segment in order."""
    found = answers(table, kind)
    if len(found) != len(sizes):
        raise ValueError(f"{len(found)} answers to {len(sizes)} messages")
    parts = [np.unpackbits(np.frombuffer(d, np.uint8), count=n) for d, n in zip(found, sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
