"""Alignment of the tokens of two tokenizers by an associative composition of fragments.

Both tokenizers cut the same bytes.  Where tokens of both end at one byte, a group closes.  The tokens that end in a
range of bytes make a fragment: an open head (up to the first common end), closed groups, and an open tail (behind the
last one).  Two fragments that follow each other compose to one: the tail of the first and the head of the second
close one group, or, where a side has no common end, an open part grows.  Composition is associative, so the fragments
of a very long document lie in many tasks and are composed along a tree; a document of one range is done where it is
read.

Inside a group every stretch between two neighbouring token ends, of either side, is one overlapping pair of tokens: a
link.  How many documents hold an id pair linked is summed by Spark from counts per block of documents, and joined back
to the blocks' distinct pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repeatloom.llm.blocks import block_numbers, numbers, written
from repeatloom.llm.rows import quoted, release

#: Bytes of a range; a document of more has several fragments.
RANGE = 64 << 10
#: Bytes of text whose tokens are aligned at once, and of a block.
ALIGNED, BLOCK = 1 << 20, 6 << 20
#: Bytes of text that the tokenizers get at once.
PART = 128 << 10
#: Fragments that one step of the tree composes.
FAN = 8
_SHIFT = np.int64(32)
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Words and letters of words whose tokens a worker keeps.
KEPT_WORDS, KEPT_LETTERS = 1 << 19, 1 << 24


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Two tokenizers with the bytes of their tokens; A is byte-level BPE, B has pieces and byte fallback."""

    def __init__(self, a_json: bytes, b_model: bytes):
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        size = max(vocabulary.values()) + 1
        self.a_bytes: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_lengths = np.array([len(t) for t in self.a_bytes])
        self.b_lengths = np.array([len(t) for t in self.b_bytes])
        # No piece goes on behind a letter with a space, and A splits before single spaces: texts may be cut there.
        self.cuttable = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))
        #: What stands in the text of the groups for a token inside and at the end of its side of a group.
        self.shown = [f"{i}{s}" for i in range(size) for s in ",|"] + [f"{i}{s}" for i in range(len(self.b_bytes)) for s in ",;"]
        self.b_shown = 2 * size
        self._forget()

    def _forget(self) -> None:
        """Known words with their numbers; per number where its ids begin and whether both sides give the word back."""
        self.known: dict[str, int] = {}
        self.letters = 0
        self.same = np.zeros(0, bool)
        self.begins = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of about ``PART`` letters that are encoded alone as they are in the text; each leaves out a space before it."""
        begin = 0
        while self.cuttable and len(text) - begin > PART:
            cut = _BETWEEN.search(text, begin + PART)
            if cut is None:
                break
            yield text[begin:cut.start()]
            begin = cut.end()
        yield text[begin:]

    def _learn(self, words: list[str]) -> None:
        """Adds words that aren't known yet.

        Most are encoded as one text, which may be cut before each space between them; alone are those that begin or
        end with space (or its letter), and those of a text that isn't given back.
        """
        alone = [w for w in words if "▁" in w or w[0].isspace() or w[-1].isspace()]
        joined = list(set(words) - set(alone))
        new, begin = [], 0
        while begin < len(joined):
            end, size = begin, 0
            while end < len(joined) and size < PART:
                size += len(joined[end]) + 1
                end += 1
            new.append((joined[begin:end], self._encode_joined(joined[begin:end])))
            begin = end
        new.append((alone, None))
        for some, found in new:
            if found is None:
                pairs = self._encode_whole([w.encode() for w in some])
                found = [(np.concatenate([p[side] for p in pairs]), np.array([len(p[side]) for p in pairs]))
                         for side in (0, 1) if pairs]
            if not some:
                continue
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
            self.letters += sum(map(len, some))
            for side, (ids, sizes) in enumerate(found):
                self.ids[side] = np.concatenate([self.ids[side], ids])
                self.begins[side] = np.concatenate([self.begins[side], self.begins[side][-1] + np.cumsum(sizes)])
            self.same = np.concatenate([self.same, found[0][1] > 0])

    def _encode_joined(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """For both sides the ids of all words and how many each has."""
        coded = [w.encode() for w in words]
        sides, = self._encode_whole([b" ".join(coded)])
        if not len(sides[0]):
            return None
        ends = np.cumsum([len(w) + 1 for w in coded])
        return [(ids, np.diff(np.searchsorted(np.cumsum(lengths[ids]), ends, "right"), prepend=0))
                for ids, lengths in zip(sides, (self.a_lengths, self.b_lengths))]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none for empty texts and where the tokens' bytes aren't a space and the text.

        Texts that may be cut before single spaces are put together from their words, which are encoded once while kept.
        """
        if not self.cuttable:
            return self._encode_whole(texts)
        if len(self.known) > KEPT_WORDS or self.letters > KEPT_LETTERS:
            self._forget()
        words, counts = [], []
        for t in texts:
            try:
                some = _BETWEEN.split(t.decode()) if t else []
            except UnicodeDecodeError:  # no token has such bytes
                some = []
            words += some
            counts.append(len(some))
        fresh = list(set(words) - self.known.keys())
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        wrong = np.concatenate([[0], np.cumsum(~self.same[at])])[upto]
        good, sides = np.diff(wrong) == 0, []
        for begins, ids in zip(self.begins, self.ids):
            sizes = begins[at + 1] - begins[at]
            ends = np.cumsum(sizes)
            every = ids[np.repeat(begins[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            sides.append(np.split(every, np.concatenate([[0], ends])[upto[1:-1]]))
        none = np.zeros(0, np.int32)
        return [(a, b) if g else (none, none) for a, b, g in zip(*sides, good)] if texts else []

    def _encode_whole(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        whole = [t.decode("utf-8", "replace") for t in texts]
        parts = [list(self._parts(t)) if t else [] for t in whole]
        flat = [p for ps in parts for p in ps]
        a_ids, b_ids = [], []
        begin = 0
        while begin < len(flat):
            end, size = begin, 0
            while end < len(flat) and size < 2 * PART:
                size += len(flat[end])
                end += 1
            some = flat[begin:end]
            a_ids += [e.ids for e in self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)]
            b_ids += self.b.encode(some, num_threads=1)
            begin = end
        out, at = [], 0
        for text, ps in zip(texts, parts):
            a = [i for ids in a_ids[at:at + len(ps)] for i in ids] if len(ps) > 1 else a_ids[at] if ps else []
            b = [i for ids in b_ids[at:at + len(ps)] for i in ids] if len(ps) > 1 else b_ids[at] if ps else []
            at += len(ps)
            same = b" " + text
            if b"".join(map(self.a_bytes.__getitem__, a)) != same or b"".join(map(self.b_bytes.__getitem__, b)) != same:
                a = b = []
            out.append((np.array(a, np.int32), np.array(b, np.int32)))
        return out


@dataclass
class Aligned:
    """A run of bytes that begins and ends where both sides end tokens.

    ``a_end``, ``b_end``: whether a token ends a group; ``codes``: id pair of each link in order of bytes, and
    ``link_end``: whether a group ends with it.
    """

    a_end: np.ndarray
    b_end: np.ndarray
    codes: np.ndarray
    link_end: np.ndarray


def align(pair: Pair, a: np.ndarray, b: np.ndarray) -> Aligned:
    ends_a, ends_b = np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b])
    size = int(ends_a[-1]) if len(a) else 0
    at_a, at_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    at_a[ends_a], at_b[ends_b] = True, True
    marks = np.flatnonzero(at_a | at_b)
    of_a, of_b = at_a[marks], at_b[marks]
    codes = a[np.cumsum(of_a) - of_a].astype(np.int64) << _SHIFT | b[np.cumsum(of_b) - of_b]
    return Aligned(at_b[ends_a], at_a[ends_b], codes, of_a & of_b)


def shown_order(pair: Pair, a: np.ndarray, b: np.ndarray, run: Aligned) -> np.ndarray:
    """Numbers in ``pair.shown`` of all tokens, group by group, A before B."""
    group_a, group_b = np.cumsum(run.a_end) - run.a_end, np.cumsum(run.b_end) - run.b_end
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = 2 * a.astype(np.int64) + run.a_end
    out[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = pair.b_shown + 2 * b.astype(np.int64) + run.b_end
    return out


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, times = np.unique(codes, return_counts=True)
    return codes, times.astype(np.int64)


@dataclass
class Fragment:
    """What the tokens that end in one range of bytes come to.

    Without ``cut`` (a common end) all tokens are in the head.  ``text`` shows the closed groups, each with ``;`` behind.
    """

    cut: bool
    head_a: np.ndarray
    head_b: np.ndarray
    tail_a: np.ndarray
    tail_b: np.ndarray
    groups: int = 0
    text: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def closed(self, pair: Pair, a: np.ndarray, b: np.ndarray) -> Fragment:
        """Adds a run of closed groups behind those that are there."""
        if not len(a):
            return self
        run = align(pair, a, b)
        self.groups += int(run.link_end.sum())
        self.text += "".join(map(pair.shown.__getitem__, shown_order(pair, a, b, run).tolist()))
        return self.linked(*_counted(run.codes))

    def linked(self, pairs: np.ndarray, times: np.ndarray) -> Fragment:
        every, at = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        self.times = np.bincount(at, np.concatenate([self.times, times]), len(every)).astype(np.int64)
        self.pairs = every
        return self


def compose(pair: Pair, first: Fragment, second: Fragment) -> Fragment:
    join = np.concatenate
    if not first.cut:
        return Fragment(second.cut, join([first.head_a, second.head_a]), join([first.head_b, second.head_b]),
                        second.tail_a, second.tail_b, second.groups, second.text, second.pairs, second.times)
    if not second.cut:
        return Fragment(True, first.head_a, first.head_b, join([first.tail_a, second.head_a]),
                        join([first.tail_b, second.head_b]), first.groups, first.text, first.pairs, first.times)
    out = Fragment(True, first.head_a, first.head_b, second.tail_a, second.tail_b, first.groups, first.text,
                   first.pairs, first.times)
    out.closed(pair, join([first.tail_a, second.head_a]), join([first.tail_b, second.head_b]))
    out.groups += second.groups
    out.text += second.text
    return out.linked(second.pairs, second.times)


def whole(pair: Pair, fragment: Fragment) -> Fragment:
    """Closes the head of a whole document, whose tail is empty."""
    none = np.zeros(0, np.int32)
    out = Fragment(True, none, none, none, none).closed(pair, fragment.head_a, fragment.head_b)
    out.groups += fragment.groups
    out.text += fragment.text
    return out.linked(fragment.pairs, fragment.times)


def fragments(pair: Pair, a: np.ndarray, b: np.ndarray, size: int = RANGE) -> list[Fragment]:
    """The fragments of a document, one for each range of ``size`` bytes."""
    ends_a, ends_b = np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b])
    total = int(ends_a[-1]) if len(a) else 0
    out = []
    for begin in range(0, total, size):
        (a0, a1), (b0, b1) = (np.searchsorted(e, [begin, begin + size], "right") for e in (ends_a, ends_b))
        common = np.intersect1d(ends_a[a0:a1], ends_b[b0:b1], assume_unique=True)
        if not len(common):
            out.append(Fragment(False, a[a0:a1], b[b0:b1], a[:0], b[:0]))
            continue
        (a_first, a_last), (b_first, b_last) = (
            np.searchsorted(e, common[[0, -1]], "right") for e in (ends_a, ends_b))
        out.append(Fragment(True, a[a0:a_first], b[b0:b_first], a[a_last:a1], b[b_last:b1])
                   .closed(pair, a[a_first:a_last], b[b_first:b_last]))
    return out


_PAIRS: dict[str, Pair] = {}


def _pair(files: tuple[bytes, bytes]) -> Pair:
    """One pair of tokenizers for each worker process."""
    key = hashlib.sha256(b"".join(hashlib.sha256(f).digest() for f in files)).hexdigest()
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*files)
    return _PAIRS[key]


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
#: A block has several documents: their columns are arrays, ``at`` and ``times`` hold each one's distinct pairs (``held``
#: of them) as places in ``pairs``.  A fragment is one row, with ``row`` and ``range`` instead of ``block``.
_WRITTEN = pa.schema([
    ("block", pa.int64()), ("ids", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS),
    ("sha", pa.list_(pa.string())), ("held", _LONGS), ("pairs", _LONGS), ("at", _INTS), ("times", _INTS),
    ("row", pa.int64()), ("range", pa.int32()), ("ranges", pa.int32()), ("cut", pa.bool_()), ("head_a", _INTS),
    ("head_b", _INTS), ("tail_a", _INTS), ("tail_b", _INTS), ("groups", pa.int64()), ("text", pa.string())])
_DDL = ("block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "sha array<string>, held array<long>, pairs array<long>, at array<int>, times array<int>, row long, range int, "
        "ranges int, cut boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, "
        "groups long, text string")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in _WRITTEN]
    return pa.RecordBatch.from_arrays(columns, schema=_WRITTEN)


def _sha(text: str) -> str:
    return hashlib.sha256(text[:-1].encode()).hexdigest() if text else ""


class _Block:
    """Documents on their way into one row."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, runs: list[tuple[np.ndarray, np.ndarray]], pair: Pair) -> None:
        """Aligns documents in one go: each ends where both sides end tokens."""
        a, b = (np.concatenate([r[s] for r in runs]) for s in (0, 1))
        n_a, n_b = (np.array([len(r[s]) for r in runs]) for s in (0, 1))
        if not len(a):
            self._append(ids, n_a, n_b, n_a, n_a, [""] * len(ids), n_a, np.zeros(0, np.int64), np.zeros(0, np.int64))
            return
        run = align(pair, a, b)
        # The document of a link: its last A token's, counted from the groups that end before it.
        groups_upto = np.concatenate([[0], np.cumsum(run.a_end)])
        ends = np.cumsum(n_a)
        n_groups = groups_upto[ends] - groups_upto[ends - n_a]
        group_of = np.cumsum(run.link_end) - run.link_end
        doc_of_group = np.repeat(np.arange(len(ids)), n_groups)
        doc = doc_of_group[group_of]
        n_links = np.bincount(doc, minlength=len(ids))
        width = len(pair.a_bytes) * len(pair.b_bytes)
        keys, times = _counted(doc * width + (run.codes >> _SHIFT) * len(pair.b_bytes) + (run.codes & 0xFFFFFFFF))
        held = np.bincount(keys // width, minlength=len(ids))
        keys %= width
        codes = keys // len(pair.b_bytes) << _SHIFT | keys % len(pair.b_bytes)
        order = shown_order(pair, a, b, run)
        shas, begin = [], 0
        for n in (n_a + n_b).tolist():
            shas.append(_sha("".join(map(pair.shown.__getitem__, order[begin:begin + n].tolist()))))
            begin += n
        self._append(ids, n_a, n_b, n_groups, n_links, shas, held, codes, times)

    def _append(self, ids, n_a, n_b, n_groups, n_links, shas, held, codes, times) -> None:
        self.docs += zip(ids, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), shas, held.tolist())
        self.pairs.append(codes)
        self.times.append(times)

    def row(self, number: int) -> dict:
        ids, n_a, n_b, n_groups, n_links, sha, held = map(list, zip(*self.docs))
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        return {"block": number, "ids": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                "sha": sha, "held": held, "pairs": pairs, "at": at.astype(np.int32),
                "times": np.concatenate(self.times).astype(np.int32)}


def _encoded(files, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of documents of one range, and fragments of longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, fresh, rows = _pair(files.value), block_numbers(), block_numbers()
        block, ids, texts, waiting = _Block(), [], [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, waiting
            short_ids, short = [], []
            for key, text, (a, b) in zip(ids, texts, pair.encode(texts)):
                if len(text) < size or not len(a):
                    short_ids.append(key)
                    short.append((a, b))
                    continue
                row, found = next(rows), fragments(pair, a, b, size)
                n_a, n_b = len(a), len(b)
                for i, f in enumerate(found):
                    yield _batch([{
                        "ids": [key], "n_a": [n_a], "n_b": [n_b], "row": row, "range": i, "ranges": len(found),
                        **_fragment_columns(f)}])
            if short:
                block.add(short_ids, short, pair)
            block.size += waiting
            ids, texts, waiting = [], [], 0

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                ids.append(key.as_py())
                texts.append(text.as_py() or b"")
                waiting += len(texts[-1]) + 64
                if waiting >= ALIGNED:
                    yield from settle()
                    if block.size >= BLOCK and block.docs:
                        yield _batch([block.row(next(fresh))])
                        block = _Block()
                        release()
        yield from settle()
        if block.docs:
            yield _batch([block.row(next(fresh))])
        release()
    return run


def _fragment_columns(f: Fragment) -> dict:
    return {"cut": f.cut, "head_a": f.head_a, "head_b": f.head_b, "tail_a": f.tail_a, "tail_b": f.tail_b,
            "groups": f.groups, "text": f.text, "pairs": f.pairs, "times": f.times}


def _fragment(table: pa.Table, i: int) -> Fragment:
    arrays = [numbers(table.column(c), i).astype(np.int32) for c in ("head_a", "head_b", "tail_a", "tail_b")]
    return Fragment(table.column("cut")[i].as_py(), *arrays, table.column("groups")[i].as_py(),
                    table.column("text")[i].as_py(), numbers(table.column("pairs"), i),
                    numbers(table.column("times"), i).astype(np.int64))


def _composed(files):
    def run(table: pa.Table) -> pa.Table:
        pair, order = _pair(files.value), np.argsort(table.column("range").to_numpy())
        out = _fragment(table, int(order[0]))
        for i in order[1:]:
            out = compose(pair, out, _fragment(table, int(i)))
        first = int(order[0])
        same = {c: table.column(c)[first].as_py() for c in ("ids", "n_a", "n_b", "row", "ranges")}
        return pa.Table.from_batches([_batch([
            {**same, "range": int(table.column("range")[first].as_py()) // FAN, **_fragment_columns(out)}])])
    return run


def _finished(files):
    """Blocks of one document each from composed fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files.value)
        for batch in batches:
            for i in range(batch.num_rows):
                f = whole(pair, _fragment(batch, i))
                same = {c: batch.column(c)[i].as_py() for c in ("ids", "n_a", "n_b")}
                yield _batch([{
                    **same, "block": -1 - batch.column("row")[i].as_py(), "n_groups": [f.groups],
                    "n_links": [int(f.times.sum())], "sha": [_sha(f.text)], "held": [len(f.pairs)], "pairs": f.pairs,
                    "at": np.arange(len(f.pairs), dtype=np.int32), "times": f.times}])
    return run


def aligned_blocks(
    docs: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE,
) -> DataFrame:
    """Documents in blocks with their groups and distinct links; see ``_WRITTEN``.  Written to the shared folder."""
    files = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    made = written(docs.select(quoted(id_col).cast("long"), quoted(text_col)).mapInArrow(_encoded(files, size), _DDL), "aligned")
    parts = made.where("row IS NOT NULL")
    most = parts.agg(F.max("ranges")).first()[0] or 0
    while most > 1:
        parts = parts.groupBy("row", F.expr(f"range div {FAN}").alias("_step")).applyInArrow(_composed(files), _DDL)
        most = -(-most // FAN)
    finished = written(parts.mapInArrow(_finished(files), _DDL), "composed")
    return made.where("row IS NULL").unionByName(finished).select(*_WRITTEN.names[:11])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            pairs = numbers(batch.column("pairs"), i)
            n = np.bincount(numbers(batch.column("at"), i), minlength=len(pairs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), batch.column("block")[i].as_py(), np.int64)), pa.array(pairs),
                 pa.array(n.astype(np.int64))], names=["block", "pair", "n"])
        release()


_RESULT = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in (
    "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
_RESULT_DDL = ("id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
               "groups_sha256 string")


def _weighed(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of a block with the sums of their links' counts."""
    if not blocks.num_rows:
        return _RESULT.empty_table()
    order = np.argsort(found.column("pair").to_numpy())
    n = found.column("n").to_numpy()[order]
    best = found.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[order]
    at, times = numbers(blocks.column("at"), 0), numbers(blocks.column("times"), 0).astype(np.int64)
    upto = np.cumsum(numbers(blocks.column("held"), 0))
    sums = [np.diff(np.concatenate([[0], np.cumsum(times * values[at])])[np.concatenate([[0], upto])])
            for values in (best, n)]
    column = lambda c: blocks.column(c)[0].values
    out = [column("ids"), *(column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), column("sha")]
    release()
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(out, _RESULT)], schema=_RESULT)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: how many documents link an id pair (A's id in the high half), and whether no pair of the
    same A id has more."""
    sums = blocks.select("block", "pairs", "at").mapInArrow(_document_counts, "block long, pair long, n long").groupBy(
        "pair").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return sums.withColumn("best", F.col("n") == top)


def token_alignment(
    docs: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens: zeros and an
    empty digest.  A null id stays null; repeated rows are documents of their own and count as such; an empty table
    gives no rows; columns other than the two named aren't read.  ``size``: bytes of a range.
    """
    blocks = aligned_blocks(docs, a_json, b_model, id_col, text_col, size)
    counts = written(pair_counts(blocks), "pairs")
    held = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    found = held.join(counts, "pair").select("of", "pair", "n", "best")
    return (
        blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_weighed, _RESULT_DDL)
        .withColumnRenamed("id", id_col))
