"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the last token of its encoding is unique: it is the one vocabulary token that ends
there, that encodes to itself, and that fits behind the last token of the prefix before it.  Two tokens fit if
merging their joined bytes gives back exactly these two.  The table of last tokens is all the state there is: walking
it backwards gives the ids, more bytes append to it, and after an edit it is redone only until it agrees with the old
table over one longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from repeatloom.llm.rows import map_texts

#: Entries that a process keeps in each of its tables; a full table is emptied, which costs time and changes nothing.
KEPT = 150_000
KEPT_CHUNKS = 350_000
#: Bytes up to which a piece's table is filled only where its encoding needs it.
LAZY = 200


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 bytes and rank in each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class PrefixEncoder:
    """Encodes pieces (matches of the split pattern) of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._fits: dict[tuple[int, int], bool] = {}
        #: Prefix of a piece -> the last token of its encoding, which is the same in every piece.
        self._ends: dict[bytes, int] = {}
        #: The two tokens that a token's last merge joins, () for bytes; tokens that merges don't give are left out.
        self.halves: dict[int, tuple[int, ...]] = {}
        for token, rank in ranks.items():
            ids, last = self._merge(token)
            if ids == [rank]:
                self.halves[rank] = last
        self.usable = {self.tokens[i]: i for i in self.halves}

    def forget(self) -> None:
        self._fits.clear()
        self._ends.clear()

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        return self._merge(piece)[0]

    def _merge(self, piece: bytes) -> tuple[list[int], tuple[int, ...]]:
        parts, last = [piece[i:i + 1] for i in range(len(piece))], ()
        while len(parts) > 1:
            found = [(self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks]
            if not found:
                break
            at = min(found)[1]
            last = self.ranks[parts[at]], self.ranks[parts[at + 1]]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts], last

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives back these two tokens.

        Undoes the merges on both sides of the border, latest first.  A merge across the border that would have come
        before the one just undone means that the tokens don't fit; of equal ranks the left one comes first.
        """
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        a, b, limit, fit = left, right, 1 << 60, True
        while True:
            if ranks.get(tokens[a] + tokens[b], limit) < limit:
                fit = False
                break
            of_a, of_b = halves[a], halves[b]
            if of_a and (not of_b or a > b):
                limit, a = a, of_a[1]
            elif of_b:
                limit, b = b + 1, of_b[0]
            else:
                break
        if len(self._fits) >= KEPT:
            self._fits.clear()
        self._fits[left, right] = fit
        return fit

    def extend(self, piece: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Adds the last tokens of the prefixes behind ``len(last)`` bytes; ``last[i]`` is that of ``piece[:i + 1]``."""
        token_at, known, longest = self.usable.get, self._fits.get, self.longest
        for end in range(len(last) + 1, (len(piece) if upto is None else upto) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = token_at(piece[begin:end])
                if token is not None:
                    if begin == 0:
                        break
                    fit = known((last[begin - 1], token))
                    if fit or fit is None and self.fits(last[begin - 1], token):
                        break
            else:
                raise ValueError(f"byte {piece[end - 1]} has no token")
            last.append(token)
        return last

    def edit(self, old: bytes, last: list[int], new: bytes, begin: int, removed: int, added: int) -> list[int]:
        """Table of ``new``, which is ``old`` with ``removed`` bytes at ``begin`` replaced by ``added`` ones."""
        table = last[:begin]
        shift, agree = added - removed, 0
        while len(table) < len(new):
            self.extend(new, table, len(table) + 1)
            at = len(table) - 1 - shift
            same = len(table) > begin + added and table[-1] == last[at]
            agree = agree + 1 if same else 0
            if agree >= self.longest:
                return table + last[at + 1:]
        return table

    def walk(self, last: list[int]) -> list[int]:
        """Ids behind a table of last tokens."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token, as in the library that reads these files."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LAZY:
            return self.walk(self.extend(piece, []))
        if len(self._ends) >= KEPT:
            self._ends.clear()
        last, ids, end = [-1] * (len(piece) + 1), [], len(piece)
        while end:
            token = last[end]
            if token < 0:  # only the whole piece: the prefixes behind its tokens were asked for on the way
                token = self._last(piece, end, last)
            ids.append(token)
            end -= len(self.tokens[token])
        return ids[::-1]

    def _last(self, piece: bytes, end: int, last: list[int]) -> int:
        """Fills ``last[end]``, and of the shorter prefixes only those that it is decided by."""
        token_at, known, ends = self.usable.get, self._fits.get, self._ends
        for begin in range(end - self.longest if end > self.longest else 0, end):
            token = token_at(piece[begin:end])
            if token is not None:
                if begin == 0:
                    break
                left = last[begin]
                if left < 0:
                    prefix = piece[:begin]
                    left = last[begin] = ends.get(prefix, -1)
                    if left < 0:
                        left = ends[prefix] = self._last(piece, begin, last)
                fit = known((left, token))
                if fit or fit is None and self.fits(left, token):
                    break
        else:
            raise ValueError(f"byte {piece[end - 1]} has no token")
        last[end] = token
        return token


class TextEncoding:
    """Encoding of a growing text: only the last piece can change when text is appended."""

    def __init__(self, encoder: PrefixEncoder, pattern: str):
        self.encoder, self.split = encoder, regex.compile(pattern)
        self.settled: list[int] = []
        self.tail, self.table = "", []

    def append(self, text: str) -> TextEncoding:
        old = self.tail.encode()
        pieces = self.split.findall(self.tail + text)
        for piece in pieces[:-1]:
            self.settled += self.encoder.encode(piece.encode())
        if pieces:
            data = pieces[-1].encode()
            keep = len(pieces) == 1 and data.startswith(old)
            self.table = self.encoder.extend(data, self.table if keep else [])
            self.tail = pieces[-1]
        return self

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.tail.encode())
        return self.settled + ([whole] if whole is not None else self.encoder.walk(self.table))


class _Pieces(dict):
    """Piece -> its ids, joined by commas."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        joined = self[piece] = ",".join(map(str, self.encoder.encode(piece.encode())))
        return joined


class _Chunks(dict):
    """What stands behind a single space -> ids of the space and it, joined by commas."""

    def __init__(self, pieces: _Pieces, split: regex.Pattern):
        super().__init__()
        self.pieces, self.split = pieces, split

    def __missing__(self, chunk: str) -> str:
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        if chunk.isalpha():  # the usual case: one piece, which needs no second entry
            joined = ",".join(map(str, self.pieces.encoder.encode((" " + chunk).encode())))
        elif (word := chunk[:-1]).isalpha() and chunk[-1] in ",.;:!?":
            joined = f"{self[word]},{self.pieces[chunk[-1]]}"
        else:
            joined = ",".join(map(self.pieces.__getitem__, self.split.findall(" " + chunk)))
        self[chunk] = joined
        return joined


#: A space with white space beside it.
_WIDE = re.compile(r" \s|\s ")


class Codec:
    """Encodes and decodes whole texts.

    The pattern of these vocabularies always begins a piece at a space that stands between two characters that are no
    white space.  So texts without wider gaps are cut at their spaces, and known chunks are looked up.
    ``space_starts`` says that the pattern has this property; without it every text is split by the pattern.
    """

    def __init__(self, data: bytes, pattern: str, space_starts: bool = True):
        encoder = PrefixEncoder(read_ranks(data))
        self.split = regex.compile(pattern)
        self.pieces = _Pieces(encoder)
        self.chunks = _Chunks(self.pieces, self.split)
        self.tokens = {str(i): t for i, t in encoder.tokens.items()}
        self.space_starts = space_starts

    def encode(self, text: str) -> str:
        """Ids joined by commas."""
        if not self.space_starts or _WIDE.search(text):
            return ",".join(map(self.pieces.__getitem__, self.split.findall(text)))
        first, *rest = text.split(" ")
        begin = [",".join(map(self.pieces.__getitem__, self.split.findall(first)))] if first else []
        return ",".join(chain(begin, map(self.chunks.__getitem__, rest)))

    def forget(self) -> None:
        """Empties the tables that grow with the texts."""
        self.chunks.clear()
        self.pieces.clear()
        self.pieces.encoder.forget()

    def decode(self, parts: list[str]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, parts))


#: One codec for each vocabulary and worker process; what it learns from texts goes at the end of a task.
_CODECS: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str, space_starts: bool) -> Codec:
    key = hashlib.sha256(data).hexdigest(), pattern, space_starts
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern, space_starts)
    return _CODECS[key]


def encoded(
    df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    describe: Callable[[str, bytes], tuple] | None = None, fields: Iterable[T.StructField] = (),
    space_starts: bool = True,
) -> DataFrame:
    """Encodes whole texts and decodes the ids again, one row per input row.

    ``ranks`` is the content of a rank file (under 1 MB; it travels with the tasks, so executors need no file).
    Without ``describe`` the columns are ``id_col``, ``n_tokens``, ``ids`` (array) and ``decoded`` (bytes).  With it,
    ``describe(ids joined by commas, decoded bytes)`` gives the columns of ``fields`` in place of the last two, and
    long texts send no arrays back.  Null and empty texts have no ids.  Repeated rows are encoded each.  Other columns of ``df``
    are not read.
    """
    id_type = df.schema[id_col].dataType
    own = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()),
                           *(fields if describe else own)])
    files = df.sparkSession.sparkContext.broadcast(ranks)
    give = describe or (lambda ids, data: ([int(i) for i in ids.split(",") if i], data))

    def start():
        own_codec = codec(files.value, pattern, space_starts)

        def each(key, text):
            ids = own_codec.encode((text or b"").decode("utf-8", "replace"))
            parts = ids.split(",") if ids else []
            yield (key, len(parts), *give(ids, own_codec.decode(parts)))
        return each

    return map_texts(df, [id_col, text_col], schema, start, forget)


def forget() -> None:
    for known in _CODECS.values():
        known.forget()
