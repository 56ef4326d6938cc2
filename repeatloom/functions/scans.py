"""Motif scans of whole Arrow batches: one table lookup per letter and motif length for all families together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A, C, G, T are 0 to 3, any other letter is 4; a word of k letters is a number to the base 5.
_DIGIT = bytes(b"ACGT".find(b) % 5 for b in range(256))
#: Letters that are looked up at once, so that the numbers of their words stay in the processor's cache.
_SLAB = 1 << 18
LONGEST = 8
RUNS = "array<array<struct<start:int,end:int>>>"
WORD_COUNTS = "kmer string, n_seqs long, n_total long"
#: Letters whose words are counted at once, if one text is not longer.
_COUNTED = 1 << 22
#: Up to so many possible words are counted in a table for the whole task.
_DENSE = 1 << 20
_DNA = np.frombuffer(b"ACGTN", np.uint8)

Sets = tuple[tuple[str, ...], ...]


def can_scan(kmers: Sequence[str]) -> bool:
    """Equally long words of at most eight letters A, C, G, T, or '.' for any letter."""
    return len({len(m) for m in kmers}) == 1 and 0 < len(kmers[0]) <= LONGEST and set("".join(kmers)) <= set("ACGT.")


def _freeze(sets: Sequence[Sequence[str]]) -> Sets:
    return tuple(tuple(s) for s in sets)


@lru_cache(maxsize=64)
def _tables(sets: Sets) -> dict[int, tuple[list[int], np.ndarray]]:
    """Per word length: the sets of that length, and for each word's number a bit per set that has it."""
    out = {}
    for k in sorted({len(s[0]) for s in sets}):
        mine = [i for i, s in enumerate(sets) if len(s[0]) == k]
        table = np.zeros(5 ** k, np.uint8 if len(mine) <= 8 else np.uint32 if len(mine) <= 32 else np.uint64)
        for bit, i in enumerate(mine):
            for word in sets[i]:
                for digits in product(*[range(5) if c == "." else ("ACGT".index(c),) for c in word]):
                    table[sum(d * 5 ** (k - 1 - j) for j, d in enumerate(digits))] |= table.dtype.type(1 << bit)
        out[k] = mine, table
    return out


@lru_cache(maxsize=64)
def _any(sets: Sets) -> tuple[int, np.ndarray]:
    """The longest word length, and for each word's number of that length if a word of any set stands at its begin."""
    tables = _tables(sets)
    longest = max(tables)
    out = np.zeros(5 ** longest, bool)
    for k, (_, table) in tables.items():
        out |= np.repeat(table != 0, 5 ** (longest - k))
    return longest, out


def _letters(texts: pa.Array, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch, or one byte per letter with ``whole``, and the borders of the texts; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, borders, data = texts.buffers()
    ends = np.frombuffer(borders, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    if whole and len(raw) and raw.max() > 127:  # UTF-8: further bytes of a letter are left out
        begins = (raw & 0xC0) != 0x80
        ends = np.concatenate(([0], np.cumsum(begins)))[ends]
        raw = raw[begins]
    return raw, ends


def _digits(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().translate(_DIGIT), np.uint8)


def _words(digit: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the words of ``k`` letters that begin at each place."""
    m = len(digit) - k + 1
    if k <= 3:
        number = digit[:m].astype(np.uint16)
        for j in range(1, k):
            number = number * np.uint16(5) + digit[j:j + m]
        return number
    two = digit[:-1] * np.uint8(5) + digit[1:]
    four = two[:-2].astype(np.uint16) * np.uint16(25) + two[2:]
    if k == 4:
        return four
    if k == 5:
        return four[:m] * np.uint16(5) + digit[4:4 + m]
    if k == 6:
        return four[:m] * np.uint16(25) + two[4:4 + m]
    if k == 7:
        return (four[:m].astype(np.uint32) * np.uint32(25) + two[4:4 + m]) * np.uint32(5) + digit[6:6 + m]
    return four[:m].astype(np.uint32) * np.uint32(625) + four[4:4 + m]


def _hits(raw: np.ndarray, ends: np.ndarray, sets: Sets) -> list[np.ndarray]:
    """Places at which a word of each set starts, in the letters of the whole batch.

    One lookup per letter, of the longest word there, finds the places where any set has a word; only these are looked
    up for each length.
    """
    tables = _tables(sets)
    longest, some = _any(sets)
    found: list[list[np.ndarray]] = [[] for _ in sets]
    beyond = np.full(longest - 1, 4, np.uint8)
    for at in range(0, len(raw), _SLAB):
        digit = _digits(raw[at:at + _SLAB + longest - 1])
        if len(digit) < _SLAB + longest - 1:
            digit = np.concatenate((digit, beyond))
        number = _words(digit, longest)[:_SLAB]
        places = np.flatnonzero(np.take(some, number, mode="clip"))  # no number is too large; the mode is faster
        number = number[places].astype(np.int32)
        left = ends[np.searchsorted(ends, places + at, side="right")] - at - places  # letters up to the text's end
        for k, (mine, table) in tables.items():
            marks = table[number // 5 ** (longest - k)]
            marks[left < k] = 0
            for bit, i in enumerate(mine):
                found[i].append(places[np.flatnonzero(marks & table.dtype.type(1 << bit))] + at)
    return [np.concatenate(f) if f else np.empty(0, np.int64) for f in found]


@lru_cache(maxsize=64)
def _bits(sets: Sets) -> tuple[int, np.ndarray, list[tuple[int, np.generic]]]:
    """The longest word length, for each word's number of that length a bit per set that has a word at its begin, and
    per length the bits of its sets."""
    longest = max(_tables(sets))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(sets) <= 8 * np.dtype(t).itemsize)
    out, masks = np.zeros(5 ** longest, kind), []
    for k, (mine, table) in _tables(sets).items():
        bits = np.zeros(5 ** k, kind)
        for bit, i in enumerate(mine):
            bits |= np.where(table & table.dtype.type(1 << bit), kind(1 << i), kind(0))
        out |= np.repeat(bits, 5 ** (longest - k))
        masks.append((k, kind(sum(1 << i for i in mine))))
    return longest, out, masks


def _marks(raw: np.ndarray, ends: np.ndarray, sets: Sets) -> Iterator[tuple[int, int, np.ndarray]]:
    """Per slab its begin, the place of the first mark, some letters before, and at each place a bit per set with a word there."""
    longest, table, masks = _bits(sets)
    for at in range(0, len(raw), _SLAB):
        first, upto = max(0, at - longest + 1), min(len(raw), at + _SLAB)
        digit = _digits(raw[first:upto + longest - 1])
        digit = np.concatenate((digit, np.full(upto - first + longest - 1 - len(digit), 4, np.uint8)))
        bits = np.take(table, _words(digit, longest), mode="clip")  # none is too large; the mode is faster
        last = np.unique(ends[np.searchsorted(ends, first, side="right"):np.searchsorted(ends, upto + longest)]) - first
        for k, mask in masks:
            for j in range(1, k):  # words across the end of a text
                there = last - j
                bits[there[(there >= 0) & (there < len(bits))]] &= ~mask
        yield at, first, bits


def _stretches(
    raw: np.ndarray, ends: np.ndarray, sets: Sets, reach: int | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, text and bits of the longest stretches of a text that lie under hits of the same sets.

    A hit reaches over its own length, or over ``reach`` letters of it.  The work is the same however many hits there are:
    inside an array, where each letter begins a hit, nothing is kept per hit.
    """
    parts = []
    for at, first, bits in _marks(raw, ends, sets):
        cover = np.zeros_like(bits)
        for k, mask in _bits(sets)[2]:
            mine, done, far = bits & mask, 1, min(reach or k, k)
            while done < far:
                step = min(done, far - done)
                mine[step:] |= mine[:-step]
                done += step
            cover |= mine
        cover = cover[at - first:]
        new = np.r_[True, cover[1:] != cover[:-1]]
        new[ends[np.searchsorted(ends, at):np.searchsorted(ends, at + len(cover))] - at] = True
        begin = np.flatnonzero(new)
        end, value = np.append(begin[1:], len(cover)), cover[begin]
        under = np.flatnonzero(value)
        parts.append((begin[under] + at, end[under] + at, value[under]))
    if not parts:
        nothing = np.empty(0, np.int64)
        return nothing, nothing, nothing, np.empty(0, _bits(sets)[1].dtype)
    begin, end, value = (np.concatenate(x) for x in zip(*parts))
    return begin, end, np.searchsorted(ends, begin, side="right") - 1, value


def _sums(raw: np.ndarray, ends: np.ndarray, sets: Sets, reach: int | None = None) -> np.ndarray:
    """Letters under hits of each set (rows) in each text."""
    out = []
    for at in range(0, len(sets), 64):
        some = sets[at:at + 64]
        begin, end, text, value = _stretches(raw, ends, some, reach)
        for i in range(len(some)):
            mine = np.flatnonzero(value & value.dtype.type(1 << i))
            out.append(np.bincount(text[mine], (end - begin)[mine], len(ends) - 1).astype(np.int64))
    return np.stack(out)


def _lists(values: pa.Array, borders: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(borders.astype(np.int32)), values, mask=None if missing is None else pa.array(missing))


def _missing(texts: pa.Array) -> np.ndarray | None:
    return texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None


def kept_letters(text: Column, letters: str, images: str) -> Column:
    """``text`` without all but some ASCII ``letters``, each replaced by the image at its place; null for null."""
    table = bytes.maketrans(letters.encode("ascii"), images.encode("ascii"))
    rest = bytes(set(range(256)) - set(letters.encode("ascii")))

    def change(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary()).to_pylist()
        return pa.array([None if t is None else t.translate(table, rest) for t in raw], pa.string())

    return _udf(change, "string")(text)


def covered(seq: Column, sets: Sequence[Sequence[str]]) -> Column:
    """``array<bigint>``: letters that lie under a hit of each set; null for null."""
    sets = _freeze(sets)

    def scan(texts: pa.Array) -> pa.Array:
        raw, ends = _letters(texts, whole=True)
        values = pa.array(_sums(raw, ends, sets).T.ravel())
        return _lists(values, np.arange(len(texts) + 1) * len(sets), _missing(texts))

    return _udf(scan, "array<bigint>")(seq)


def counts(seq: Column, sets: Sequence[Sequence[str]]) -> Column:
    """``array<bigint>``: places at which a word of each set starts; null for null."""
    sets = _freeze(sets)

    def scan(texts: pa.Array) -> pa.Array:
        raw, ends = _letters(texts, whole=True)
        values = pa.array(_sums(raw, ends, sets, 1).T.ravel())
        return _lists(values, np.arange(len(texts) + 1) * len(sets), _missing(texts))

    return _udf(scan, "array<bigint>")(seq)


def _fits(end: str, word: str) -> bool:
    """Can a word begin with ``end``?"""
    return all(a == b or "." in (a, b) for a, b in zip(end, word))


def _overlapping(raw: np.ndarray, ends: np.ndarray, words: Sets) -> Iterator[tuple[int, np.ndarray]]:
    """For words that do, the number and the hits that overlap the counted one of the same word before."""
    for at in range(0, len(words), 64):
        some = words[at:at + 64]
        close: list[list[np.ndarray]] = [[] for _ in some]
        for _, first, bits in _marks(raw, ends, some):
            for d in range(1, max(len(w) for w, in some)):
                mask = sum(1 << i for i, (w,) in enumerate(some) if len(w) > d)
                again = bits[d:] & bits[:-d] & bits.dtype.type(mask)
                if not len(again) or not again.max():
                    continue
                there = np.flatnonzero(again)
                again = again[there]
                for i in range(len(some)):
                    mine = there[np.flatnonzero(again & bits.dtype.type(1 << i))] + first
                    close[i] += [mine, mine + d]
        for i, ((word,), found) in enumerate(zip(some, close)):
            left, last = [], -len(word)
            for place in np.unique(np.concatenate(found)).tolist() if found else ():
                if place - last < len(word):
                    left.append(place)
                else:
                    last = place
            if left:
                yield at + i, np.array(left)


def _separate_counter(sets: Sequence[Sequence[str]]) -> Callable[[pa.Array], np.ndarray]:
    """Counts hits that don't overlap the one of the same word before, per set and text; words that can overlap
    themselves are looked at again, where they do."""
    sets = _freeze(sets)
    plain = all(len(set(s)) == len(s) and "." not in "".join(s) for s in sets)
    count_as = sets if plain else tuple((w,) for s in sets for w in s)  # else words of a set may share a place
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    own = [(i, w) for i, s in enumerate(count_as) for w in s if any(_fits(w[d:], w) for d in range(1, len(w)))]
    looping_of, looping = [i for i, _ in own], tuple((w,) for _, w in own)

    def count(texts: pa.Array) -> np.ndarray:
        raw, ends = _letters(texts)
        sums = _sums(raw, ends, count_as, 1)
        for i, places in _overlapping(raw, ends, looping):
            text = np.searchsorted(ends, places, side="right") - 1
            sums[looping_of[i]] -= np.bincount(text, minlength=len(texts))
        return sums if count_as is sets else np.stack([sums[owner == i].sum(0) for i in range(len(sets))])

    return count


def separate_counts(seq: Column, sets: Sequence[Sequence[str]]) -> Column:
    """``array<bigint>``: hits of each word that don't overlap the one of the same word before, summed per set; null for null."""
    count = _separate_counter(sets)

    def scan(texts: pa.Array) -> pa.Array:
        return _lists(pa.array(count(texts).T.ravel()), np.arange(len(texts) + 1) * len(sets), _missing(texts))

    return _udf(scan, "array<bigint>")(seq)


def own_separate_counts(seq: Column, key: Column, sets: dict[str, Sequence[Sequence[str]]]) -> Column:
    """``separate_counts`` of the sets listed under each row's key, equally many; null for null or another key."""
    counters, n = {k: _separate_counter(s) for k, s in sets.items()}, len(next(iter(sets.values())))

    def scan(texts: pa.Array, keys: pa.Array) -> pa.Array:
        names = keys.to_numpy(zero_copy_only=False)
        sums, missing = np.zeros((len(texts), n), np.int64), np.ones(len(texts), bool)
        for name, count in counters.items():
            mine = np.flatnonzero(names == name)
            if len(mine):
                some = texts.take(pa.array(mine))
                sums[mine] = count(some).T
                missing[mine] = some.is_null().to_numpy(zero_copy_only=False)
        return _lists(pa.array(sums.ravel()), np.arange(len(texts) + 1) * n, missing)

    return F.arrow_udf(scan, "array<bigint>")(seq, key)


def positions(seq: Column, kmers: Sequence[str]) -> Column:
    """``array<int>``: sorted 0-based starts of the hits, in bytes as slices of the binary text take them; null for null."""
    sets = _freeze([kmers])

    def scan(texts: pa.Array) -> pa.Array:
        raw, ends = _letters(texts)
        p = _hits(raw, ends, sets)[0]
        borders = np.searchsorted(p, ends)
        inside = p - np.repeat(ends[:-1], np.diff(borders))
        return _lists(pa.array(inside.astype(np.int32)), borders, _missing(texts))

    return _udf(scan, "array<int>")(seq)


def runs(seq: Column, sets: Sequence[Sequence[str]], min_run: int = 1, reach: int | None = None) -> Column:
    """Covered runs of at least ``min_run`` letters, a list per set; null for null.

    Places are bytes, as slices of the binary text take them.  A hit reaches over its own length, or over ``reach`` letters of it: with 1 the runs are stretches of neighbouring starts.
    """
    sets = _freeze(sets)

    def scan(texts: pa.Array) -> pa.Array:
        raw, ends = _letters(texts)
        starts, stops, owners = [], [], []
        for i in range(len(sets)):
            if i % 64 == 0:
                all_begins, all_ends, all_texts, value = _stretches(raw, ends, sets[i:i + 64], reach)
            mine = np.flatnonzero(value & value.dtype.type(1 << i % 64))
            begin, end, text = all_begins[mine], all_ends[mine], all_texts[mine]
            apart = (begin[1:] > end[:-1]) | (np.diff(text) > 0)
            first, last = np.r_[True, apart][:len(mine)], np.r_[apart, True][:len(mine)]
            begin, end, text = begin[first], end[last], text[first]
            long = end - begin >= min_run
            begin, end, text = begin[long], end[long], text[long]
            starts.append(begin - ends[text])
            stops.append(end - ends[text])
            owners.append(text * len(sets) + i)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        rows = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(x)[order].astype(np.int32)) for x in (starts, stops)], ["start", "end"])
        inner = _lists(rows, np.searchsorted(owner[order], np.arange(len(texts) * len(sets) + 1)))
        return _lists(inner, np.arange(len(texts) + 1) * len(sets), _missing(texts))

    return _udf(scan, RUNS)(seq)


def word_counts(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over one column of texts: the words of ``k`` letters with the number of texts that have them
    and their occurrences, once or several times each.  Texts of other letters than A, C, G, T, N are counted word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((2, 5 ** k), np.int64) if 5 ** k <= _DENSE else None
        for batch in batches:
            raw, ends = _letters(batch.column(0))
            at = 0
            while at < len(ends) - 1:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + _COUNTED, side="right")) - 1)
                some, borders = raw[ends[at]:ends[upto]], ends[at:upto + 1] - ends[at]
                at = upto
                if 5 ** k >= 1 << 62 or not np.isin(some, _DNA).all():
                    yield from _counted_singly(some, borders, k)
                elif dense is not None:
                    _count(some, borders, k, dense)
                else:
                    yield _word_rows(*_count(some, borders, k), k)
        if dense is not None:
            words = np.flatnonzero(dense[1])
            yield _word_rows(words, *dense[:, words], k)

    return run


def _count(raw: np.ndarray, ends: np.ndarray, k: int, dense: np.ndarray | None = None):
    """Numbers of the words of some texts, how many texts have them, and occurrences; added to ``dense`` if given."""
    m = len(raw) - k + 1
    inside = np.ones(max(m, 0), bool)
    for j in range(1, k):  # words across the end of a text
        there = ends[1:-1] - j
        inside[there[(there >= 0) & (there < m)]] = False
    digit, number = _digits(raw).astype(np.int64), np.zeros(max(m, 0), np.int64)
    for j in range(k if m > 0 else 0):
        number *= 5
        number += digit[j:j + m]
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:max(m, 0)]
    number, text = number[inside], text[inside]
    if dense is not None:
        dense[1] += np.bincount(number, minlength=dense.shape[1])
        keys = np.sort(text * 5 ** k + number)
        new = np.r_[True, keys[1:] != keys[:-1]][:len(keys)]
        dense[0] += np.bincount(keys[new] % 5 ** k, minlength=dense.shape[1])
        return None
    order = np.argsort(number, kind="stable")  # texts stay in order
    number, text = number[order], text[order]
    other = np.r_[True, number[1:] != number[:-1]][:len(number)]
    begins = np.flatnonzero(other)
    if not len(begins):
        return number, number, number
    new = other | np.r_[True, text[1:] != text[:-1]][:len(text)]
    return number[begins], np.add.reduceat(new.astype(np.int64), begins), np.diff(np.r_[begins, len(number)])


def _word_rows(words: np.ndarray, n_seqs: np.ndarray, n_total: np.ndarray, k: int) -> pa.RecordBatch:
    letters = np.empty((len(words), k), np.uint8)
    for j in range(k - 1, -1, -1):
        words, digit = np.divmod(words, 5)
        letters[:, j] = _DNA[digit]
    texts = pa.StringArray.from_buffers(
        len(letters), pa.py_buffer((np.arange(len(letters) + 1) * k).astype(np.int32)), pa.py_buffer(letters.tobytes()))
    return pa.RecordBatch.from_arrays(
        [texts, pa.array(n_seqs.astype(np.int64)), pa.array(n_total.astype(np.int64))], names=["kmer", "n_seqs", "n_total"])


def _counted_singly(raw: np.ndarray, ends: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for begin, end in zip(ends[:-1], ends[1:]):
        text = raw[begin:end].tobytes().decode()
        found = Counter(text[i:i + k] for i in range(len(text) - k + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([1] * len(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
            names=["kmer", "n_seqs", "n_total"])


def _udf(scan: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    return F.arrow_udf(scan, kind)
