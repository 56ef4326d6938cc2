"""Best ungapped placement of a short text in a longer one, by votes for diagonals."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.functions.scalars import revcomp
from repeatloom.operators.durable import once

#: Letters of a seed.
SEED = 6
#: Letters that are compared at once.
COMPARED = 1 << 22
#: Up to so many letters over all offsets are compared at once without votes, which take longer on short texts.
DIRECT = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _seed_hashes(letters: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(letters) - SEED + 1), np.uint64)
    for i in range(SEED):
        h = h * _MIX + letters[i:len(h) + i]
    return h


class SeedIndex:
    """Where each seed of a target stands."""

    def __init__(self, target: np.ndarray):
        self.target = target

    @cached_property
    def places(self) -> np.ndarray:
        return np.argsort(_seed_hashes(self.target), kind="stable")

    @cached_property
    def hashes(self) -> np.ndarray:
        return _seed_hashes(self.target)[self.places]

    def votes(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """For each offset how many of the query's seeds (side by side) stand there, and how many seeds there are."""
        offsets = len(self.target) - len(query) + 1
        seeds = _seed_hashes(query)[::SEED]
        votes = np.zeros(offsets, np.int64)
        begins, ends = (np.searchsorted(self.hashes, seeds, side) for side in ("left", "right"))
        for n, (begin, end) in enumerate(zip(begins, ends)):
            at = self.places[begin:end] - n * SEED
            votes[at[(at >= 0) & (at < offsets)]] += 1
        return votes, len(seeds)

    def best(self, query: np.ndarray, least: int = 0) -> tuple[int, int] | None:
        """Most matches and the leftmost offset with them; None if all have fewer than ``least``.

        A seed that doesn't stand at an offset holds a mismatch there, so ``v`` of ``s`` votes leave at most
        ``length - (s - v)`` matches.  Offsets are compared by falling votes, until no other can reach the best.
        """
        windows = np.lib.stride_tricks.sliding_window_view(self.target, len(query))
        if windows.size <= DIRECT:
            matches = (windows == query).sum(1)
            at = int(matches.argmax())
            return (int(matches[at]), at) if matches[at] >= least else None
        votes, seeds = self.votes(query)
        step, best, at = max(1, COMPARED // len(query)), least - 1, -1
        for v in np.unique(votes)[::-1]:
            if best > len(query) - (seeds - v):
                break
            some = np.flatnonzero(votes == v)
            for begin in range(0, len(some), step):
                part = some[begin:begin + step]
                matches = (windows[part] == query).sum(1)
                top = int(matches.argmax())
                if matches[top] > best or matches[top] == best and part[top] < at:
                    best, at = int(matches[top]), int(part[top])
        return (best, at) if at >= 0 else None


def _placed(query: pd.Series, reverse: pd.Series, target: pd.Series) -> pd.DataFrame:
    out, last, index = [], None, None
    for q, r, t in zip(query, reverse, target):
        if q is None or t is None or not 0 < len(q) <= len(t):
            out.append((None, None, None))
            continue
        if t is not last:
            last, index = t, SeedIndex(_letters(t))
        matches, at = index.best(_letters(q))
        strand = 0
        if r is not None:
            other = index.best(_letters(r), matches + 1)
            if other is not None:
                (matches, at), strand = other, 1
        out.append((matches, strand, at))
    return pd.DataFrame(out, columns=["matches", "strand_rank", "at"]).astype("Int32")


def best_placement(
    pairs: DataFrame, query: str = "query", target: str = "target", both_strands: bool = True,
) -> DataFrame:
    """Adds ``matches, identity, offset, strand``; null when the query is empty, null or longer.

    Most matches win; then the forward strand, then the leftmost offset.  Pairs
    are rows, so the work spreads with them; letters are compared only at offsets
    whose seed votes can still win, which for a query with a close match are few.
    """
    q = F.col(query)
    placed = F.pandas_udf(_placed, "matches int, strand_rank int, at int")
    other = revcomp(q) if both_strands else F.lit(None).cast("string")
    return (
        once(pairs, _b=placed(q, other, F.col(target)))  # a filter on its result would place each pair again
        .withColumns({
            "matches": F.col("_b.matches"),
            "identity": F.col("_b.matches") / F.length(q),
            "offset": F.col("_b.at"),
            "strand": F.when(F.col("_b.strand_rank") == 0, "+").when(F.col("_b.strand_rank") == 1, "-"),
        })
        .drop("_b")
    )
