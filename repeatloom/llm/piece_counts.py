"""Greedy word-piece counts in one pass, without building the pieces.

The vocabulary becomes a trie.  Each node knows, for the case that the next byte has no edge, how many tokens the
greedy match then gives off and at which node the rest goes on (its failure link).  So each byte is one step and one
word costs time linear in its length, however long the match that fails.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from repeatloom.llm.rows import map_texts, space_words

#: Entries of the table of known words; a full table is emptied, which costs time and changes nothing.
KEPT = 400_000


class LongestMatch:
    """Automaton of greedy longest matches; a word is matched with ``prefix`` (a byte string) before it."""

    def __init__(self, tokens: list[bytes], prefix: bytes = b" "):
        self.prefix = prefix
        edges: list[dict[int, int]] = [{}]
        final, parent, depth = [False], [(0, 0)], [0]
        for token in tokens:
            node = 0
            for byte in token:
                to = edges[node].get(byte)
                if to is None:
                    to = edges[node][byte] = len(edges)
                    edges.append({})
                    final.append(False)
                    parent.append((node, byte))
                    depth.append(depth[node] + 1)
                node = to
            final[node] = node > 0
        self.edges = edges
        #: Node to go on at and number of tokens given off; None where no token begins the node's bytes.
        self.fail: list[tuple[int, int] | None] = [None] * len(edges)
        for node in sorted(range(1, len(edges)), key=depth.__getitem__):
            if final[node]:
                self.fail[node] = (0, 1)  # the whole node is one token
                continue
            up, byte = parent[node]
            at, given = self.fail[up] or (None, 0)
            while at is not None and byte not in edges[at]:
                at, more = self.fail[at] or (None, 0)
                given += more
            self.fail[node] = None if at is None else (edges[at][byte], given)

    def count(self, word: bytes) -> int | None:
        """Number of pieces, None if the vocabulary cannot spell the word."""
        edges, fail, node, total = self.edges, self.fail, 0, 0
        for byte in self.prefix + word:
            while (to := edges[node].get(byte)) is None:
                if fail[node] is None:
                    return None
                node, given = fail[node]
                total += given
            node = to
        while node:
            if fail[node] is None:
                return None
            node, given = fail[node]
            total += given
        return total


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = self.automaton.count(word)
        n = self[word] = -1 if n is None else n
        return n


_KNOWN: dict[tuple[str, bytes], _Counts] = {}


def token_counts(
    df: DataFrame, ranks: bytes, prefix: bytes = b" ", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col, n_words, n_tokens, n_unknown`` per row: greedy longest-match pieces of the words of whole texts.

    ``ranks`` is the content of a rank file; its tokens are the vocabulary, and those that begin with ``prefix`` can
    begin a word.  Words are separated by space, tab, line feed, vertical tab, form feed and carriage return.  A word that cannot be spelt counts as one token and
    in ``n_unknown``.  Null and empty texts have no words.  Repeated rows are counted each.
    """
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def start():
        key = (hashlib.sha256(sent.value).hexdigest(), prefix)
        if key not in _KNOWN:
            tokens = [base64.b64decode(line.split()[0]) for line in sent.value.splitlines() if line.strip()]
            _KNOWN[key] = _Counts(LongestMatch(tokens, prefix))
        known = _KNOWN[key]

        def each(key, text):
            counts = list(map(known.__getitem__, space_words(text or b"")))
            total, unknown = sum(counts), counts.count(-1) if -1 in counts else 0
            yield key, len(counts), total + 2 * unknown, unknown
        return each

    return map_texts(df, [id_col, text_col], T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_unknown", T.LongType())]), start, forget)


def forget() -> None:
    for known in _KNOWN.values():
        known.clear()
