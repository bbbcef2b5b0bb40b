"""Operator 8: greedy word-piece lengths in linear time.

The vocabulary's trie gets failure links: where a word leaves the trie, the link
leads to what remains of it behind the longest pieces, and a stored count says how
many pieces that takes off.  So each byte is looked at once, and pieces are never
built.  The last byte of a word is a symbol of its own, as pieces that end a word
are of their own in the vocabulary.

Nulls, empty texts and texts of white space have no words and no tokens; a null doc_id
stays null.  Very long texts and words are read whole.  Rows that repeat each give a row;
the longest match is unique, so nothing ties.  Columns but ``doc_id`` and ``text`` are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.llm.common import bounded_batches, map_rows, text_column
from eventclock.llm.pieces import PieceTable, chunks, flat

_LAST = 256


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in vocabularies of byte-level tokenisers."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_vocabulary(path: str, end: str = "</w>") -> set[tuple[int, ...]]:
    """Pieces as symbols: bytes, the last byte of a word plus 256."""
    letters = _byte_of_letter()
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    out = set()
    for t in tokens:
        final = t.endswith(end)
        symbols = [letters[c] for c in (t[: -len(end)] if final else t)]
        if symbols:
            symbols[-1] += _LAST * final
            out.add(tuple(symbols))
    return out


class LongestMatch:
    """Number of pieces of a word by greedy longest match, without the pieces."""

    def __init__(self, vocabulary: set[tuple[int, ...]]):
        child: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in sorted(vocabulary):
            node = 0
            for c in piece:
                to = child[node].get(c)
                if to is None:
                    to = child[node][c] = len(child)
                    child.append({})
                    whole.append(False)
                node = to
            whole[node] = True
        self.child, self.link, self.taken = child, [-1] * len(child), [0] * len(child)
        todo = deque([0])
        while todo:
            above = todo.popleft()
            for c, node in child[above].items():
                todo.append(node)
                if whole[node]:
                    self.link[node], self.taken[node] = 0, 1
                    continue
                to, taken = self.link[above], self.taken[above]
                while to >= 0 and c not in child[to]:
                    taken += self.taken[to]
                    to = self.link[to]
                if to >= 0:
                    self.link[node], self.taken[node] = child[to][c], taken

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 if the vocabulary can't spell it, as it is one unknown piece then."""
        symbols = list(word)
        if not symbols:
            return 0
        symbols[-1] += _LAST
        node, n = 0, 0
        child, link, taken = self.child, self.link, self.taken
        for c in symbols:
            while c not in child[node]:
                n += taken[node]
                node = link[node]
                if node < 0:
                    return 1
            node = child[node][c]
        while node > 0:
            n += taken[node]
            node = link[node]
        return n if node == 0 else 1


@functools.lru_cache(2)
def word_counts(path: str) -> PieceTable:
    machine = LongestMatch(read_vocabulary(path))
    return PieceTable(lambda words: flat([[machine.count(w.encode("utf-8", "surrogatepass"))] for w in words]), keep_space=False)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text, lower-cased."""
    bounded_batches(docs.sparkSession)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        table = word_counts(vocabulary)
        for group in chunks(rows, 1):
            counts, words = table.ids([t.lower() for _, t in group])
            total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            ends = np.cumsum(words)
            for (doc, _), n, k in zip(group, words.tolist(), (total[ends] - total[ends - words]).tolist(), strict=True):
                yield doc, n, k

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")), kernel, schema, "doc_id long, n_words long, n_tokens long")
