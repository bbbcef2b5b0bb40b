"""Operator 10: packs documents into windows of a fixed number of tokens.

A document longer than a window is cut into full windows first; what remains of each
document is placed by best fit, the longest first: a segment tree over remaining
capacities finds the tightest open window.  Pieces are dealt to groups of about ``GROUP``
pieces that are packed apart, so no task holds the corpus; each group leaves at most a
few windows less than full.  Rows that repeat are dealt like any others.  A window's id is
its number in its group times the number of groups plus the group's: unique without a
count over all.

Nulls and empty texts give one piece with the end id, a null doc_id stays null.  Repeated
rows are packed each.  Very long texts are cut like others.  Columns but ``doc_id`` and
``text`` are not read; an empty table gives no piece.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from eventclock.llm.common import bounded_batches, map_rows, text_column, written
from eventclock.llm.pieces import chunks
from eventclock.llm.token_files import piece_table

#: Pieces that are packed together, about.
GROUP = 8_192


def _simple(text: str) -> bool:
    """Lower case and normal form of the text are what Python makes of its characters one by one."""
    return text.isascii() or all(c < "ƀ" and c != "İ" or "‐" <= c <= "‧" or c == "€" for c in set(text))


def word_ids(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids by the lower-casing word tokeniser, and their number for each text.

    Texts with characters whose normal form depends on their neighbours go to the
    library whole; of others, the library encodes each distinct word once.
    """
    table = piece_table(path, False)
    plain = [_simple(t) for t in texts]
    ids, counts = table.ids([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)])
    if all(plain):
        return ids, counts
    ends = np.cumsum(counts)
    parts = [ids[a:b] for a, b in zip(ends - counts, ends, strict=True)]
    for i, p in enumerate(plain):
        if not p:
            parts[i] = table.encode([texts[i]])[0]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: full windows and a remainder; with_ids adds their ids."""
    bounded_batches(docs.sparkSession)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for group in chunks(rows, 1):
            ids, counts = word_ids(tokenizer, [t for _, t in group])
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
            at = 0
            for (doc, _), n in zip(group, (counts + 1).tolist(), strict=True):
                for start in range(0, n, window):
                    length = min(window, n - start)
                    own = ids[at + start : at + start + length]
                    yield doc, start, length, zlib.crc32(own), n, *([own.tobytes()] * with_ids)
                at += n

    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), *[("ids", pa.binary())] * with_ids])
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")), kernel, schema, ddl)


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree of their numbers."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, change: int) -> None:
        at = self.leaves + capacity
        while at:
            self.tree[at] += change
            at >>= 1

    def put(self, capacity: int, number: int) -> None:
        self.open[capacity].append(number)
        self._add(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the open window of least capacity that is ``length`` or more."""
        tree, at = self.tree, self.leaves + length
        if not tree[at]:
            while at > 1 and not (at % 2 == 0 and tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        number = self.open[capacity].pop()
        self._add(capacity, -1)
        return capacity, number


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Number of the window and offset in it of each piece; lengths must descend."""
    windows, number, offset, count = OpenWindows(window), [], [], 0
    for n in lengths:
        found = windows.tightest(n)
        if found is None:
            found = window, count
            count += 1
        capacity, own = found
        number.append(own)
        offset.append(window - capacity)
        if capacity > n:
            windows.put(capacity - n, own)
    return number, offset


def packed(parts: DataFrame, window: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces that have been written."""
    bounded_batches(parts.sparkSession)
    groups = max(1, -(-parts.count() // group))
    # the place of a row in its file parts rows that repeat; it stays when a task runs again
    deal = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    dealt = parts.select(deal.alias("pack_group"), *parts.columns).repartition("pack_group").sortWithinPartitions("pack_group", F.desc("length"), "doc_id", "start", "ids_crc32")

    def place(rows: Iterator[tuple]) -> Iterator[tuple]:
        for number, own in itertools.groupby(rows, key=lambda r: r[0]):
            held = [r[1:] for r in own]
            for row, w, offset in zip(held, *best_fit([r[2] for r in held], window), strict=True):
                yield *row, w * groups + number, offset

    schema = pa.schema([*to_arrow_schema(parts.schema), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return map_rows(dealt, place, schema, ddl)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    parts = written(pieces(docs, tokenizer, end_id, window), "pieces")
    return packed(parts, window)
