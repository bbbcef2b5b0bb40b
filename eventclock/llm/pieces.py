"""Vectorised splitting of texts into pieces, and per-piece memoised tokenisation.

A byte-pair tokeniser works on each match of its splitting pattern alone.  So the
ids of a text are the ids of its pieces in order, and a piece that occurs often
need be tokenised once.  ``split`` finds the pieces of many texts with numpy
operations over code points; ``PieceTable`` maps each distinct piece to its ids.

Memory: one chunk of ``CHUNK_CHARS`` characters (or one longer text) and a memo
of bounded size.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex

LETTER, NUMBER, SPACE, OTHER, END = range(5)
CHUNK_CHARS = 400_000
#: Symbols of runs that are compared at once.
_PORTION = 1 << 17
_UNKNOWN = 255
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))

_classes = np.full(0x110000, _UNKNOWN, np.uint8)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_kinds = ((LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s")))


def classes_of(points: np.ndarray) -> np.ndarray:
    """Class of each code point; a code point is classified when first seen."""
    found = _classes[points]
    if (found == _UNKNOWN).any():
        for c in np.unique(points[found == _UNKNOWN]).tolist():
            _classes[c] = next((k for k, r in _kinds if r.match(chr(c))), OTHER)
        found = _classes[points]
    return found


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of ``symbols[starts[i]:ends[i]]``.  Different runs can share it."""
    power, inverse = _power_tables(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return h ^ (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def distinct_runs(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each run ``symbols[starts[i]:ends[i]]``, equal exactly for equal runs, and the first run of each code.

    Runs are grouped by a hash, then each is compared with the first of its group symbol by
    symbol; a group that holds different runs is told apart by the runs themselves.
    """
    codes, seen = pd.factorize(run_hashes(symbols, starts, ends))
    first = _first(codes, len(seen))
    mixed = _mixed_groups(symbols, starts, ends, codes, first)
    if len(mixed):
        known: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(np.isin(codes, mixed)).tolist():
            c = int(codes[i])
            own = known.setdefault((c, symbols[starts[i] : ends[i]].tobytes()), len(seen) + len(known))
            codes[i] = own
        codes, seen = pd.factorize(codes)
        first = _first(codes, len(seen))
    return codes, first


def _first(codes: np.ndarray, count: int) -> np.ndarray:
    first = np.empty(count, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def _mixed_groups(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Codes under which runs differ."""
    size, away = ends - starts, starts[first][codes] - starts
    wrong = size != size[first][codes]
    found = [codes[wrong]]
    rest = np.flatnonzero((away != 0) & ~wrong)
    bounds = np.cumsum(size[rest])
    cuts = np.searchsorted(bounds, np.arange(_PORTION, int(bounds[-1]) if len(bounds) else 0, _PORTION))
    for part in np.split(rest, np.unique(cuts)):
        n = size[part]
        at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        differ = np.flatnonzero(symbols[at] != symbols[at + np.repeat(away[part], n)])
        if len(differ):
            found.append(codes[part[np.searchsorted(np.cumsum(n), differ, side="right")]])
    return np.unique(np.concatenate(found))


class Pieces:
    """Pieces of a list of texts: ``joined[starts[i]:ends[i]]`` belongs to text ``owner[i]``."""

    def __init__(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray):
        self.joined, self.points, self.starts, self.ends, self.owner = joined, points, starts, ends, owner

    def distinct(self) -> tuple[np.ndarray, list[str]]:
        """Code of each piece, and the distinct pieces in order of first use."""
        codes, first = distinct_runs(self.points, self.starts, self.ends)
        joined = self.joined
        return codes, [joined[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist(), strict=True)]


def split(texts: list[str], keep_space: bool = True) -> Pieces:
    """Pieces by the pattern of the public byte-level tokenisers.

    keep_space: white space stays, one space joins the piece behind it.  Otherwise
    white space is dropped and each numeral stands alone.
    """
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = classes_of(points)
    kind[stops] = END
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[stops] = True
    if keep_space:
        following = kind[1:]
        last = np.flatnonzero((kind[:-1] == SPACE) & (following != SPACE) & (following != END))
        start[last] = True
        start[last[points[last] == 32] + 1] = False
    else:
        start[kind == NUMBER] = True
    mark = np.flatnonzero(points == 39)
    mark = mark[start[mark] & (kind[mark] == OTHER)]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        one, two = points[mark + 1], points[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut = mark[short | long]
        start[cut + 1] = False
        start[cut + 2 + long[short | long]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(kind))
    keep = kind[starts] != END
    if not keep_space:
        keep &= kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    return Pieces(joined, points, starts, ends, np.searchsorted(stops, starts))


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of lists, and the size of each."""
    sizes = np.fromiter(map(len, lists), np.int32, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class PieceTable:
    """Ids of texts by a memo of the ids of their pieces.

    encode: takes distinct pieces, returns all their ids and how many each has.  When the memo
    reaches a bound, what was met in one chunk only is forgotten, at least half of it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep_space: bool = True, most_pieces: int = 400_000, most_ids: int = 3_000_000):
        self.encode, self.keep_space, self.most_pieces, self.most_ids = encode, keep_space, most_pieces, most_ids
        self.rows: dict[str, int] = {}
        self.flat, self.begin, self.size = array("I"), array("q"), array("i")
        self.uses = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps the pieces that most chunks had: at most half of the bounds."""
        n = len(self.rows)
        size, begin, flat = np.frombuffer(self.size, np.int32).astype(np.int64), np.frombuffer(self.begin, np.int64), np.frombuffer(self.flat, np.uint32)
        order = np.argsort(-self.uses[:n], kind="stable")
        order = order[: min(self.most_pieces // 2, int((self.uses[:n] > 1).sum()))]
        kept = np.sort(order[: int(np.searchsorted(np.cumsum(size[order]), self.most_ids // 2))])
        sizes, names = size[kept], list(self.rows)
        starts = np.cumsum(sizes) - sizes
        ids = flat[np.repeat(begin[kept] - starts, sizes) + np.arange(int(sizes.sum()))]
        self.rows = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.uses[: len(kept)], self.uses[len(kept) :] = 1, 0
        self.flat, self.begin, self.size = array("I", ids.tobytes()), array("q", starts.tobytes()), array("i", sizes.astype(np.int32).tobytes())

    def _learn(self, new: list[str]) -> None:
        ids, sizes = self.encode(new)
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.begin.frombytes((len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes).tobytes())
        self.size.frombytes(sizes.astype(np.int32).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        if len(self.uses) < len(self.rows):
            self.uses = np.append(self.uses, np.zeros(len(self.rows), np.int32))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the count for each text."""
        if len(self.rows) > self.most_pieces or len(self.flat) > self.most_ids:
            self._forget()
        p = split(texts, self.keep_space)
        if not len(p.starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        codes, pieces = p.distinct()
        at = np.fromiter(map(self.rows.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = len(self.rows) + np.arange(len(missing))
            self._learn([pieces[i] for i in missing.tolist()])
        self.uses[at] += 1
        rows = at[codes]
        sizes = np.frombuffer(self.size, np.int32)[rows].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        where = np.repeat(np.frombuffer(self.begin, np.int64)[rows] - before, sizes) + np.arange(int(sizes.sum()))
        counts = np.bincount(p.owner, sizes, len(texts)).astype(np.int64)
        return np.frombuffer(self.flat, np.uint32)[where], counts


def chunks(rows: Iterable[tuple], text_at: int, most: int = CHUNK_CHARS) -> Iterator[list[tuple]]:
    """Rows in groups of about ``most`` characters; a longer text is a group alone."""
    group, size = [], 0
    for row in rows:
        n = len(row[text_at] or "") + 1
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += n
    if group:
        yield group
