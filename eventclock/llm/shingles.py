"""Word shingles of many texts at once, with numpy.

A word stands for itself by a keyed 128-bit digest of its bytes, a shingle by a 64-bit
number mixed from its words' digests in order.  Within two sets of n shingles, different
shingles share a number with a chance below n * n / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from eventclock.llm.pieces import distinct_runs

_KEY = b"word shingles"
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each word as two numbers, A-Z lower-cased, parted by ASCII white space; and the words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b" ".join([*raw, b""])
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return np.empty((2, 0), np.uint64), np.zeros(len(texts), np.int64)
    gap = _space[data]
    word = ~gap
    starts = np.flatnonzero(word & np.append(True, gap[:-1]))
    ends = np.flatnonzero(gap & np.append(False, word[:-1]))
    codes, first = distinct_runs(data, starts, ends)
    digest = hashlib.blake2b
    out = [digest(joined[a:b], digest_size=16, key=_KEY).digest() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    stops = np.cumsum([len(r) + 1 for r in raw])
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2).T[:, codes], np.diff(np.searchsorted(starts, stops), prepend=0)


def _joined(parts: list[np.ndarray], size: int) -> np.ndarray:
    """A number of each sequence of words; parts: digests of its words in order."""
    s = np.full(parts[0].shape[1], mix(np.array([size], np.uint64))[0])
    for one, two in parts:
        s ^= one
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += two
        s ^= s >> np.uint64(32)
    return mix(s)


def shingle_sets(texts: list[str], words: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle numbers of each text; of fewer words, the whole sequence is one shingle."""
    h, counts = word_digests(texts)
    n = h.shape[1] - words + 1
    s = _joined([h[:, k : k + n] for k in range(words)], words) if n > 0 else h[0, :0]
    at = 0
    for c in counts.tolist():
        if c >= words:
            yield np.unique(s[at : at + c - words + 1])
        elif c:
            yield _joined([h[:, at + k : at + k + 1] for k in range(c)], c)
        else:
            yield np.empty(0, np.uint64)
        at += c
