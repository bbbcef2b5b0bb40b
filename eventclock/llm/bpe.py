"""Operator 1: byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding.  A sequence of tokens is the BPE encoding of its bytes exactly if each
two neighbours are (``MergeRules.adjacent``).  So a nondeterministic transducer
that reads bytes along the vocabulary's trie, ends a token wherever the trie has
one, and only starts behind a fitting neighbour has one accepting path for each
text.  ``Transducer`` determinises it as states are met: a state is the set of open
hypotheses with the tokens not yet agreed on; a token is emitted as soon as all
hypotheses agree, which is within the longest token's length.

Decoding.  ``StreamDecoder`` takes ids in any portions and gives text, by a state
machine over UTF-8 bytes that holds what is incomplete from one portion to the next.

Nulls and empty texts give no tokens; a null doc_id stays null; very long texts are
encoded alone; repeated rows each give a row; other columns than ``doc_id`` and ``text``
are not read; an empty table gives an empty result.  An encoding is unique: nothing ties.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.llm.common import bounded_batches, map_rows, text_column
from eventclock.llm.pieces import PieceTable, chunks, flat

_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeRules:
    """Which tokens can stand side by side in an encoding.

    Each token is built by one tree of merges.  Seen from its right edge, the piece
    at the edge is replaced by a larger one at certain ranks; so it is from the left.
    Two tokens stay apart unless two edge pieces that exist at the same time have a
    merge that comes before either is replaced.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.shift = self.size.bit_length()
        self.pairs: dict[int, int] = {}
        self.right: dict[int, list[tuple[int, int, int]]] = {}
        self.left: dict[int, list[tuple[int, int, int]]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.right[rank] = self.left[rank] = [(rank, -1, _NEVER)]
                continue
            found = None
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is None or b is None:
                    continue
                self.pairs[a << self.shift | b] = rank
                if found is None and a < rank and b < rank and a in self.right and b in self.left and not self._meet(a, b, rank):
                    found = a, b
            if found:
                a, b = found
                self.right[rank] = [(rank, rank, _NEVER), *((x, s, min(e, rank)) for x, s, e in self.right[b])]
                self.left[rank] = [(rank, rank, _NEVER), *((x, s, min(e, rank)) for x, s, e in self.left[a])]

    def _meet(self, a: int, b: int, below: int) -> bool:
        """Some merge of a rank below ``below`` crosses the border of a and b."""
        pairs, shift = self.pairs.get, self.shift
        for x, start_x, end_x in self.right[a]:
            for y, start_y, end_y in self.left[b]:
                if start_x <= end_y and start_y < end_x:
                    rank = pairs(x << shift | y)
                    # of two merges of one rank the left one comes first
                    if rank is not None and rank < below and rank < end_x and rank <= end_y:
                        return True
        return False

    def adjacent(self, a: int, b: int) -> bool:
        return not self._meet(a, b, _NEVER)


class Transducer:
    """Bytes to token ids; transitions are made when first needed.

    most_states: when so many states are known they are forgotten, which bounds memory.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 150_000):
        self.ranks, self.rules, self.most_states = ranks, MergeRules(ranks), most_states
        self.child: dict[int, int] = {}
        self.token = [-1]
        inner = set()
        for token, rank in ranks.items():
            if rank not in self.rules.right:
                continue  # no text has it as a result of merges
            node = 0
            for c in token:
                inner.add(node)
                key = node << 8 | c
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = rank
        self.inner = [n in inner for n in range(len(self.token))]
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.rest: list[tuple[int, ...]] = []
        self.arcs: dict[int, tuple[tuple[int, ...], int]] = {}
        self.fits: dict[int, bool] = {}
        self._state(((-1, (), 0),))

    def _state(self, hypotheses: tuple) -> int:
        found = self.known.get(hypotheses)
        if found is None:
            found = self.known[hypotheses] = len(self.states)
            self.states.append(hypotheses)
            self.rest.append(next((p for _, p, n in hypotheses if n == 0), ()))
        return found

    def _arc(self, state: int, c: int) -> tuple[tuple[int, ...], int]:
        out, child, inner, token, fits, shift = [], self.child.get, self.inner, self.token, self.fits, self.rules.shift
        for last, pending, node in self.states[state]:
            to = child(node << 8 | c)
            if to is None:
                continue
            if inner[to]:
                out.append((last, pending, to))
            t = token[to]
            if t >= 0:
                ok = last < 0
                if not ok:
                    pair = last << shift | t
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self.rules.adjacent(last, t)
                if ok:
                    out.append((t, (*pending, t), 0))
        first, agreed = out[0][1], 0
        if first:
            while agreed < len(first) and all(len(p) > agreed and p[agreed] == first[agreed] for _, p, _ in out):
                agreed += 1
            if agreed:
                out = [(a, p[agreed:], n) for a, p, n in out]
        arc = self.arcs[state << 8 | c] = first[:agreed], self._state(tuple(out))
        return arc

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most_states or len(self.fits) > 4 * self.most_states:
            self._forget()
        arcs, state, out = self.arcs.get, 0, []
        for c in data:
            arc = arcs(state << 8 | c) or self._arc(state, c)
            if arc[0]:
                out += arc[0]
            state = arc[1]
        out += self.rest[state]
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode = self.encode
        return flat([encode(p.encode("utf-8", "surrogatepass")) for p in pieces])


def _utf8_machine() -> tuple[list[list[int]], int, int]:
    """States of a UTF-8 reader: 0 between characters, others by the bytes that may follow."""
    trail = range(0x80, 0xC0)
    bad = 8
    arcs = [[bad] * 256 for _ in range(8)]

    def put(state: int, to: int, over: Iterable[int]) -> None:
        for c in over:
            arcs[state][c] = to

    put(0, 0, range(0x80))
    put(0, 1, range(0xC2, 0xE0))  # one more byte
    put(0, 4, [0xE0])
    put(0, 2, [*range(0xE1, 0xED), 0xEE, 0xEF])  # two more
    put(0, 5, [0xED])
    put(0, 6, [0xF0])
    put(0, 3, range(0xF1, 0xF4))  # three more
    put(0, 7, [0xF4])
    put(1, 0, trail)
    put(2, 1, trail)
    put(3, 2, trail)
    put(4, 1, range(0xA0, 0xC0))
    put(5, 1, range(0x80, 0xA0))
    put(6, 2, range(0x90, 0xC0))
    put(7, 2, range(0x80, 0x90))
    return arcs, 0, bad


class StreamDecoder:
    """Ids in portions to text; a maximal ill-formed part of a character gives one U+FFFD."""

    _arcs, _start, _bad = _utf8_machine()

    def __init__(self, vocabulary: TokenBytes):
        self.vocabulary, self.state, self.held = vocabulary, self._start, b""

    def feed(self, ids: np.ndarray) -> str:
        out = []
        clean = self.vocabulary.clean[ids]
        done, n = 0, len(ids)
        open_at = np.flatnonzero(~clean)
        at = 0
        while done < n:
            if self.state == self._start:
                at += int(np.searchsorted(open_at[at:], done))
                stop = int(open_at[at]) if at < len(open_at) else n
                if stop > done:
                    out.append(self.vocabulary.join(ids[done:stop]).decode("utf-8"))
                    done = stop
                    continue
            out.append(self._step(self.vocabulary.tokens[ids[done]]))
            done += 1
        return "".join(out)

    def _step(self, data: bytes) -> str:
        out, held, state = [], self.held, self.state
        for c in data:
            to = self._arcs[state][c]
            if to == self._bad and state != self._start:
                out.append("�")
                held, state = b"", self._start
                to = self._arcs[state][c]
            if to == self._bad:
                out.append("�")
                continue
            held += bytes((c,))
            state = to
            if state == self._start:
                out.append(held.decode("utf-8"))
                held = b""
        self.held, self.state = held, state
        return "".join(out)

    def end(self) -> str:
        out = "�" if self.held else ""
        self.state, self.held = self._start, b""
        return out


class TokenBytes:
    """Bytes of each id, in one array; ``clean``: whole characters only."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.clean = np.array([_whole(t) for t in self.tokens])

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        where = np.repeat(self.begin[ids] - (total - sizes), sizes) + np.arange(int(total[-1]) if len(ids) else 0)
        return self.flat[where].tobytes()


def _whole(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(2)
def codec(path: str) -> tuple[PieceTable, TokenBytes]:
    """One encoder and vocabulary for each worker process."""
    ranks = read_ranks(path)
    return PieceTable(Transducer(ranks).encode_pieces), TokenBytes(ranks)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens of every whole text."""
    bounded_batches(docs.sparkSession)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        table, _ = codec(path)
        for group in chunks(rows, 1):
            ids, counts = table.ids([t for _, t in group])
            ends = np.cumsum(counts)
            for (doc, _), a, b in zip(group, ends - counts, ends, strict=True):
                yield doc, ids[a:b].astype("<u4").tobytes(), int(b - a)

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")), kernel, schema, "doc_id long, ids binary, n_tokens long", 500)


def decoded(tokens: DataFrame, path: str, portion: int = 65_536) -> DataFrame:
    """doc_id and text of each row of ``encoded``; portion: ids fed to the decoder at once."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        _, vocabulary = codec(path)
        for doc, data in rows:
            decoder, ids = StreamDecoder(vocabulary), np.frombuffer(data, "<u4")
            yield doc, "".join([*(decoder.feed(ids[i : i + portion]) for i in range(0, len(ids), portion)), decoder.end()])

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return map_rows(tokens.select("doc_id", "ids"), kernel, schema, "doc_id long, text string", 500)


def round_trip(docs: DataFrame, path: str, portion: int = 65_536) -> DataFrame:
    """Encodes and decodes every text in one pass; digests of the ids and of the decoded bytes."""
    bounded_batches(docs.sparkSession)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        table, vocabulary = codec(path)
        for group in chunks(rows, 1):
            ids, counts = table.ids([t for _, t in group])
            ends = np.cumsum(counts)
            for (doc, _), a, b in zip(group, (ends - counts).tolist(), ends.tolist(), strict=True):
                decoder, own, back = StreamDecoder(vocabulary), ids[a:b], hashlib.sha256()
                for i in range(0, len(own), portion):
                    back.update(decoder.feed(own[i : i + portion]).encode("utf-8"))
                back.update(decoder.end().encode("utf-8"))
                yield doc, b - a, hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), back.hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")), kernel, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
