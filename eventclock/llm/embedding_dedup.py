"""Operator 4: near-duplicate vectors by spherical-cap filters.

Filter directions are random product codes: the coordinates are turned at random and cut
into ``PARTS`` parts, each with its own few random unit vectors; a direction is any choice
of one from each part.  A vector is filed under every direction whose inner product with
it exceeds a bound, and under ``LEAST`` at least.  All such directions are found by list
decoding: sums of the first half of the parts are matched with sorted sums of the second
half, so work follows the number found, not the number of directions.

The number of directions follows the number of vectors of the label, so that a direction
holds less than ``TILE`` of them on average at every size.  Two or more codes, each turned
on its own, file a vector; what one misses another finds (``codes_for``).  Measured at a
cosine of 0.93 exactly, where a link is hardest to find, 2,000 pairs of 64 coordinates
share a direction with a frequency of 0.999 or more from 16 directions to 16.8 million.

1. Equal vectors (label and a 128-bit digest of all components) are one representative.
2. Representatives are filed; only their number, the direction's and a sketch of 128 sign
   bits go to a direction.  There, sketches rule out almost all pairs of lower cosine.
3. Vectors that have a possible partner in a direction go there and are compared in
   double precision; a pair counts under the smallest direction that both share, so no
   list of all pairs is made or made distinct.

A direction with more than ``TILE`` vectors is compared tile by tile in separate groups.

Null, zero or non-finite vectors, null labels and null ids link with nothing; a vector is
compared with those of its own length only.  Rows that repeat are vectors of their own;
an id with two different vectors is compared as two, whose groups count as one where both
are its group's smallest and linked.  Ties at the bound count.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventclock.llm.common import bounded_batches, discard, map_rows, to_batch, written
from eventclock.llm.components import components

PARTS, LEAST, TILE, SKETCH_BITS, SIGMAS = 4, 4, 1_024, 128, 5.0


class ProductCode:
    """Random product code over ``dim`` coordinates with ``per_part`` vectors in each part."""

    def __init__(self, dim: int, per_part: int, least: int = LEAST, seed: int = 0):
        random = np.random.default_rng([seed, dim, per_part])
        self.per_part, self.least, cuts = per_part, min(least, per_part**PARTS), np.linspace(0, dim, PARTS + 1).astype(int)
        turn, _ = np.linalg.qr(random.standard_normal((dim, dim)))
        self.codes = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            c = random.standard_normal((per_part, b - a))
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) * np.sqrt(PARTS)
            self.codes.append(c @ turn[a:b])  # a random rotation, so that no coordinate is special
        self.bound = NormalDist().inv_cdf(1 - min(0.5, 0.6 * least / per_part**PARTS)) / np.sqrt(dim)

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions above the bound for unit vectors, in order; the bound
        sinks for a vector with fewer than ``least`` of them: it is filed under its nearest."""
        part = [vectors @ c.T for c in self.codes]
        n, k = len(vectors), self.per_part
        first = (part[0][:, :, None] + part[1][:, None, :]).reshape(n, k * k)
        second = (part[2][:, :, None] + part[3][:, None, :]).reshape(n, k * k)
        order = np.argsort(second, axis=1)
        rising = np.take_along_axis(second, order, axis=1)
        line = (rising + 10 * np.arange(n)[:, None]).ravel()  # one sorted list: a row's sums lie around ten times its number
        bound, todo, rows, found = np.full(n, self.bound), np.arange(n), [], []
        while len(todo):
            own, head = np.nonzero(first[todo] + rising[todo, -1:] > bound[todo, None])
            own = todo[own]
            at = np.searchsorted(line, bound[own] - first[own, head] + 10 * own, side="right") - own * k * k
            counts = k * k - at
            enough = np.bincount(own, counts, n) >= self.least
            own, head, at, counts = (x[enough[own]] for x in (own, head, at, counts))
            place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(at, counts)
            rows.append(np.repeat(own, counts))
            found.append(np.repeat(head, counts) * (k * k) + order[rows[-1], place])
            todo = todo[~enough[todo]]
            bound[todo] -= 0.05 * abs(self.bound) + 1e-3
        row, direction = np.concatenate([*rows, np.empty(0, int)]), np.concatenate([*found, np.empty(0, int)])
        order = np.lexsort((direction, row))
        return row[order], direction[order]


def per_part_for(n: int) -> int:
    """Vectors in each part for n vectors of a label: directions grow with n, and hold about half a tile each."""
    return max(2, math.ceil((6 * n / TILE) ** (1 / PARTS)))


def codes_for(per_part: int) -> int:
    """Independent codes: more where directions are narrow and each finds less."""
    return 2 + (per_part > 4) + (per_part > 16)


@functools.lru_cache(64)
def _code(dim: int, per_part: int, seed: int) -> ProductCode:
    return ProductCode(dim, per_part, seed=seed)


def directions(vectors: np.ndarray, per_part: int) -> list[np.ndarray]:
    """Ascending numbers of the directions of each unit vector, in all codes."""
    n, dim = vectors.shape
    if dim < PARTS:
        return [np.zeros(1, np.int64)] * n
    made = [(row, d + s * per_part**PARTS) for s in range(codes_for(per_part)) for row, d in [_code(dim, per_part, s).decode(vectors)]]
    row, found = (np.concatenate(x) for x in zip(*made, strict=True))
    order = np.lexsort((found, row))
    return np.split(found[order], np.cumsum(np.bincount(row, minlength=n))[:-1])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@functools.lru_cache(8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([1, dim]).standard_normal((dim, SKETCH_BITS))


def sketches(vectors: np.ndarray) -> np.ndarray:
    """Sign bits of random projections, as two 64-bit words a row."""
    return np.packbits(vectors @ _planes(vectors.shape[1]) > 0, axis=1).view("<i8")


def most_differing(cosine: float) -> int:
    """Differing sketch bits that a pair of the wanted cosine exceeds with no chance to speak of."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SKETCH_BITS * p + SIGMAS * math.sqrt(SKETCH_BITS * p * (1 - p)) + 1)


def _stored(vectors: DataFrame) -> str:
    """Numbers of a vector's bytes."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def digested(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, d1, d2 (digest), vector (bytes); dim and what follows are null where a row can't link."""
    bounded_batches(vectors.sparkSession)
    stored = _stored(vectors)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values = np.asarray(column.flatten().to_numpy(zero_copy_only=False)).astype(stored) + np.array(0, stored)  # null: nan; -0: 0
            sizes = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            bad, some = (np.concatenate([[0], np.cumsum(m)]) for m in (~np.isfinite(values), values != 0))
            good = (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes])
            out = []
            for vec, label, ok, size, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), good.tolist(), sizes.tolist(), ends.tolist(), strict=True):
                if ok and vec is not None and label is not None:
                    data = values[end - size : end].tobytes()
                    out.append((vec, label, size, *np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), "<i8").tolist(), data))
                else:
                    out.append((vec, label, None, None, None, None))
            if out:
                yield to_batch(out, schema)

    kind = T.ArrayType(T.FloatType() if stored == "<f4" else T.DoubleType())
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast(kind))
    return rows.mapInArrow(run, "vec_id long, label long, dim int, d1 long, d2 long, vector binary")


def _filed(reps: DataFrame, stored: str) -> DataFrame:
    """label, dim, rep, d1, n, sketch, at: the directions of each representative."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for group in _batched(rows, 1_000):
            for (dim, per_part), own in _grouped(group, lambda r: (r[1], per_part_for(r[5]))):
                step = max(1, (1 << 22) // per_part**2)
                for a in range(0, len(own), step):
                    part = own[a : a + step]
                    v = unit(np.frombuffer(b"".join(r[6] for r in part), stored).reshape(len(part), dim).astype(float))
                    for (label, _, rep, d1, n, _, _), bits, at in zip(part, sketches(v).tolist(), directions(v, per_part), strict=True):
                        yield label, dim, rep, d1, n, *bits, at.tolist()

    kinds = [("label", pa.int64()), ("dim", pa.int32()), *((c, pa.int64()) for c in ("rep", "d1", "n", "s1", "s2")), ("at", pa.list_(pa.int64()))]
    return map_rows(reps.select("label", "dim", "rep", "d1", "n", "total", "vector"), kernel, pa.schema(kinds), "label long, dim int, rep long, d1 long, n long, s1 long, s2 long, at array<long>", 1_000)


def _batched(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while part := list(itertools.islice(rows, size)):
        yield part


def _grouped(rows: list[tuple], key) -> Iterator[tuple]:
    for k, own in itertools.groupby(sorted(rows, key=key), key=key):
        yield k, list(own)


_TILE = ["label", "dim", "f", "i", "j"]


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """All rows of a tile in one partition, one after the other."""
    return rows.repartition(*[F.col(c) for c in _TILE]).sortWithinPartitions(*_TILE).select(*_TILE, *columns)


def _tiles(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each tile that has two or more."""
    for key, own in itertools.groupby(rows, key=lambda r: r[:5]):
        held = [r[5:] for r in own]
        if len(held) > 1:
            yield key, held


def _possible(filed: DataFrame, cosine: float) -> DataFrame:
    """The tiles in which a vector has a partner that its sketch does not rule out."""
    deals = filed.select("label", "dim", "rep", "d1", "s1", "s2", F.explode("at").alias("f"))
    # written, so that the planner sees how small it is before it shuffles what meets it
    hot = written(deals.groupBy("label", "dim", "f").count().where(F.col("count") > TILE).select("label", "dim", "f", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "hot")
    tiles = F.coalesce("tiles", F.lit(1))
    tile = F.pmod(F.xxhash64("rep", "d1"), tiles).cast("int")
    spread = deals.join(hot, ["label", "dim", "f"], "left").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    spread = spread.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    most = most_differing(cosine)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, held in _tiles(rows):
            s1, s2, tile = (np.array([r[k] for r in held], np.int64) for k in (2, 3, 4))
            bits, some = np.stack([s1, s2], axis=1).view(np.uint64), np.zeros(len(held), bool)
            for a in range(0, len(held), 256):
                near = np.bitwise_count(bits[a : a + 256, None] ^ bits).sum(axis=2, dtype=np.int64) <= most
                near[np.arange(len(near)), a + np.arange(len(near))] = False
                if key[3] != key[4]:
                    near &= tile[a : a + 256, None] != tile
                some[a : a + 256] = near.any(axis=1)
            for i in np.flatnonzero(some).tolist():
                yield *key, *held[i][:2], held[i][4]

    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("f", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("rep", pa.int64()), ("d1", pa.int64()), ("tile", pa.int32())])
    return map_rows(_dealt(spread, "rep", "d1", "s1", "s2", "tile"), kernel, schema, "label long, dim int, f long, i int, j int, rep long, d1 long, tile int")


def _counted(close: np.ndarray, filed: list[np.ndarray], here: int) -> np.ndarray:
    """Of close pairs those that share no direction before this one."""
    early = [f[: np.searchsorted(f, here)] for f in filed]
    _, column, times = np.unique(np.concatenate(early), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    if not shared.any():
        return close
    member = np.zeros((len(filed), len(times)), np.float32)
    member[np.repeat(np.arange(len(filed)), [len(e) for e in early])[shared], column[shared]] = 1
    member = member[:, times > 1]
    return close & ((member @ member.T) == 0)


def _verified(members: DataFrame, stored: str, cosine: float) -> DataFrame:
    """Links found in each tile: (rep, d1, links, to), to being the smallest vector reached in the tile."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, held in _tiles(rows):
            v = unit(np.frombuffer(b"".join(r[4] for r in held), stored).reshape(len(held), key[1]).astype(float))
            close = v @ v.T >= cosine
            np.fill_diagonal(close, False)
            if key[3] != key[4]:
                tile = np.array([r[5] for r in held])
                close &= tile[:, None] != tile
            some = np.flatnonzero(close.any(axis=1))
            if not len(some):
                continue
            close, held = close[np.ix_(some, some)], [held[i] for i in some.tolist()]
            close = _counted(close, [np.array(r[3]) for r in held], key[2])
            ids, counts = (np.array([r[k] for r in held], np.int64) for k in (0, 2))
            reached = ids.copy()
            while True:
                least = np.minimum(reached, np.where(close, reached[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (least == reached).all():
                    break
                reached = least
            links = close @ counts
            for i in np.flatnonzero(links).tolist():
                yield *held[i][:2], int(links[i]), int(reached[i])

    schema = pa.schema([(c, pa.int64()) for c in ("rep", "d1", "links", "to")])
    return map_rows(_dealt(members, "rep", "d1", "n", "at", "vector", "tile"), kernel, schema, "rep long, d1 long, links long, to long")


def near_links(vectors: DataFrame, cosine: float = 0.93) -> tuple[DataFrame, DataFrame]:
    """Representatives (label, dim, d1, d2, rep, n, vector) and what each links with: (rep, d1, links, to)."""
    stored, able = _stored(vectors), digested(vectors).where("dim IS NOT NULL")
    reps = written(able.groupBy("label", "dim", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")), "vectors", "none")
    totals = written(reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("total")), "totals")
    filed = written(_filed(reps.join(totals, ["label", "dim"]), stored), "filed")
    possible = written(_possible(filed, cosine), "possible")
    # vectors go only where a partner may be; an id with two vectors is two here, told apart by d1
    one = ["rep", "d1"]
    wanted = possible.select(*one).distinct()
    facts = reps.select(*one, "n", "vector").join(wanted, one, "left_semi").join(filed.select(*one, "at"), one)
    links = written(_verified(possible.join(facts, one), stored, cosine), "near")
    discard(filed, possible)
    return reps, links


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    reps, links = near_links(vectors, cosine)
    reached = components(links.select(F.col("rep").alias("u"), F.col("to").alias("v")))
    sums = links.groupBy("rep", "d1").agg(F.sum("links").alias("links"))
    same = ["label", "dim", "d1", "d2"]
    facts = reps.drop("vector").join(sums, ["rep", "d1"], "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    known = facts.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = digested(vectors).drop("vector")
    able = rows.where("dim IS NOT NULL").join(known, same).select("vec_id", "n_links", "component_id")
    rest = rows.where("dim IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return able.unionByName(rest).withColumn("kept", F.expr("vec_id <=> component_id"))
