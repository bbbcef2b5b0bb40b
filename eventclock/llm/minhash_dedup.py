"""Operator 9: near-duplicate documents by MinHash bands, odd sketches and exact sets.

1. One pass over the texts gives each document its number of distinct shingles, a
   128-bit digest of the set, band keys of some MinHash samples each, and an odd sketch:
   all ``SAMPLES`` samples folded into ``SKETCH_BITS`` parity bits.  The bits in which
   two sketches differ estimate how many samples differ.
2. Documents with equal sets are one class; what follows looks at classes.
3. In each bucket of a band a class meets the bucket's smallest class only, not all
   others.  Pairs whose sizes or sketches rule out the wanted similarity go; the others
   are compared on their full sets.
4. Buckets that still hold several components are compared across components, tile by
   tile: first by sketches, which leaves the classes that have a possible partner, then
   those on their full sets.  What leaves a tile is a spanning forest of the links found
   there, never its pairs.  So a large group of near copies costs work in proportion to
   its size, and all pairs of different components get compared.

Sketches only reject what lies ``SIGMAS`` standard deviations below the wanted
similarity.  Bands are as long as they can be while a pair at the threshold shares no
band with a chance below ``MISSED``: 32 bands of 8 samples at 0.85, 42 of 6 at 0.80.

Null texts and texts without words have an empty set and link with nothing, nor does a
document without an id, whose component is null and which stays.  Rows that repeat one
doc_id are one document.  Ties do not matter: components have smallest ids.  Texts of any
length count whole.  Columns but ``doc_id`` and ``text`` are not read, ``near_dedup`` hands
them on; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventclock.llm.common import bounded_batches, discard, map_rows, named, text_column, written
from eventclock.llm.components import components
from eventclock.llm.pieces import chunks
from eventclock.llm.shingles import mix, shingle_sets
from eventclock.llm.url_filter import BITS_PER_RULE, BLOCK_BITS, BROADCAST_BLOCKS, bloom_filter, probe

SAMPLES, MISSED, SKETCH_BITS, SIGMAS, TILE = 256, 1e-4, 1_024, 5.0, 512
_random = np.random.default_rng(11)
_factor = _random.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_offset = _random.integers(0, 1 << 32, SAMPLES, np.uint32)
_place = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for a in range(0, len(x), 512):
        part = (x[a : a + 512, None] ^ _offset) * _factor
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def band_rows(percent: int) -> int:
    """Samples of a band."""
    return max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** (SAMPLES // r) <= MISSED)


def band_keys(own: np.ndarray, rows: int) -> np.ndarray:
    bands = SAMPLES // rows
    h = _place[:bands].copy()
    for column in own[: bands * rows].reshape(bands, rows).T.astype(np.uint64):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return h.view(np.int64)


def odd_sketch(own: np.ndarray) -> np.ndarray:
    """Parity bits of the numbered samples, as 64-bit words."""
    at = (mix(_place ^ own.astype(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view("<i8")


def most_differing(percent: int) -> int:
    """Differing sketch bits that a pair of the wanted similarity exceeds with no chance to speak of."""
    j = percent / 100
    apart = SAMPLES * (1 - j) + SIGMAS * np.sqrt(SAMPLES * j * (1 - j))
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * apart))
    return int(np.ceil(expected + SIGMAS * np.sqrt(expected / 4)))


def signatures(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """doc_id, n (distinct shingles), d1, d2 (digest of the set), bands, sketch."""
    bounded_batches(docs.sparkSession)
    length = band_rows(percent)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for group in chunks(rows, 1):
            for (doc, _), own in zip(group, shingle_sets([t for _, t in group], words), strict=True):
                if not len(own):
                    yield doc, 0, 0, 0, [], []
                    continue
                digest = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8").tolist()
                drawn = samples(own)
                yield doc, len(own), *digest, band_keys(drawn, length).tolist(), odd_sketch(drawn).tolist()

    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", longs), ("sketch", longs)])
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")), kernel, schema, "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>", 1_000)


def full_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """id and the set of shingle numbers of each row, as sorted unsigned 64-bit words."""
    bounded_batches(docs.sparkSession)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for group in chunks(rows, 1):
            for (doc, _), own in zip(group, shingle_sets([t for _, t in group], words), strict=True):
                yield doc, own.astype("<u8").tobytes()

    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")), kernel, schema, "id long, shingles binary", 200)


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the listed documents. A Bloom filter of bounded size drops most others
    where they are read, so their texts don't enter the join that decides."""
    blocks = min(BROADCAST_BLOCKS, max(1, -(-ids.count() * BITS_PER_RULE // BLOCK_BITS)))
    block, words = probe(F.col("doc_id"), blocks)
    bits = range(len(words))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"block": block, **{f"b{k}": words[k] for k in bits}})
    bloom = F.broadcast(bloom_filter(ids.select(F.col("doc_id").alias("key")), blocks))
    passed = rows.join(bloom, "block").where(" and ".join(f"(w{k} & b{k}) = b{k}" for k in bits)).select("doc_id", "text")
    return passed.join(ids, "doc_id", "left_semi")


def _similar_size(percent: int) -> Column:
    return F.expr(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets have the wanted similarity.

    The sets of a u's partners go to it in portions of about ``TILE``; its own set goes
    once to each portion, not to each pair.
    """
    portions = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("portions"))
    partners = pairs.join(portions, "u").select("u", F.pmod(F.xxhash64("v"), F.col("portions")).cast("int").alias("portion"), F.col("v").alias("id"))
    heads = portions.select("u", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.col("u").alias("id"))
    rows = partners.unionByName(heads).join(sets, "id").withColumn("head", F.col("id") == F.col("u"))
    dealt = rows.repartition("u", "portion").sortWithinPartitions("u", "portion", F.desc("head")).select("u", "portion", "head", "id", "shingles")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (u, _), own in itertools.groupby(rows, key=lambda r: r[:2]):
            heads = []  # more than one where rows repeat an id with another text
            for _, _, head, v, data in own:
                shingles = np.frombuffer(data, "<u8")
                if head:
                    heads.append(shingles)
                elif any(_similar(h, shingles, percent) for h in heads):
                    yield u, v

    return map_rows(dealt, kernel, pa.schema([("u", pa.int64()), ("v", pa.int64())]), "u long, v long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _with_facts(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and sketches leave."""
    u = classes.select(F.col("rep").alias("u"), F.col("n").alias("n_u"), F.col("sketch").alias("s_u"))
    v = classes.select(F.col("rep").alias("v"), F.col("n").alias("n_v"), F.col("sketch").alias("s_v"))
    apart = F.aggregate(F.zip_with("s_u", "s_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, x: t + x)
    return pairs.join(u, "u").join(v, "v").where(_similar_size(percent)).where(apart <= most_differing(percent)).select("u", "v").distinct()


def near_groups(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    percent: documents link if 100 * intersection >= percent * union of their sets.
    """
    signed = written(signatures(docs, percent, words), "signatures", "none")
    classes = written(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes", "none")

    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    # a bucket with one class has nothing to compare
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("p")).where("size > 1").drop("size")
    members = written(banded.join(buckets, ["band", "key"]), "members")
    met = members.where("rep != p").select(F.col("p").alias("u"), F.col("rep").alias("v")).distinct()
    first = written(_with_facts(met, classes, percent), "pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        chosen = written(ids.distinct(), "ids")
        sets = written(full_sets(_chosen(docs, chosen), words), "sets", "none")
        discard(chosen)
        return sets

    sets = sets_of(first.select(F.col("u").alias("doc_id")).union(first.select("v")))
    links = written(_verified(first, sets, percent), "links")
    discard(first, sets)
    groups = components(links)

    grouped = members.select("band", "key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    second = written(_possible(_tiled(grouped).join(classes.select("rep", "n", "sketch"), "rep"), percent), "possible")
    discard(members, groups)
    more_sets = sets_of(second.select(F.col("rep").alias("doc_id")))
    more = written(_across(second, more_sets, percent), "links")
    discard(second, more_sets)
    final = components(links.unionByName(more))
    discard(links, more)

    out = signed.select("doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("CASE WHEN doc_id IS NOT NULL THEN coalesce(component, rep, doc_id) END").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


_TILE = ["band", "key", "i", "j"]


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """All rows of a tile in one partition, one after the other."""
    return rows.repartition(*[F.col(k) for k in _TILE]).sortWithinPartitions(*_TILE).select(*_TILE, *columns)


def _tiles(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with one tile key; a tile with one row has no pair."""
    key, held = None, []
    for row in rows:
        if row[:4] != key:
            if len(held) > 1:
                yield key, held
            key, held = row[:4], []
        held.append(row[4:])
    if len(held) > 1:
        yield key, held


def _tiled(grouped: DataFrame) -> DataFrame:
    """Rows of buckets with several components, each for every pair of tiles in which it may meet another component.

    A component of ``TILE`` rows or more in a bucket has tiles of its own, which don't meet
    each other; smaller ones share tiles.  So what a large group of near copies adds to a
    bucket is its size times the few tiles of the others, not its size squared.
    """
    bucket = ["band", "key"]
    sizes = grouped.groupBy(*bucket, "component").agg(F.count(F.lit(1)).alias("size"))
    own = F.when(F.col("size") >= TILE, F.col("component"))  # null: shared
    groups = sizes.groupBy(*bucket, own.alias("own")).agg(F.ceil(F.sum("size") / TILE).cast("int").alias("tiles"), F.count(F.lit(1)).alias("components"))
    # a bucket has a row here for its shared tiles and each component of its own, not for each member
    groups = groups.withColumn("first", (F.sum("tiles").over(W.partitionBy(*bucket).orderBy("own")) - F.col("tiles")).cast("int"))
    mixed = groups.groupBy(*bucket).agg(F.sum("components").alias("components"), F.collect_list(F.struct("own", "first", "tiles")).alias("groups")).where("components > 1").drop("components")
    rows = grouped.join(mixed, bucket)
    mine = F.when(F.exists("groups", lambda g: g["own"] == F.col("component")), F.col("component"))
    rows = rows.withColumn("mine", mine).withColumn("place", F.filter("groups", lambda g: g["own"].eqNullSafe(F.col("mine")))[0])
    rows = rows.withColumn("tile", (F.col("place.first") + F.pmod(F.xxhash64("rep"), F.col("place.tiles"))).cast("int"))
    others = F.filter("groups", lambda g: F.col("mine").isNull() | ~g["own"].eqNullSafe(F.col("mine")))
    numbers = F.flatten(F.transform(others, lambda g: F.sequence(g["first"], g["first"] + g["tiles"] - 1)))
    rows = rows.select(*bucket, "rep", "component", "tile", F.explode(numbers).alias("other"))
    return rows.select(*bucket, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "rep", "component", "tile")


def _possible(tiled: DataFrame, percent: int) -> DataFrame:
    """Classes of each tile that sizes and sketches leave a partner of another component."""
    most = most_differing(percent)
    dealt = _dealt(tiled, "rep", "component", "n", "sketch", "tile")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, held in _tiles(rows):
            rep, component, n, sketch, tile = (np.array(x) for x in zip(*held, strict=True))
            sketch = sketch.view(np.uint64)  # bits of a signed number would be counted without its sign
            some = np.zeros(len(rep), bool)
            for a in range(0, len(rep), 128):
                part = slice(a, a + 128)
                low, high = np.minimum(n[part, None], n), np.maximum(n[part, None], n)
                near = (component[part, None] != component) & (100 * low >= percent * high)
                if key[2] != key[3]:
                    near &= tile[part, None] != tile
                p, q = np.nonzero(near)
                for s in range(0, len(p), 65_536):
                    u, v = p[s : s + 65_536] + a, q[s : s + 65_536]
                    some[u[np.bitwise_count(sketch[u] ^ sketch[v]).sum(axis=1, dtype=np.int64) <= most]] = True
            for i in np.flatnonzero(some).tolist():
                yield *key, *held[i]

    kinds = [(c, pa.int64()) for c in (*_TILE, "rep", "component", "n")]
    schema = pa.schema([*kinds, ("sketch", pa.list_(pa.int64())), ("tile", pa.int64())])
    return map_rows(dealt, kernel, schema, "band long, key long, i long, j long, rep long, component long, n long, sketch array<long>, tile long", 1_000)


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, found in each tile on full sets: a spanning forest of them."""
    most = most_differing(percent)
    rows = _dealt(members.join(sets.withColumnRenamed("id", "rep"), "rep"), "rep", "component", "n", "sketch", "tile", "shingles")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, held in _tiles(rows):
            rep, component, n, sketch, tile = (np.array(x) for x in zip(*(h[:5] for h in held), strict=True))
            sketch, sizes = sketch.view(np.uint64), np.array([len(h[5]) // 8 for h in held])
            flat = np.frombuffer(b"".join(h[5] for h in held), "<u8")
            _, flat = np.unique(flat, return_inverse=True)
            begin = np.cumsum(sizes) - sizes
            mine, group = np.zeros(int(flat.max()) + 1, np.int64), component.copy()
            for i in range(len(rep) - 1):
                low, high = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
                other = np.flatnonzero((group[i + 1 :] != group[i]) & (100 * low >= percent * high)) + i + 1
                if key[2] != key[3]:
                    other = other[tile[other] != tile[i]]
                other = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= most]
                if not len(other):
                    continue
                mine[flat[begin[i] : begin[i] + sizes[i]]] = 1
                at = np.repeat(begin[other] - (np.cumsum(sizes[other]) - sizes[other]), sizes[other]) + np.arange(int(sizes[other].sum()))
                shared = np.add.reduceat(mine[flat[at]], np.cumsum(sizes[other]) - sizes[other])
                mine[flat[begin[i] : begin[i] + sizes[i]]] = 0
                for j in other[100 * shared >= percent * (sizes[i] + sizes[other] - shared)].tolist():
                    if group[i] != group[j]:
                        yield int(rep[i]), int(rep[j])
                        group[group == group[j]] = group[i]

    return map_rows(rows, kernel, pa.schema([("u", pa.int64()), ("v", pa.int64())]), "u long, v long")


def near_dedup(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """The documents that stay, with all columns of ``docs``: one of each group, and all without an id."""
    name = "kept_id"
    while name in map(str.lower, docs.columns):
        name += "_"
    kept = near_groups(docs, percent, words).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, named("doc_id").cast("long").eqNullSafe(named(name)), "left_semi")
