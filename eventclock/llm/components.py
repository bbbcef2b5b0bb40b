"""Connected components of links: contraction within each task, then alternating large-star and small-star rounds.

A task first replaces each portion of its links by stars around the smallest node of
every component in the portion, so small components are done before the first round.
Each round then moves every link towards the smallest node of its component and is
written in the shared folder, which cuts the lineage.  All rounds are joins and
aggregations that combine before the shuffle; nothing is collected but two numbers a
round.  Rounds grow with the logarithm of the longest path; a round's table goes when
the next is written.  Links of null or equal nodes link nothing; no links give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.llm.common import discard, written

#: Links that a task contracts at once.
PORTION = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    some = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[some], nodes[root[some]]


def _contracted(links: DataFrame) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            made = stars(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], schema=schema)

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= PORTION:
                yield close()
                held, size = [], 0
        if size:
            yield close()

    return links.mapInArrow(run, "u long, v long")


def _mark(links: DataFrame) -> tuple[int, int]:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """links: (u, v). One row (node, component) for each node of a link: the smallest node it reaches."""
    ordered = links.where("u != v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    now = written(_contracted(ordered).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        found = _mark(after)
        discard(now)
        now, mark, before = after, found, mark
        if found == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = nodes.unionByName(roots)
    found._written_at = now._written_at
    return found
