"""Operator 3: token ids in files of a compact format.

A file is a table of blocks.  A block holds the ids of consecutive documents:

* ``ranked``: the block's distinct ids, the most frequent first (ties: smaller id);
* ``control``: two bits for each id, four ids a byte, the low bits first: the number
  of its data bytes less one;
* ``data``: the rank of each id, little-endian, in as few bytes as it needs.

Lengths and bytes lie apart, so numpy decodes a block with one table lookup per
control byte.  Documents are dealt by ranges of their id and sorted within, so
blocks in the order of (shard, block) have ascending ids; shards are written by
Spark's writer with its commit protocol, so a lost executor's shard is written again.

Nulls and empty texts give documents with the end id only.  Rows that repeat a
doc_id are written one after the other, in an order that their texts fix.  Documents
without an id come first; a block's ``unnamed`` counts them.  Very long documents make a
block alone.  Other columns than ``doc_id`` and ``text`` are not read; an empty table
gives no block.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventclock.llm.common import bounded_batches, map_rows, text_column, written
from eventclock.llm.pieces import PieceTable, chunks

#: Ids of a block, about; bytes of input that a shard is planned for; characters encoded at once.
BLOCK_IDS, SHARD_BYTES, CHARS = 1 << 18, 64 << 20, 800_000

_sizes = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ranked, control, data of a block."""
    counts = np.bincount(ids)  # ids are those of a vocabulary, so a table of them is small
    distinct = np.flatnonzero(counts)
    order = np.lexsort((distinct, -counts[distinct]))
    rank = np.zeros(len(counts), np.uint32)
    rank[distinct[order]] = np.arange(len(order), dtype=np.uint32)
    values = rank[ids]
    size = 1 + (values >= 1 << 8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    octets = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return distinct[order].astype("<u4").tobytes(), control.tobytes(), octets[np.arange(4) < size[:, None]].tobytes()


def unpack(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block."""
    size = _sizes[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    octets = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    values = np.zeros(n, np.uint32)
    for k in range(4):
        more = size > k
        if not more.any():
            break
        values[more] |= octets[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[values]


@functools.lru_cache(4)
def piece_table(path: str, keep_space: bool) -> PieceTable:
    """Ids of pieces by the tokenizers library, one table for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)  # each piece stays apart
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))

    return PieceTable(encode, keep_space)


BLOCKS = "shard long, block long, n_ids long, unnamed long, doc_ids binary, doc_tokens binary, ranked binary, control binary, data binary"


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Blocks of the ids of all documents, each document with ``end_id`` behind it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    if shards is None:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's estimate, huge where it has none
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES) if size < 1 << 50 else 1)
    # the hash spreads rows that repeat one doc_id
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        table, shard, block = piece_table(tokenizer, True), TaskContext.get().partitionId(), 0
        held, docs, sizes, n = [], [], [], 0
        for group in chunks(rows, 1, CHARS):
            ids, counts = table.ids([t for _, t in group])
            ends = np.cumsum(counts)
            held.append(np.insert(ids, ends, np.uint32(end_id)))
            docs += [d for d, _ in group]
            sizes.append((counts + 1).astype("<i8"))
            n += len(held[-1])
            if n >= BLOCK_IDS:
                yield (shard, block, n, *_packed(docs, sizes, held))
                held, docs, sizes, n, block = [], [], [], 0, block + 1
        if n:
            yield (shard, block, n, *_packed(docs, sizes, held))

    kinds = [*((c, pa.int64()) for c in ("shard", "block", "n_ids", "unnamed")), *((c, pa.binary()) for c in ("doc_ids", "doc_tokens", "ranked", "control", "data"))]
    return map_rows(rows, kernel, pa.schema(kinds), BLOCKS, 1)


def _packed(docs: list[int | None], sizes: list[np.ndarray], held: list[np.ndarray]) -> tuple:
    unnamed = docs.count(None)  # they sort first
    return unnamed, np.array(docs[unnamed:], "<i8").tobytes(), np.concatenate(sizes).tobytes(), *pack(np.concatenate(held))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    token_blocks(docs, tokenizer, end_id).write.mode("overwrite").option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """shard, block, before: ids in all blocks before. Sums by shard first, so no window holds all blocks."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_before"))
    inside = blocks.select("shard", "block", (F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("inside"))
    return inside.join(shards, "shard").select("shard", "block", (F.col("inside") + F.col("shard_before")).alias("before"))


def token_digest(blocks: DataFrame) -> DataFrame:
    """Decodes blocks: doc_id, start, n_tokens, ids_crc32 of each document."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for shard, block, n, unnamed, docs, sizes, ranked, control, data in rows:
            ids = unpack(ranked, control, data, n).astype("<u4")
            sizes = np.frombuffer(sizes, "<i8")
            ends = np.cumsum(sizes)
            for doc, a, b in zip([None] * unnamed + np.frombuffer(docs, "<i8").tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                yield shard, block, doc, a, b - a, zlib.crc32(ids[a:b])

    schema = pa.schema([(c, pa.int64()) for c in ("shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32")])
    rows = map_rows(blocks, kernel, schema, "shard long, block long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # the join moves a few numbers for each document, not the blocks
    return rows.join(block_starts(blocks), ["shard", "block"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files in the shared folder, reads them back, gives the digest of each document."""
    blocks = written(token_blocks(docs, tokenizer, end_id), "tokens", "none")
    return token_digest(blocks)
