"""Operator 2: exact deduplication, DataFrame functions only.

Texts are grouped by a 128-bit hash together with the bytes themselves, so texts
that merely share a hash part.  The grouping is combined before the shuffle: a task
sends each of its distinct texts once, however many copies it holds.  Each row then
finds its group by the two digests in a join of narrow rows, which adaptive
execution splits where one text has very many copies.

Null counts as empty and groups with empty texts.  A null doc_id counts as larger than
any other: such a row stays only where its whole group has none (``keep_id`` is null
then).  Repeated rows with one id are one group and all carry ``kept`` if their id is
the smallest.  Texts of any length are keys as a whole.  Other columns, whatever their
names, pass by unread; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventclock.llm.common import named, text_column


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; only runs that change are touched."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def exact_groups(docs: DataFrame, hashed=content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    hashed: the content hash; a weak one costs time, not correctness.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_column(docs)).alias("norm"))
    groups = (
        rows.select("doc_id", hashed(F.col("norm")).alias("h"), "norm")
        .groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # within one hash, texts are told apart by their SHA-256
    own = rows.select("doc_id", hashed(F.col("norm")).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    return own.join(groups, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of ``docs``: of equal texts the one with the smallest id.

    Rows that repeat that id with that text are one document: one of them stays.
    """
    columns = docs.columns
    norm = normalised(text_column(docs))
    # of the columns only the text is part of the key; the rest of a row rides along with the
    # smallest id, its own text only where that differs from the key
    text = F.when(~named("text").eqNullSafe(norm), named("text"))
    others = [named(c).alias(f"c{i}") for i, c in enumerate(columns) if c != "text"]
    row = F.struct(*others, text.alias("text"), named("text").isNull().alias("empty"))
    order = F.struct(named("doc_id").isNull(), named("doc_id"))
    kept = docs.select(content_hash(norm).alias("h"), norm.alias("n"), row.alias("r"), order.alias("o")).groupBy("h", "n").agg(F.min_by("r", "o").alias("r"))
    own = F.when(F.col("r.empty"), F.lit(None)).otherwise(F.coalesce("r.text", "n")).cast(docs.schema["text"].dataType)
    return kept.select(*[(own if c == "text" else F.col(f"r.c{i}")).alias(c) for i, c in enumerate(columns)])
