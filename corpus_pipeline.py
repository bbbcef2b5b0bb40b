"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet
and read again as the next stage's docs.  The first four drop documents and keep the
columns; the last gives the packed pieces of what is left.

Null and empty texts and texts without a letter go with the language stage at the latest;
a document without an id links with nothing near and stays.  Repeated rows and equal
texts leave one row.  Very long texts are read whole by each stage; extra columns, whatever
their names, pass through all but the last.  No documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventclock.llm import catalog, exact_dedup, language_id, minhash_dedup, packing, quality
from eventclock.llm.common import discard, scratch, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(docs, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, catalog.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The classifiers are trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep; a stage's tables go when the next one's documents are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = written(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
