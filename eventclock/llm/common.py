"""What the operators of this subpackage share: tables, shared folder, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of an Arrow batch, as texts can be very long; lower ones stay.

    Spark reads them when a plan runs, after the operator has returned, so they can't be
    put back here.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= most:
            spark.conf.set(key, str(most))


_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves on one machine; on a cluster it raises.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends or calls ``release``."""
    name = spark.sparkContext.applicationId
    if name not in _runs:
        _runs[name] = f"{shared_dir(spark)}/written-{name}-{uuid.uuid4().hex}"
        files, path = _hadoop(spark, _runs[name])
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _runs[name]


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators of this application wrote: for between jobs, when no result of theirs is read any more."""
    path = _runs.pop(spark.sparkContext.applicationId, None)
    if path:
        files, p = _hadoop(spark, path)
        files.delete(p, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a table in the application's folder and reads it back: cuts lineage, survives lost executors.

    The files stay as long as the application, so anything derived from the table can be
    read at any time.  An operator's inner tables go earlier, by ``discard``, and those of a
    block of steps by ``scratch``.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    for scope in _scopes:
        scope.append(back)
    return back


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes what is written inside, at its end, but for the tables that are put into the list it gives."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        discard(*(t for t in made if not any(t is k for k in kept)))


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing an operator returns reads."""
    for t in tables:
        files, path = _hadoop(t.sparkSession, t._written_at)
        files.delete(path, True)


def named(c: str) -> Column:
    """A column by its whole name, which may hold dots or backticks."""
    return F.col("`" + c.replace("`", "``") + "`")


def text_column(df: DataFrame) -> Column:
    """The text, empty for null."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def map_rows(df: DataFrame, kernel: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, ddl: str, out_rows: int = 4_000) -> DataFrame:
    """mapInArrow over plain tuples; kernel gets and gives an iterator of tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held = []
        for row in kernel(rows()):
            held.append(row)
            if len(held) >= out_rows:
                yield to_batch(held, schema)
                held = []
        if held:
            yield to_batch(held, schema)

    return df.mapInArrow(run, ddl)


def sampled(marked: DataFrame, counted: Callable[[DataFrame], DataFrame], documents: int, entries: int) -> list[tuple]:
    """(mark, buckets, vals) of the first documents by a hash of their id, until one of the bounds.

    marked: doc_id, once each, with what ``counted`` needs of it.  counted: doc_id, h, mark,
    buckets, vals (4 bytes an entry) of the rows of those ids; of several rows of an id the
    first by value counts.  What reaches the driver is bounded, whatever repeats.
    """
    drawn = marked.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(documents)
    one = counted(drawn).groupBy("h", "doc_id").agg(F.min(F.struct("mark", "buckets", "vals")).alias("r"))
    held, size = [], 0
    for h, doc, r in one.repartition(1).sortWithinPartitions("h", "doc_id").toLocalIterator():
        size += len(r.vals) // 4
        if held and size > entries:
            break
        held.append((r.mark, bytes(r.buckets), bytes(r.vals)))
    return held


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def filter_rows(df: DataFrame, columns: list[str], decide: Callable[[list[tuple]], list[bool]]) -> DataFrame:
    """Rows for which ``decide`` says true, with all columns; it gets the named columns of one batch."""
    names, read = df.columns, [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in read), strict=True))
            yield batch.filter(pa.array(decide(rows), pa.bool_()))

    plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow would look for a name's parts
    return plain.mapInArrow(run, plain.schema).toDF(*names)
