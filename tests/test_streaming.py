"""A stream gives the bars of the batch, on every axis."""

import pytest
from pyspark.sql import functions as F

from eventclock.operators import axes
from eventclock.sources import tables
from eventclock.streaming import online

DATA = "/root/testdata/sf0.001"


def test_batch_and_stream_agree(spark, tmp_path):
    ticks = tables.ticks(spark, DATA)
    name, cut = "dollar", tables.TICK_CUTS[0]
    start = online.frozen(ticks, name, cut)
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").toPandas()
    schema = "key string, ts timestamp, seq long, close double, volume double"
    for k, part in enumerate([rows.iloc[:300], rows.iloc[300:700], rows.iloc[650:]]):  # the last repeats some rows
        spark.createDataFrame(part[["key", "ts", "seq", "close", "volume"]], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = online.bars(stream, start, "40 days").writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.key, r.bar_ix, r.log_close) for r in spark.table("bars").collect())
    want = sorted((r.key, r.bar_ix, r.log_close) for r in axes.build(ticks, name, cut).collect())
    assert got == want


def test_late_rows_are_counted():
    axis = online.start("dollar", 10.0)
    assert axis.update(2, 0, 1.0, 5.0) is None
    assert axis.update(1, 0, 1.0, 50.0) is None and axis.late == 1
    assert axis.update(3, 0, 1.0, 5.0) == (0, 0.0)


@pytest.mark.parametrize("name", list(axes.AXES))
def test_each_axis_one_tick_at_a_time(spark, name):
    ticks = tables.ticks(spark, DATA)
    running, found = online.frozen(ticks, name, tables.TICK_CUTS[0]), []
    for r in ticks.orderBy("ts", "seq").collect():
        bar = running[r.key].update(r.ts, r.seq, r.close, r.volume) if r.key in running else None
        if bar:
            found.append((r.key, bar[0], r.ts, round(bar[1], 9)))
    assert sorted(found) == sorted(map(tuple, axes.build(ticks, name, tables.TICK_CUTS[0]).collect()))


def test_a_stream_of_features_is_scored(spark, tmp_path):
    """A fitted cell scores a stream as it scores a batch."""
    import numpy as np

    from eventclock.operators import learners, models
    from eventclock.plans import bundle

    x = np.random.default_rng(0).normal(size=(20, 2))
    made = bundle.Bundle(["a", "b"], models.Projection(np.zeros(2), np.ones(2), np.eye(2)), learners.Linear(np.array([1.0, -2.0]), 0.1), (np.array([0.2, 0.8]), np.array([0.3, 0.7])))
    text = made.to_json()
    spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, a double, b double").parquet(f"{tmp_path}/in")
    query = bundle.Bundle.from_json(text).predict(stream).writeStream.format("memory").queryName("scored").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.p for r in spark.table("scored").orderBy("id").collect()] == pytest.approx(made.probability(x).tolist(), abs=1e-6)
