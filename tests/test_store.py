"""Ledger and knowledge tables, and what is written for others."""

from pyspark.sql import functions as F

from eventclock.sources import store


def test_ledger_round_trip(spark, tmp_path):
    row = tuple({"string": "x", "double": 0.5, "int": 3, "boolean": True}[f.dataType.simpleString()] for f in store.LEDGER)
    df = spark.createDataFrame([row], store.LEDGER)
    for fmt in ("parquet", "csv"):
        for _ in range(2):
            store.append(df, f"{tmp_path}/{fmt}", fmt)
        assert [tuple(r) for r in store.ledger(spark, f"{tmp_path}/{fmt}", fmt).collect()] == [row, row]
    assert len(store.LEDGER) == 26
    lines = ["timestamp,weakest_etf,prev_best_calmar", "t,GLD,1.5"]
    (tmp_path / "file.csv").write_text("\n".join(lines))
    assert store.LEDGER.names[:3] == lines[0].split(",")


def test_latest_and_stale(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 3)], "cell_key string, timestamp string, v int")
    assert sorted(r.v for r in store.latest(rows, "cell_key").collect()) == [2, 3]
    assert [r.cell_key for r in store.stale(rows, rows.where("v < 3")).collect()] == ["b"]


def test_implied_volatility(spark):
    chain = spark.createDataFrame([(1, 30, 100.0, 0.2, 101.0), (1, 30, 105.0, 0.3, 101.0), (1, 10, 101.0, 0.9, 101.0), (2, 30, 90.0, 0.0, 101.0)], "day int, days_left int, strike double, iv double, spot double")
    daily = store.snapshot_iv(chain)
    assert [tuple(r) for r in daily.collect()] == [(1, 0.2)]
    assert store.merged_iv([daily, daily], 1).count() == 1 and store.merged_iv([daily], 2).count() == 0


def test_sinks(spark, tmp_path):
    bars = spark.createDataFrame([("a", 0, "2024-01-01 00:00:00", 1.0), ("a", 1, "2024-02-01 00:00:00", 2.0)], "key string, bar_ix long, ts string, log_close double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    store.write_oos_bars(bars, spark.createDataFrame([("a", 7.5)], "key string, threshold double"), "dollar", "2024-01-15 00:00:00", f"{tmp_path}/oos")
    assert [(r.bar_ix, r.threshold) for r in store.oos_bars(spark, f"{tmp_path}/oos", "dollar").collect()] == [(1, 7.5)]
    curve = spark.createDataFrame([("s", 1, 100.0), ("s", 2, 101.0), ("s", 3, 0.0), ("s", 4, 5.0)], "strategy string, t int, equity double")
    store.write_returns(curve, f"{tmp_path}/returns")
    assert sorted((r.t, r.ret) for r in spark.read.parquet(f"{tmp_path}/returns").collect()) == [(2, 0.01), (3, -1.0)]


def test_screen_report(spark, tmp_path):
    rows = [("A", "eq", "ker", 1.0, 0.5, 0.5, 0.6, 90, "marginal"), ("B", None, None, None, None, None, None, None, "PENDING"), ("C", "eq", "ker", 2.0, 0.5, 1.5, 0.6, 90, "STRONG"), ("D", "eq", "ker", 2.0, 0.2, 1.8, 0.6, 90, "STRONG")]
    screened = spark.createDataFrame(rows, "ticker string, asset_class string, recipe string, method double, hold double, edge double, val_auc double, trades int, verdict string")
    lines = [r.text for r in store.screen_lines(screened).orderBy("line").collect()]
    assert [l[2] for l in lines] == ["D", "C", "A", "B"] and lines[1] == "| C | eq | ker | 2.00 | 0.50 | +1.50 | 0.60 | 90 | STRONG |" and lines[3].count(" - ") == 6
    store.write_screen(screened, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()][2:] == lines
