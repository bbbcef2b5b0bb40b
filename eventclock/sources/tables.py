"""Tick and bar sources over the supplied tables, with declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Training and validation ends: rows before the first are TRAIN, before the second VAL.
TICK_CUTS = ("2024-01-19 00:00:00", "2024-01-25 00:00:00")
BAR_CUTS = ("1999-02-01 00:00:00", "2000-06-01 00:00:00")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ticks(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """key, ts, seq, close, volume."""
    events = read(spark, sf_dir, "events")
    return events.select(F.col(key).cast("string").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("close"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def ticks_sql(key: str = "event_type") -> str:
    return f"(SELECT CAST({key} AS VARCHAR) AS key, ts, event_id AS seq, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key and day: mean unit price and quantity."""
    lines = read(spark, sf_dir, "lineitem")
    days = lines.groupBy(F.col("l_returnflag").alias("key"), F.col("l_shipdate").alias("ts")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("close"), F.sum("l_quantity").alias("volume"))
    return days.withColumn("seq", F.lit(0))


DAILY_SQL = "(SELECT l_returnflag AS key, l_shipdate AS ts, round(avg(l_extendedprice / l_quantity), 6) AS close, sum(l_quantity) AS volume, 0 AS seq FROM lineitem GROUP BY 1, 2)"

_BARS = (
    {"bar_ix": "row_number() OVER (PARTITION BY key ORDER BY ts, seq) - 1", "lc": "ln(close)"},
    {"lr": "coalesce(lc - lag(lc) OVER (PARTITION BY key ORDER BY ts, seq), 0.0)"},
)


def split_text(cuts: tuple[str, str], ts: str = "ts") -> str:
    return f"CASE WHEN {ts} < TIMESTAMP '{cuts[0]}' THEN 'train' WHEN {ts} < TIMESTAMP '{cuts[1]}' THEN 'val' ELSE 'test' END"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, ts, seq, bar_ix, lc, lr, volume, split: bars of the daily series."""
    from eventclock.functions.dialect import steps

    cut = {"split": split_text(BAR_CUTS).replace("TIMESTAMP", "TIMESTAMP_NTZ")}
    return steps(daily(spark, sf_dir), *_BARS, cut).select("key", "ts", "seq", "bar_ix", "lc", "lr", "volume", "split")


def bars_sql() -> str:
    from eventclock.functions.dialect import steps_sql

    return steps_sql(DAILY_SQL, *_BARS, {"split": split_text(BAR_CUTS)})


# --- views that the sizing, performance and statistics queries read ---

_PREDS = ({"p": "0.5 + 0.45 * sin(bar_ix * 0.7) * cos(bar_ix * 0.013)"},)
_CURVES = (
    {"mu": "avg(close) OVER (PARTITION BY key)", "sd": "stddev_samp(close) OVER (PARTITION BY key)"},
    {"ret": "round(0.001 * (close - mu) / sd + 0.0002, 9)", "strategy": "key", "t": "ts"},
    {"equity": "exp(sum(ret) OVER (PARTITION BY key ORDER BY ts, seq))"},
)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a stand-in probability."""
    from eventclock.functions.dialect import steps

    return steps(bars(spark, sf_dir), *_PREDS)


def preds_sql() -> str:
    from eventclock.functions.dialect import steps_sql

    return steps_sql(bars_sql(), *_PREDS)


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, t, ret, equity."""
    from eventclock.functions.dialect import steps

    return steps(daily(spark, sf_dir), *_CURVES).select("strategy", "t", "ret", "equity")


def curves_sql() -> str:
    from eventclock.functions.dialect import steps_sql

    return f"(SELECT strategy, t, ret, equity FROM {steps_sql(DAILY_SQL, *_CURVES)})"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per supplier: moments of its discounts about their middle, and a p-value; families by supplier modulo 3."""
    from eventclock.functions.dialect import phi, steps

    x = F.col("l_discount") - 0.049
    by = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("trial"))
    rows = by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x) / F.stddev_samp(x), 9).alias("sr"), F.round(F.skewness(x), 9).alias("skew"), F.round(F.kurtosis(x) + 3, 9).alias("kurt"))
    return steps(rows, {"p": f"round(1 - {phi('(sr * sqrt(n))')}, 9)", "family": "concat('f', CAST(trial % 3 AS STRING))"})


def trials_sql() -> str:
    from eventclock.functions.dialect import phi

    x, m = "(l_discount - 0.049)", "(l_discount - a)"
    base = "(SELECT *, avg(l_discount) OVER (PARTITION BY l_suppkey) AS a FROM lineitem)"
    moments = f"SELECT CAST(l_suppkey AS BIGINT) AS trial, count(*) AS n, round(avg({x}) / stddev_samp({x}), 9) AS sr, round(avg({m} * {m} * {m}) / power(avg({m} * {m}), 1.5), 9) AS skew, round(kurtosis_pop({x}) + 3, 9) AS kurt FROM {base} GROUP BY 1"
    return f"(SELECT *, round(1 - {phi('(sr * sqrt(n))')}, 9) AS p, concat('f', CAST(trial % 3 AS VARCHAR)) AS family FROM ({moments}))"


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, t, event: orders by price band as durations, open for status O."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("family"), F.floor(F.col("o_totalprice") / 5000).cast("long").alias("t"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("event"))


DURATIONS_SQL = "(SELECT o_orderpriority AS family, CAST(floor(o_totalprice / 5000) AS BIGINT) AS t, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS event FROM orders)"


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of customers as configurations: id, axis, labeler, sizing."""
    kinds = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("axis"), F.concat(F.lit("l"), (F.col("c_nationkey") % 7).cast("string")).alias("labeler"), F.concat(F.lit("s"), (F.col("c_nationkey") % 3).cast("string")).alias("sizing")).distinct()
    return kinds.select(F.concat_ws("/", "axis", "labeler", "sizing").alias("id"), "*")


CONFIGS_SQL = "(SELECT axis || '/' || labeler || '/' || sizing AS id, * FROM (SELECT DISTINCT c_mktsegment AS axis, 'l' || (c_nationkey % 7) AS labeler, 's' || (c_nationkey % 3) AS sizing FROM customer))"


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as screened assets."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") % 97 / 10, 6).alias("method_calmar"), F.round(F.col("p_retailprice") % 13 / 10, 6).alias("hold_calmar"), (F.col("p_size") * 10).cast("long").alias("hold_trades"), F.round(0.4 + F.col("p_partkey") % 40 / 100, 6).alias("val_auc"), (F.col("p_partkey") % 200).cast("long").alias("trades"))


SCREEN_SQL = "(SELECT p_partkey AS id, round(p_retailprice % 97 / 10, 6) AS method_calmar, round(p_retailprice % 13 / 10, 6) AS hold_calmar, CAST(p_size * 10 AS BIGINT) AS hold_trades, round(0.4 + p_partkey % 40 / 100, 6) AS val_auc, CAST(p_partkey % 200 AS BIGINT) AS trades FROM part)"


def driven_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with two outside series, known one day after their date."""
    from eventclock.operators.joins import asof

    days = read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.log(F.round(F.avg("o_totalprice"), 6)).alias("drv"), F.log(F.count(F.lit(1)).cast("double")).alias("slp"))
    joined = bars(spark, sf_dir)
    names = sorted(r.key for r in joined.select("key").distinct().collect())  # series, each with the same outside values
    keys = F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("key")
    for value in ("drv", "slp"):
        joined = asof(joined, days.select(keys, "ts", value), value, lag="1 DAY")
    return joined


def driven_bars_sql() -> str:
    days = "(SELECT o_orderdate + INTERVAL 1 DAY AS ts, ln(round(avg(o_totalprice), 6)) AS drv, ln(CAST(count(*) AS DOUBLE)) AS slp FROM orders GROUP BY o_orderdate)"
    return f"(SELECT b.*, d.drv, d.slp FROM {bars_sql()} b ASOF LEFT JOIN {days} d ON b.ts >= d.ts)"
