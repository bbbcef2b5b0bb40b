"""Joins of series in time.

An as-of join takes for each row the last row of another series at or before its time.
It is one union and one ordered window: both sides are sorted once by key and time, the
other side first among equal times.  Key skew is the key's own length, as in any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, value: str, ts: str = "ts", key: str = "key", strict: bool = False, lag: str | None = None) -> DataFrame:
    """``left`` with ``value``: the last of ``right`` at or before ts.

    strict: only before. lag: an interval after which a value of ``right`` is known, as
    in ``"7 days"``. Values of null are passed over.
    """
    known = F.col(ts) + F.expr(f"INTERVAL {lag}") if lag else F.col(ts)
    r = right.where(F.col(value).isNotNull()).select(F.col(key).alias("__k"), known.alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__row"))
    l = left.select(F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct("*").alias("__row"))
    order = W.partitionBy("__k").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    filled = r.unionByName(l).withColumn("__v", F.last("__v", ignorenulls=True).over(order))
    return filled.where(F.col("__row").isNotNull()).select("__row.*", F.col("__v").alias(value))


def ingest(ticks: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """key, ts, close, volume and the other series' last value, zero before its first."""
    return asof(ticks, other, value).select("key", "ts", "close", "volume", F.coalesce(value, F.lit(0.0)).alias(value))


def fill_leading(joined: DataFrame, value: str, own: str) -> DataFrame:
    """Zero or less counts as missing; what is still missing takes the row's own value."""
    usable = F.when(F.col(value) > 0, F.col(value))
    return joined.withColumn(value, F.coalesce(usable, F.col(own)))


def enough(joined: DataFrame, value: str, key: str = "key", least: int = 300) -> DataFrame:
    """Keys in which the value is known for at least ``least`` rows and half of all."""
    by = W.partitionBy(key)
    n, known = F.count(F.lit(1)).over(by), F.count(value).over(by)
    return joined.withColumn("__ok", known >= F.greatest(F.lit(least), n / 2)).where("__ok").drop("__ok")


def common_grid(curves: DataFrame, strategies: int, t: str = "t") -> DataFrame:
    """Rows at times that all strategies have."""
    shared = curves.groupBy(t).agg(F.countDistinct("strategy").alias("__n")).where(F.col("__n") == strategies).select(t)
    return curves.join(shared, t, "left_semi")


def matched(online: DataFrame, saved: DataFrame, value: str = "pred") -> DataFrame:
    """Largest difference of two prediction lists, and how many rows of either lack a partner."""
    both = online.select("key", "ts", F.col(value).alias("a")).join(saved.select("key", "ts", F.col(value).alias("b")), ["key", "ts"], "full")
    return both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"), F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("unmatched"))


def ensemble(members: DataFrame) -> DataFrame:
    """Mean prediction of the members at bars that all of them have."""
    n = members.select("member").distinct().count()
    return members.groupBy("key", "ts").agg(F.avg("pred").alias("pred"), F.countDistinct("member").alias("n")).where(F.col("n") == n).drop("n")


def when_listed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return df.join(names.select(column).distinct(), column, "left_semi")


def not_listed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return df.join(names.select(column).distinct(), column, "left_anti")


def or_pending(universe: DataFrame, screened: DataFrame, column: str, verdict: Column | None = None) -> DataFrame:
    """The universe with its verdicts; PENDING where there is none."""
    return universe.join(screened, column, "left").withColumn("verdict", F.coalesce(verdict if verdict is not None else F.col("verdict"), F.lit("PENDING")))
