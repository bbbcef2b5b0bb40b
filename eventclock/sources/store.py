"""Ledger, cells and knowledge as tables: append, latest row, keys that are no longer wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the trial ledger, in the order of its files (fixed values).
_COLUMNS = (
    "timestamp string, weakest_etf string, prev_best_calmar double, prev_best_cell string, "
    "name string, ticker string, axis string, labeler string, thresh double, sizing string, "
    "real_calmar double, real_da double, trades int, g2_pass boolean, deployable boolean, "
    "synth_cal double, train_auc double, val_auc double, "
    "real_sharpe double, real_skew double, real_kurt double, n_days int, "
    "is_winner boolean, kept_as_new_best boolean, train_status string, infer_status string"
)
_KINDS = {"string": T.StringType, "double": T.DoubleType, "int": T.IntegerType, "boolean": T.BooleanType}
LEDGER = T.StructType([T.StructField(name, _KINDS[kind]()) for name, kind in (c.split() for c in _COLUMNS.split(", "))])
UNIVERSE = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("name", T.StringType()), T.StructField("asset_class", T.StringType())])


def append(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Adds rows; CSV files get a header each."""
    rows.write.mode("append").option("header", "true").format(fmt).save(path)


def ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(LEDGER).option("header", "true").format(fmt).load(path)


def universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNIVERSE).option("header", "true").csv(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells by ticker and key, so one cell is one directory."""
    cells.write.mode("append").partitionBy("ticker", "cell_key").parquet(path)


def latest(rows: DataFrame, *by: str, order: str = "timestamp") -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def stale(stored: DataFrame, wanted: DataFrame, column: str = "cell_key") -> DataFrame:
    """Stored keys that nothing wants; a report, nothing is deleted."""
    return stored.select(column).distinct().join(wanted.select(column).distinct(), column, "left_anti")


def snapshot_iv(chain: DataFrame, spot: str = "spot") -> DataFrame:
    """At-the-money implied volatility of each day: expiry in 20 to 45 days, nearest strike; day, days_left, strike, iv."""
    ok = chain.where(F.col("days_left").between(20, 45) & (F.col("iv") > 0))
    w = W.partitionBy("day").orderBy(F.abs(F.col("strike") - F.col(spot)), "days_left", "strike", "iv")
    return ok.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("day", F.round("iv", 6).alias("iv"))


def merged_iv(chunks: list[DataFrame], least: int = 500) -> DataFrame:
    """Chunks of daily values as one series, the later chunk first; empty below ``least`` days."""
    parts = [c.select("day", "iv", F.lit(k).alias("__k")) for k, c in enumerate(chunks)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    one = union.groupBy("day").agg(F.max_by("iv", "__k").alias("iv"))
    return one if one.count() >= least else one.limit(0)


def write_oos_bars(bars: DataFrame, thresholds: DataFrame, axis: str, val_end: str, path: str) -> None:
    """Bars behind VAL with the frozen threshold of their key, by axis: what an online replay must give again.

    bars: key, bar_ix, ts, log_close; thresholds: key, threshold, of axes with one number.
    """
    late = bars.where(F.col("ts") >= F.lit(val_end).cast("timestamp_ntz")).join(thresholds.select("key", "threshold"), "key")
    late.withColumn("axis", F.lit(axis)).write.mode("append").partitionBy("axis").parquet(path)


def oos_bars(spark: SparkSession, path: str, axis: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("axis") == axis)


def write_returns(curve: DataFrame, path: str) -> None:
    """Daily returns of an equity curve by strategy, rounded to eight places; days that follow an equity of zero have none."""
    before = F.lag("equity").over(W.partitionBy("strategy").orderBy("t"))
    rows = curve.withColumn("ret", F.when(before != 0, F.round(F.col("equity") / before - 1, 8))).where("ret IS NOT NULL")
    rows.select("strategy", "t", "ret").write.mode("append").partitionBy("strategy").parquet(path)


#: Order of the verdicts in a report (fixed values).
VERDICTS = ("STRONG", "marginal", "NO-FIT", "ARTIFACT", "NO-BASELINE", "PENDING")


def screen_lines(screened: DataFrame) -> DataFrame:
    """line, text: a table of the screen, the best verdicts and edges first.

    screened: ticker, asset_class, recipe, method, hold, edge, val_auc, trades, verdict; null numbers give a dash.
    """
    number = lambda c, form="%.2f": F.coalesce(F.format_string(form, F.col(c).cast("double")), F.lit("-")) if c != "trades" else F.coalesce(F.col(c).cast("string"), F.lit("-"))
    shown = [F.col("ticker"), F.coalesce("asset_class", F.lit("")), F.coalesce("recipe", F.lit("-")), *[F.when(F.col(c).isNull(), "-").otherwise(number(c, "%+.2f" if c == "edge" else "%.2f")) for c in ("method", "hold", "edge", "val_auc", "trades")], F.col("verdict")]
    rank = F.coalesce(*[F.when(F.col("verdict").startswith(v), F.lit(k)) for k, v in enumerate(VERDICTS)], F.lit(len(VERDICTS)))
    # a row for each screened name
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(rank, F.desc_nulls_last("edge"), "ticker"))
    return screened.select(place.alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("text"))


def write_screen(screened: DataFrame, path: str) -> None:
    """The table as a text file with a header."""
    spark = screened.sparkSession
    columns = ("ticker", "class", "recipe", "method", "hold", "edge", "val_auc", "trades", "verdict")
    head = spark.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))], "line int, text string")
    head.unionByName(screen_lines(screened)).coalesce(1).sortWithinPartitions("line").select("text").write.mode("overwrite").text(path)
