"""Rounds of cells: fit, score, control by permuted labels, keep what passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.operators import stats
from eventclock.plans import cell
from eventclock.plans.config import CellConfig


def weakest(best: DataFrame) -> DataFrame:
    """Tickers by what they have so far, the weakest first."""
    return best.orderBy("calmar", "g2_pass", "ticker")


def run_all(bars: Callable[[CellConfig], DataFrame], configs: Iterable[CellConfig], at_once: int = 2) -> DataFrame:
    """Scores of all cells; independent cells run as concurrent jobs of one session."""
    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(lambda c: cell.run(bars(c), c), configs))
    return reduce(DataFrame.unionByName, parts)


def controlled(bars: Callable[[CellConfig], DataFrame], config: CellConfig, hold: DataFrame) -> DataFrame:
    """key, real, permuted, hold, passed: the same cell with permuted labels must lose its edge; hold has key, hold."""
    real = cell.run(bars(config), config).select("key", F.col("calmar").alias("real"))
    other = replace(config, permute_labels=True)
    permuted = cell.run(bars(other), other).select("key", F.col("calmar").alias("permuted"), F.col("trades").alias("permuted_trades"))
    return stats.permute_gate(real.join(permuted, "key").join(hold, "key"))


def kept(results: DataFrame) -> DataFrame:
    """Adds kept: deployable, better than before, above water, informative on VAL, and significant among all trials."""
    ok = F.col("deployable") & (F.col("calmar") > F.col("prev_calmar")) & (F.col("calmar") > 0) & (F.col("val_auc") > 0.52) & (F.col("psr") > 1 - 0.05 / F.col("trials"))
    return results.withColumn("kept", F.coalesce(ok, F.lit(False)))
