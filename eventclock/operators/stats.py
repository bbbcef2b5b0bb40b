"""Statistics of many trials: deflation, multiple testing, resampling.

Trials: trial, n, sr, skew, kurt (raw), p.  P-value procedures are ranks and running
extremes; bootstraps are one task per block of replicates; what must see the trials in
order (LOND) is a fold over one stream, as its levels depend on earlier discoveries.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.functions.dialect import phi, phi_inv, steps, steps_sql

#: Euler's constant.
EULER = 0.5772156649015329
ONE = "(PARTITION BY family)"


def psr_text(benchmark: str = "0.0") -> str:
    """Probability that the true Sharpe ratio exceeds the benchmark, by sample moments."""
    return f"CASE WHEN n > 1 THEN {phi(f'((sr - {benchmark}) * sqrt(n - 1.0) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)))')} END"


def expected_max_text(variance: str, trials: str) -> str:
    """Expected highest Sharpe ratio of trials without skill."""
    z = f"({1 - EULER!r} * {phi_inv(f'1e0 - 1e0 / {trials}')} + {EULER!r} * {phi_inv(f'1e0 - 1e0 / ({trials} * {math.e!r})')})"
    return f"CASE WHEN {trials} >= 2 AND {variance} > 0 THEN sqrt({variance}) * {z} ELSE 0.0 END"


#: Steps and columns of each procedure over trials (family, trial, n, sr, skew, kurt, p).
PROCEDURES: dict[str, tuple[tuple[dict[str, str], ...], tuple[str, ...]]] = {
    "psr": (({"psr": psr_text()},), ("psr",)),
    "dsr": (({"trials": f"count(sr) OVER {ONE}", "va": f"var_pop(sr) OVER {ONE}"}, {"sr0": expected_max_text("va", "trials")}, {"dsr": psr_text("sr0")}), ("sr0", "dsr")),
    "min_btl": (({"trials": f"count(sr) OVER {ONE}", "year": "sr * sqrt(252.0)"}, {"unit": expected_max_text("1e0", "trials")}, {"min_btl": "CASE WHEN year > 0 AND trials >= 2 THEN (unit / year) * (unit / year) ELSE CAST('Infinity' AS DOUBLE) END"}), ("min_btl",)),
    "holm": (
        ({"rk": "row_number() OVER (PARTITION BY family ORDER BY p, trial)", "m": f"count(p) OVER {ONE}"}, {"ok": "CASE WHEN p <= 0.05 / (m - rk + 1) THEN 1 ELSE 0 END"}, {"holm": "min(ok) OVER (PARTITION BY family ORDER BY p, trial)"}),
        ("holm",),
    ),
    "bh": (
        ({"rk": "row_number() OVER (PARTITION BY family ORDER BY p, trial)", "m": f"count(p) OVER {ONE}"}, {"last_ok": f"max(CASE WHEN p <= rk * 0.1 / m THEN rk END) OVER {ONE}"}, {"bh": "CASE WHEN rk <= coalesce(last_ok, 0) THEN 1 ELSE 0 END"}),
        ("bh",),
    ),
    "keep_gate": (({"trials": f"count(sr) OVER {ONE}", "psr": psr_text()}, {"kept": "CASE WHEN sr > 0 AND psr > 1 - 0.05 / trials THEN 1 ELSE 0 END"}), ("psr", "kept")),
    "weakest_first": (({"place": "rank() OVER (PARTITION BY family ORDER BY sr, p)"},), ("place",)),
}


def procedure(trials: DataFrame, name: str) -> DataFrame:
    parts, out = PROCEDURES[name]
    return steps(trials, *parts).select("family", "trial", *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in out])


def procedure_check(source: str, name: str) -> str:
    parts, out = PROCEDURES[name]
    return f"SELECT family, trial, {', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in out)} FROM {steps_sql(source, *parts)}"


def lond(trials: DataFrame, alpha: float = 0.05) -> DataFrame:
    """family, trial, level, reject: online control of false discoveries in the order of trials."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, found, level, reject = part.sort_values("trial"), 0, [], []
        for t, p in enumerate(part["p"].tolist(), 1):
            level.append(6 / math.pi**2 / (t * t) * alpha * (1 + found))
            reject.append(p is not None and p <= level[-1])
            found += reject[-1]
        return part[["family", "trial"]].assign(level=np.round(level, 9), reject=reject)

    return trials.select("family", "trial", "p").groupBy("family").applyInPandas(run, "family string, trial long, level double, reject boolean")


def lond_check(source: str, alpha: float = 0.05) -> str:
    level = f"{6 / math.pi**2!r} / (i.t * i.t) * {alpha} * (1 + f.found)"
    return f"""
WITH RECURSIVE i AS MATERIALIZED (SELECT family, trial, p, row_number() OVER (PARTITION BY family ORDER BY trial) AS t FROM {source}),
f AS (
  SELECT family, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS found, CAST(NULL AS BIGINT) AS trial, CAST(0 AS DOUBLE) AS level, false AS reject FROM i WHERE t = 1
  UNION ALL
  SELECT i.family, i.t, f.found + CASE WHEN i.p <= {level} THEN 1 ELSE 0 END, i.trial, {level}, i.p <= {level} FROM f JOIN i ON i.family = f.family AND i.t = f.t + 1
)
SELECT family, trial, round(level, 9) AS level, reject FROM f WHERE t > 0"""


def lo_factor(returns: DataFrame) -> DataFrame:
    """strategy, eta: how much autocorrelation widens the error of a Sharpe ratio, at least one."""
    rows = steps(returns, {"nn": "count(ret) OVER (PARTITION BY strategy)", "d": "ret - avg(ret) OVER (PARTITION BY strategy)"})
    lags = 12
    rows = steps(rows, {f"c{k}": f"d * lag(d, {k}) OVER (PARTITION BY strategy ORDER BY t)" for k in range(1, lags + 1)})
    q = F.least(F.greatest(F.lit(1), F.floor(F.pow(F.first("nn"), F.lit(0.25)) + 1e-12)), F.lit(lags))
    parts = rows.groupBy("strategy").agg(q.alias("q"), F.first("nn").alias("nn"), F.avg(F.col("d") * F.col("d")).alias("v"), *[F.sum(f"c{k}").alias(f"s{k}") for k in range(1, lags + 1)])
    total = sum((F.when(F.col("q") >= k, (1 - k / (F.col("q") + 1)) * F.col(f"s{k}") / F.col("nn") / F.col("v")).otherwise(0.0) for k in range(1, lags + 1)), F.lit(0.0))
    eta = F.when((F.col("nn") < 8) | (F.col("v") <= 1e-18) | (1 + 2 * total <= 1), 1.0).otherwise(F.sqrt(1 + 2 * total))
    return parts.select("strategy", F.round(eta, 6).alias("eta"))


def lo_factor_check(source: str) -> str:
    return f"""
WITH b AS (SELECT strategy, t, ret - avg(ret) OVER (PARTITION BY strategy) AS d, row_number() OVER (PARTITION BY strategy ORDER BY t) AS k, count(ret) OVER (PARTITION BY strategy) AS n FROM {source}),
g AS (SELECT strategy, max(n) AS n, avg(d * d) AS v, least(12, greatest(1, floor(power(max(n), 0.25) + 1e-12))) AS q FROM b GROUP BY strategy),
c AS (SELECT a.strategy, a.k - e.k AS lag, sum(a.d * e.d) AS s FROM b a JOIN b e ON a.strategy = e.strategy AND a.k - e.k BETWEEN 1 AND 12 GROUP BY 1, 2),
w AS (SELECT g.strategy, sum(CASE WHEN c.lag <= g.q THEN (1 - c.lag / (g.q + 1)) * c.s / g.n / g.v ELSE 0 END) AS s FROM g JOIN c USING (strategy) GROUP BY 1)
SELECT strategy, round(CASE WHEN n < 8 OR v <= 1e-18 OR 1 + 2 * s <= 1 THEN 1.0 ELSE sqrt(1 + 2 * s) END, 6) AS eta FROM g JOIN w USING (strategy)"""


def kaplan_meier(durations: DataFrame) -> DataFrame:
    """family, t, survival: product-limit estimate; input family, t, event."""
    by = durations.groupBy("family", "t").agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("c"))
    rows = steps(by, {"risk": "sum(c) OVER (PARTITION BY family ORDER BY t DESC)"}, {"factor": "1 - CAST(d AS DOUBLE) / risk"})
    # the factor is zero when all at risk end: a logarithm would lose that
    rows = steps(rows, {"gone": "max(CASE WHEN factor <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY t)", "logs": "sum(CASE WHEN factor > 0 THEN ln(factor) ELSE 0.0 END) OVER (PARTITION BY family ORDER BY t)"})
    return rows.select("family", "t", F.round(F.when(F.col("gone") == 1, 0.0).otherwise(F.exp("logs")), 6).alias("survival"))


def kaplan_meier_check(source: str) -> str:
    return f"""
WITH g AS (SELECT family, t, sum(event) AS d, count(*) AS c FROM {source} GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER (PARTITION BY family ORDER BY t DESC) AS risk FROM g)
SELECT a.family, a.t, round(product(1 - CAST(b.d AS DOUBLE) / b.risk), 6) + 0.0 AS survival FROM r a JOIN r b ON a.family = b.family AND b.t <= a.t GROUP BY 1, 2"""


def pair_correlations(returns: DataFrame, least: int = 20) -> DataFrame:
    """a, b, r for each two strategies over the times both have; zero if they are too few."""
    x, y = returns.select("t", F.col("strategy").alias("a"), F.col("ret").alias("x")), returns.select("t", F.col("strategy").alias("b"), F.col("ret").alias("y"))
    both = x.join(y, "t").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", F.round(F.when(F.col("n") >= least, F.coalesce("r", F.lit(0.0))).otherwise(0.0), 6).alias("r"))


def pair_correlations_check(source: str, least: int = 20) -> str:
    return f"SELECT a.strategy AS a, b.strategy AS b, round(CASE WHEN count(*) >= {least} THEN coalesce(corr(a.ret, b.ret), 0.0) ELSE 0.0 END, 6) AS r FROM {source} a JOIN {source} b ON a.t = b.t AND a.strategy < b.strategy GROUP BY 1, 2"


def affinity(configs: DataFrame) -> DataFrame:
    """a, b, r of each two configurations: weights of the fields they share."""
    x, y = configs.alias("x"), configs.alias("y")
    same = lambda c, w: F.when(F.col(f"x.{c}") == F.col(f"y.{c}"), w).otherwise(0.0)
    return x.join(y, F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(same("axis", 0.5) + same("labeler", 0.3) + same("sizing", 0.2), 6).alias("r"))


def affinity_check(source: str) -> str:
    same = lambda c, w: f"CASE WHEN x.{c} = y.{c} THEN {w} ELSE 0.0 END"
    return f"SELECT x.id AS a, y.id AS b, round(CAST({same('axis', 0.5)} + {same('labeler', 0.3)} + {same('sizing', 0.2)} AS DOUBLE), 6) AS r FROM {source} x JOIN {source} y ON x.id < y.id"


def effective_configs(configs: DataFrame) -> DataFrame:
    """``effective_trials`` of the affinity of configurations, from counts of equal fields: no pair is made.

    The squared affinity of a pair is a sum over two fields at a time of what both share.
    """
    weights = {"axis": 0.5, "labeler": 0.3, "sizing": 0.2}
    both = [(f, g) for f in weights for g in weights if f <= g]
    parts = F.array(*[F.struct(F.lit(weights[f] * weights[g] * (1 if f == g else 2)).alias("w"), F.lit(k).alias("k"), F.col(f).cast("string").alias("f"), F.col(g).cast("string").alias("g")) for k, (f, g) in enumerate(both)])
    shared = configs.select(F.explode(parts).alias("p")).where("p.f IS NOT NULL AND p.g IS NOT NULL").groupBy("p.k", "p.w", "p.f", "p.g").count()
    total = shared.agg(F.coalesce(F.sum(F.col("w") * F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias("s"))
    n = configs.agg(F.count(F.lit(1)).cast("double").alias("n"))  # a row each
    return n.join(total).select(F.round(F.least("n", F.greatest(F.lit(1.0), F.col("n") * F.col("n") / (F.col("n") + 2 * F.col("s")))), 6).alias("n_eff"))


def effective_trials(pairs: DataFrame, n: int) -> DataFrame:
    """Participation ratio of a correlation matrix given its pairs above the diagonal."""
    return pairs.agg(F.round(F.least(F.lit(float(n)), F.greatest(F.lit(1.0), F.lit(float(n * n)) / (n + 2 * F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))))), 6).alias("n_eff"))


# --- resampling: one task per block of replicates; a matrix of returns travels with the closure ---


def stationary_index(n: int, block: float, random: np.random.Generator) -> np.ndarray:
    """Positions of a stationary bootstrap: runs of geometric length that wrap around."""
    fresh = random.random(n) < 1 / max(2.0, block)
    fresh[0] = True
    start = random.integers(0, n, n)
    at = np.flatnonzero(fresh)
    run = np.searchsorted(at, np.arange(n), side="right") - 1
    return (start[at[run]] + np.arange(n) - at[run]) % n


def sharpe(x: np.ndarray) -> float:
    s = float(x.std())
    return float(x.mean()) / s * math.sqrt(252) if s > 1e-12 else 0.0


def calmar(x: np.ndarray) -> np.ndarray:
    equity = np.cumprod(1 + x, axis=-1)
    fall = (1 - equity / np.maximum.accumulate(equity, axis=-1)).max(axis=-1)
    return (np.maximum(equity[..., -1], 1e-12) ** (252 / x.shape[-1]) - 1) / np.maximum(fall, 1e-4)


def surrogate(x: np.ndarray, random: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Series with the same values and spectrum but random phases."""
    size, values, y = np.abs(np.fft.rfft(x)), np.sort(x), random.permutation(x)
    for _ in range(rounds):
        f = np.fft.rfft(y)
        y = np.fft.irfft(f * size / np.maximum(np.abs(f), 1e-20), n=len(x))
        y = values[y.argsort().argsort()]
    return y


def of_each(returns: DataFrame, count: int, draw, seed: int = 42, blocks: int = 16) -> DataFrame:
    """strategy, real, replicate, value of every strategy: draw(returns in order) gives the real value and a function of a generator.

    A replicate's seed is its number; the curve of a strategy goes to one task per block.
    """
    by = returns.groupBy("strategy").agg(F.sort_array(F.collect_list(F.struct("t", "ret"))).getField("ret").alias("x"))
    spark = returns.sparkSession
    tasks = by.crossJoin(spark.range(blocks).withColumnRenamed("id", "block")).repartition(4 * spark.sparkContext.defaultParallelism)

    def run(batches):
        for part in batches:
            for strategy, x, block in zip(part["strategy"], part["x"], part["block"], strict=True):
                real, one = draw(np.asarray(x, float))
                ids = list(range(block, count, blocks))
                yield pd.DataFrame({"strategy": strategy, "real": real, "replicate": ids, "value": [float(one(np.random.default_rng([seed, i]))) for i in ids]})

    return tasks.mapInPandas(run, "strategy string, real double, replicate long, value double")


def bootstrap(returns: DataFrame, count: int = 2000, block: float = 20, statistic=sharpe) -> DataFrame:
    """strategy, replicate, value; input strategy, t, ret."""

    def draw(x: np.ndarray):
        return float(statistic(x)), lambda g: statistic(x[stationary_index(len(x), block, g)])

    return of_each(returns, count, draw).drop("real")


def matrix_of(returns: DataFrame) -> DataFrame:
    """names, m: one row with the returns of each day and strategy, over days that all strategies have."""
    from eventclock.operators.joins import common_grid

    names = sorted(r.strategy for r in returns.select("strategy").distinct().collect())  # columns of the test
    rows = common_grid(returns, len(names)).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("strategy", "ret"))).getField("ret").alias("row"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("t", "row"))).getField("row").alias("m"))


def spa(returns: DataFrame, count: int = 2000, block: float = 20, seed: int = 43, blocks: int = 16) -> DataFrame:
    """p_value, statistic of the test for superior ability over strategies' relative returns; input strategy, t, ret."""
    spark = returns.sparkSession
    tasks = matrix_of(returns).crossJoin(spark.range(blocks).withColumnRenamed("id", "block")).repartition(blocks)

    def run(batches):
        for part in batches:
            for m, number in zip(part["m"], part["block"], strict=True):
                matrix = np.array([np.asarray(r, float) for r in m])
                n = len(matrix)
                mean, spread = matrix.mean(axis=0), np.maximum(matrix.std(axis=0), 1e-12)
                top = max(0.0, float((math.sqrt(n) * mean / spread).max()))
                keep = mean >= -np.sqrt(spread**2 / n * 2 * math.log(math.log(max(3, n))))
                values = []
                for i in range(number, count, blocks):
                    z = math.sqrt(n) * (matrix[stationary_index(n, block, np.random.default_rng([seed, i]))].mean(axis=0) - mean) / spread
                    values.append(max(0.0, float(np.where(keep, z, np.minimum(z, 0)).max())))
                yield pd.DataFrame({"statistic": top, "value": values})

    found = tasks.mapInPandas(run, "statistic double, value double")
    return found.agg(F.avg((F.col("value") >= F.col("statistic")).cast("double")).alias("p_value"), F.max("statistic").alias("statistic"))


def overfit(returns: DataFrame, splits: int = 16, most: int = 1_000) -> DataFrame:
    """pbo, combinations; input strategy, t, ret."""

    def run(batches):
        for part in batches:
            for m in part["m"]:
                share, count = pbo(np.array([np.asarray(r, float) for r in m]).reshape(len(m), -1), splits, most)
                yield pd.DataFrame({"pbo": [share], "combinations": [count]})

    return matrix_of(returns).mapInPandas(run, "pbo double, combinations long")


def pbo(matrix: np.ndarray, splits: int = 16, most: int = 1_000) -> tuple[float, int]:
    """Probability that the best in-sample column is below the median out of sample, over splits into halves."""
    size = len(matrix) // splits
    if size == 0 or splits % 2 or matrix.shape[1] < 2:
        return math.nan, 0
    parts = matrix[: size * splits].reshape(splits, size, -1)
    one, two = parts.sum(axis=1), (parts**2).sum(axis=1)
    combos = list(itertools.combinations(range(splits), splits // 2))
    combos = combos[:: max(1, len(combos) // most)][:most]
    inside = np.zeros((len(combos), splits))
    for i, c in enumerate(combos):
        inside[i, list(c)] = 1

    def ratio(pick: np.ndarray) -> np.ndarray:
        n = pick.sum(axis=1, keepdims=True) * size
        m = pick @ one / n
        s = np.sqrt(np.maximum((pick @ two - n * m * m) / (n - 1), 0))
        return np.where(s > 1e-12, m / np.maximum(s, 1e-300), 0.0)

    best, out = ratio(inside).argmax(axis=1), ratio(1 - inside)
    rank = 1 + (out < out[np.arange(len(out)), best][:, None]).sum(axis=1)
    w = np.clip(rank / (matrix.shape[1] + 1), 1e-6, 1 - 1e-6)
    return float((np.log(w / (1 - w)) <= 0).mean()), len(combos)


def deflated_calmar(returns: DataFrame, trials: int, sets: int = 400, spectrum: bool = False) -> DataFrame:
    """strategy, real, median, p95, p_value, passed: each curve's Calmar against the best of as many curves without drift."""

    def draw(x: np.ndarray):
        flat = x - x.mean()

        def one(g: np.random.Generator) -> float:
            paths = [surrogate(flat, g) if spectrum else flat[stationary_index(len(flat), 10, g)] for _ in range(trials)]
            return float(calmar(np.array(paths)).max())

        return float(calmar(x)), one

    found = of_each(returns, sets, draw, 44).groupBy("strategy").agg(F.max("real").alias("real"), F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.95)).alias("p95"), F.avg((F.col("value") >= F.col("real")).cast("double")).alias("p_value"))
    return found.withColumn("passed", F.col("real") > F.col("p95"))


# --- ledgers ---


def distinct_trials(ledger: DataFrame) -> DataFrame:
    """Replicates of one trial count once."""
    return ledger.withColumn("calmar3", F.round("calmar", 3)).dropDuplicates(["axis", "labeler", "thresh", "sizing", "calmar3"])


def screen_verdicts(screen: DataFrame) -> DataFrame:
    """Adds edge and verdict; input method_calmar, hold_calmar, hold_trades, val_auc, trades."""
    edge = F.col("method_calmar") - F.col("hold_calmar")
    verdict = (
        F.when(F.col("hold_trades") < 80, "NO-BASELINE")
        .when((F.col("method_calmar") >= 8) | (F.abs("hold_calmar") < 0.05) & (F.col("method_calmar") > 0.5), "ARTIFACT(cash)")
        .when((edge > 0) & (F.col("val_auc") > 0.55) & (F.col("trades") > 80), F.when((F.col("method_calmar") > 1) & (edge > 0.3), "STRONG").otherwise("marginal"))
        .otherwise("NO-FIT")
    )
    return screen.withColumns({"edge": F.round(edge, 6), "verdict": verdict})


def screen_rollup(screen: DataFrame) -> DataFrame:
    """Counts and mean edge by class and verdict, by verdict, and of all; input as ``screen_verdicts``, and asset_class."""
    judged = screen_verdicts(screen).withColumn("edge", F.col("method_calmar") - F.col("hold_calmar"))
    by = [F.col("asset_class"), F.col("verdict")]
    return judged.groupingSets([by, by[1:], []], *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("edge"), 6).alias("mean_edge")).select("asset_class", "verdict", "n", "mean_edge")


def permute_gate(runs: DataFrame) -> DataFrame:
    """Adds passed: the label-permuted control must collapse; input real, hold, permuted, permuted_trades."""
    excess = F.col("real") - F.col("hold")
    return runs.withColumn("passed", (F.col("permuted_trades") >= 3) & F.when(excess > 0.15, (F.col("permuted") - F.col("hold")) < 0.4 * excess).otherwise(F.col("permuted") < 0.6 * F.col("real")))


def champions(ledger: DataFrame) -> DataFrame:
    """The best row of each ticker, the latest of equals."""
    from pyspark.sql import Window as W

    order = W.partitionBy("ticker").orderBy(F.desc("calmar"), F.desc("timestamp"))
    return ledger.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def total_trials(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("global_trials"))
