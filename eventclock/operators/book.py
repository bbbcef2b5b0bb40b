"""Books of several strategies: replay of champions, buy and hold, yearly results, derivation of weights.

Replays are per key; what is summed over keys has a row a day, so the curve of a book is
small however many ticks its members have.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventclock.functions.dialect import phi
from eventclock.operators import sizing

YEAR = 252.0


def held(targets: DataFrame, band: float = 0.005, flat: float = 0.003) -> DataFrame:
    """key, bar_ix, held: a change beyond the band is traded, and closes what is then below ``flat``."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, now, out = part.sort_values("bar_ix"), 0.0, []
        for w in part["w"].tolist():
            if abs(w - now) > band:
                now = 0.0 if abs(w) < flat else w
            out.append(now)
        return part[["key", "bar_ix"]].assign(held=out)

    return targets.select("key", "bar_ix", F.col("w").cast("double").alias("w")).groupBy("key").applyInPandas(run, "key string, bar_ix long, held double")


def shares(champions: DataFrame, leverage: float = 1.0) -> DataFrame:
    """key, share of the book; input key, weight. Weights below zero count as zero."""
    total = F.sum(F.greatest("weight", F.lit(0.0))).over(W.partitionBy())  # a row for each champion
    return champions.select("key", (F.greatest("weight", F.lit(0.0)) / F.when(total > 0, total).otherwise(1.0) * leverage).alias("share"))


def replay(preds: DataFrame, champions: DataFrame, mode: str, thresh: float, leverage: float = 1.0) -> DataFrame:
    """t, ret, equity of the book: each champion holds its share of its size, traded beyond a dead band."""
    sizes = sizing.size(preds, mode, thresh).join(shares(champions, leverage), "key")
    kept = held(sizes.select("key", "bar_ix", F.round(F.col("w") * F.col("share"), 9).alias("w")))
    order = W.partitionBy("key").orderBy("bar_ix")
    moves = preds.select("key", "bar_ix", "ts", (F.exp("lc") / F.exp(F.lag("lc").over(order)) - 1).alias("r"))
    earned = moves.join(kept, ["key", "bar_ix"]).withColumn("earned", F.coalesce(F.lag("held").over(order) * F.col("r"), F.lit(0.0)))
    return curve(earned.groupBy(F.col("ts").alias("t")).agg(F.sum("earned").alias("ret")))


def curve(days: DataFrame) -> DataFrame:
    """t, ret, equity of daily returns, starting at one."""
    grown = F.exp(F.sum(F.log1p("ret")).over(W.partitionBy(F.lit(0)).orderBy("t")))
    return days.select("t", F.round("ret", 9).alias("ret"), grown.alias("equity"))


def hold(bars: DataFrame, count: int) -> DataFrame:
    """t, ret, equity of equal parts of all keys, bought once on the first day that all have, over days that all have."""
    closes = bars.select("key", F.col("ts").alias("t"), F.exp("lc").alias("close"))
    common = closes.groupBy("t").agg(F.countDistinct("key").alias("n")).where(F.col("n") == count).select("t")
    by = W.partitionBy("key").orderBy("t")
    worth = closes.join(common, "t").withColumn("worth", F.col("close") / F.first("close").over(by))
    days = worth.groupBy("t").agg((F.sum("worth") / count).alias("equity"))
    ret = F.col("equity") / F.lag("equity").over(W.partitionBy(F.lit(0)).orderBy("t")) - 1
    return days.select("t", F.round(F.coalesce(ret, F.lit(0.0)), 9).alias("ret"), "equity")


def _fallen(curve: DataFrame, *by: str) -> DataFrame:
    peak = F.max("equity").over(W.partitionBy(*(by or (F.lit(0),))).orderBy("t"))
    return curve.withColumn("fall", F.when(peak > 0, 1 - F.col("equity") / peak).otherwise(0.0))


def metrics(curve: DataFrame) -> DataFrame:
    """n_days, drawdown_area, mdd, cagr, calmar, sharpe of a curve of daily equity, by its returns from day to day."""
    order = W.partitionBy(F.lit(0)).orderBy("t")
    rows = _fallen(curve).withColumn("r", F.col("equity") / F.lag("equity").over(order) - 1)
    one = rows.agg(
        F.count("r").alias("n_days"),
        F.sum("fall").alias("drawdown_area"),
        F.max("fall").alias("mdd"),
        (F.pow(F.max_by("equity", "t") / F.min_by("equity", "t"), YEAR / F.count(F.lit(1))) - 1).alias("cagr"),
        (F.avg("r") / F.nullif(F.stddev_pop("r"), F.lit(0.0)) * YEAR**0.5).alias("sharpe"),
    )
    calmar = F.when(F.col("mdd") > 1e-9, F.col("cagr") / F.col("mdd"))
    return one.select("n_days", *[F.round(c, 6).alias(n) for n, c in (("drawdown_area", F.col("drawdown_area")), ("mdd", F.col("mdd")), ("cagr", F.col("cagr")), ("calmar", calmar), ("sharpe", F.col("sharpe")))])


def yearly(curve: DataFrame, least: int = 5) -> DataFrame:
    """year, ret, mdd of each calendar year with enough days."""
    rows = _fallen(curve.withColumn("year", F.year("t")), "year")
    by = rows.groupBy("year").agg((F.max_by("equity", "t") / F.min_by("equity", "t") - 1).alias("ret"), F.max("fall").alias("mdd"), F.count(F.lit(1)).alias("n"))
    return by.where(F.col("n") >= least).select("year", F.round("ret", 6).alias("ret"), F.round("mdd", 6).alias("mdd"))


def derived(curves: DataFrame, compositions: DataFrame, count: int) -> DataFrame:
    """label, part, calmar, cagr, mdd, sharpe of books whose weights are the members' squared Calmar ratios.

    curves: strategy, t, equity; compositions: label, strategy.  All are taken on the days
    that all ``count`` strategies have; parts are all days, and the early and late half.
    """
    days = curves.groupBy("t").agg(F.countDistinct("strategy").alias("n")).where(F.col("n") == count).select("t")
    place = W.partitionBy(F.lit(0)).orderBy("t")
    # a row a day
    days = days.withColumns({"pos": F.row_number().over(place), "n": F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))})
    half = F.when(F.col("pos") <= F.floor(F.col("n") / 2), "early").otherwise("late")
    years = (F.unix_seconds(F.max("t").cast("timestamp")) - F.unix_seconds(F.min("t").cast("timestamp"))) / (365.25 * 86_400)
    per_year = days.agg((F.count(F.lit(1)) / years).alias("ppy"))
    grid = curves.join(days.select("t", half.alias("half")), "t")
    by = W.partitionBy("strategy").orderBy("t")
    moves = grid.withColumns({"r": F.col("equity") / F.lag("equity").over(by) - 1, "before": F.lag("half").over(by)}).where("r IS NOT NULL")
    parts = moves.withColumn("part", F.explode(F.when(F.col("half") == F.col("before"), F.array(F.lit("all"), "half")).otherwise(F.array(F.lit("all")))))

    def judged(rows: DataFrame, *by: str) -> DataFrame:
        order = W.partitionBy(*by).orderBy("t")
        grown = rows.withColumn("eq", F.exp(F.sum(F.log1p("r")).over(order)))
        fallen = grown.withColumn("fall", 1 - F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(order)))
        out = fallen.groupBy(*by).agg(F.max_by("eq", "t").alias("eq"), F.max("fall").alias("mdd"), F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
        out = out.join(per_year).withColumn("cagr", F.pow("eq", F.col("ppy") / F.col("n")) - 1)
        calmar = F.when(F.col("mdd") > 1e-6, F.col("cagr") / F.col("mdd")).otherwise(0.0)
        sharpe = F.when(F.col("sd") > 1e-12, F.col("m") / F.col("sd") * F.sqrt("ppy")).otherwise(0.0)
        return out.select(*by, calmar.alias("calmar"), F.col("cagr"), F.col("mdd"), sharpe.alias("sharpe"))

    own = judged(moves.select("strategy", "t", "r"), "strategy").select("strategy", (F.col("calmar") * F.col("calmar")).alias("weight"))
    members = compositions.join(own, "strategy").withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy("label")))
    mixed = parts.join(members.select("label", "strategy", "share"), "strategy").groupBy("label", "part", "t").agg(F.sum(F.col("share") * F.col("r")).alias("r"))
    found = judged(mixed, "label", "part")
    return found.select("label", "part", *[F.round(c, 6).alias(c) for c in ("calmar", "cagr", "mdd", "sharpe")])


# --- the older scorer, with its overlay ---

#: Fixed values of the overlay: spans, gate, floor, smoothing, dead band.
FAST, SLOW, GATE, FLOOR, SMOOTH, DEAD = 10, 60, 0.80, 0.5, 0.5, 0.05


def overlay(preds: DataFrame) -> DataFrame:
    """Adds g, a factor of the size: below one only when recent moves are wild for their last while.

    At a bar the returns up to the bar before the last are known.
    """

    def known(back: int) -> W:
        return W.partitionBy("key").orderBy("bar_ix").rowsBetween(-back - 1, -2)

    own = W.partitionBy("key").orderBy("bar_ix")
    full = own.rowsBetween(-FAST + 1, 0)
    rows = preds.withColumns({"m": F.row_number().over(own) - 2, "fast": F.stddev_pop("lr").over(known(FAST)), "slow": F.stddev_pop("lr").over(known(SLOW))})
    rows = rows.withColumn("roll", F.when(F.count("lr").over(full) == FAST, F.stddev_pop("lr").over(full)))
    frame = f"(PARTITION BY key ORDER BY bar_ix ROWS BETWEEN {4 * SLOW - FAST + 2} PRECEDING AND 2 PRECEDING)"
    rows = rows.withColumn("gate", F.expr(f"percentile(roll, {GATE}) OVER {frame}"))
    g = F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), 1 + SMOOTH * (F.col("slow") / F.col("fast") - 1)))
    acts = (F.col("m") >= SLOW + 2) & (F.col("fast") > 1e-9) & (F.col("slow") > 1e-9) & (F.col("fast") > F.col("gate")) & (g <= 1 - DEAD)
    return rows.withColumn("g", F.when(acts, g).otherwise(1.0)).drop("m", "fast", "slow", "roll", "gate")


def older_score(preds: DataFrame, thresh: float, cost: float = 5e-4, wild: bool = False) -> DataFrame:
    """calmar, trades, total, mdd, annual, drawdown_area of each key; wild: with the overlay."""
    z = f"((least(greatest(p, 1e-6), 1 - 1e-6) - {thresh!r}) / sqrt(least(greatest(p, 1e-6), 1 - 1e-6) * (1 - least(greatest(p, 1e-6), 1 - 1e-6))))"
    bet = F.expr(f"CASE WHEN p > {thresh!r} THEN least(1.0, greatest(0.0, 2 * {phi(z)} - 1)) ELSE 0.0 END")
    own = W.partitionBy("key").orderBy("bar_ix")
    rows = (overlay(preds) if wild else preds.withColumn("g", F.lit(1.0))).withColumns({"w": bet * F.col("g"), "nx": F.lead("lr").over(own)}).where("nx IS NOT NULL")
    rows = rows.withColumn("last", F.lag("w", 1, 0.0).over(own)).withColumn("first", F.row_number().over(own) == 1)
    change = F.abs(F.col("w") - F.col("last"))
    traded = (F.col("last") == 0) & (F.col("w") > 0) | (F.col("last") > 0) & (F.col("w") == 0) | (change > 0.01)
    rows = rows.withColumns({"traded": traded.cast("int"), "r": F.col("w") * F.col("nx") - F.when(~F.col("first") & (change > 0.01), cost * change).otherwise(0.0)})
    rows = rows.withColumn("cum", F.sum("r").over(own)).withColumn("dd", F.col("cum") - F.max("cum").over(own))
    one = rows.groupBy("key").agg(F.sum("traded").alias("trades"), F.sum("r").alias("total"), (F.abs(F.min("dd")) + 1e-9).alias("mdd"), (F.avg("r") * 880).alias("annual"), F.sum(1 - F.exp("dd")).alias("drawdown_area"), F.count(F.lit(1)).alias("n"))
    some = (F.col("trades") >= 2) & (F.col("n") >= 2)
    calmar = F.when(F.col("mdd") > 0.001, F.col("annual") / F.col("mdd")).otherwise(0.0)
    values = {"calmar": calmar, **{c: F.col(c) for c in ("total", "mdd", "annual", "drawdown_area")}}
    return one.select("key", "trades", *[F.round(F.when(some, c).otherwise(0.0), 6).alias(n) for n, c in values.items()])


# --- SQL for the checking engine, by hand ---


def replay_check(preds: str, sizes: str, champions: str) -> str:
    return f"""
WITH RECURSIVE c AS (SELECT key, greatest(weight, 0.0) / (SELECT sum(greatest(weight, 0.0)) FROM {champions}) AS share FROM {champions}),
i AS MATERIALIZED (SELECT key, bar_ix, round(CAST(w AS DOUBLE) * share, 9) AS w FROM ({sizes}) JOIN c USING (key)),
f AS (
  SELECT key, CAST(-1 AS BIGINT) AS bar_ix, CAST(0 AS DOUBLE) AS held FROM c
  UNION ALL SELECT i.key, i.bar_ix, CASE WHEN abs(i.w - f.held) > 0.005 THEN CASE WHEN abs(i.w) < 0.003 THEN 0.0 ELSE i.w END ELSE f.held END FROM f JOIN i ON i.key = f.key AND i.bar_ix = f.bar_ix + 1
),
e AS (SELECT b.ts AS t, sum(coalesce(f.held, 0.0) * coalesce(exp(b.lc) / exp(a.lc) - 1, 0.0)) AS ret FROM {preds} b JOIN c ON c.key = b.key LEFT JOIN {preds} a ON a.key = b.key AND a.bar_ix = b.bar_ix - 1 LEFT JOIN f ON f.key = b.key AND f.bar_ix = b.bar_ix - 1 GROUP BY b.ts)
SELECT t, round(ret, 9) AS ret, exp(sum(ln(1 + ret)) OVER (ORDER BY t)) AS equity FROM e"""


def hold_check(bars: str, count: int) -> str:
    return f"""
WITH c AS (SELECT key, ts AS t, exp(lc) AS close FROM {bars}), d AS (SELECT t FROM c GROUP BY t HAVING count(DISTINCT key) = {count}),
w AS (SELECT t, close / arg_min(close, t) OVER (PARTITION BY key) AS worth FROM c JOIN d USING (t)),
e AS (SELECT t, avg(worth) AS equity FROM w GROUP BY t)
SELECT t, round(coalesce(equity / lag(equity) OVER (ORDER BY t) - 1, 0.0), 9) AS ret, equity FROM e"""


def metrics_check(curve: str) -> str:
    return f"""
WITH e AS (SELECT t, equity, equity / lag(equity) OVER (ORDER BY t) - 1 AS r, 1 - equity / max(equity) OVER (ORDER BY t) AS fall FROM ({curve})),
o AS (SELECT count(r) AS n_days, sum(fall) AS area, max(fall) AS mdd, power(arg_max(equity, t) / arg_min(equity, t), 252.0 / count(*)) - 1 AS cagr, avg(r) / stddev_pop(r) * sqrt(252.0) AS sharpe FROM e)
SELECT n_days, round(area, 6) AS drawdown_area, round(mdd, 6) AS mdd, round(cagr, 6) AS cagr, round(CASE WHEN mdd > 1e-9 THEN cagr / mdd END, 6) AS calmar, round(sharpe, 6) AS sharpe FROM o"""


def yearly_check(curve: str) -> str:
    return f"""
WITH e AS (SELECT year(t) AS year, t, equity, 1 - equity / max(equity) OVER (PARTITION BY year(t) ORDER BY t) AS fall FROM ({curve}))
SELECT CAST(year AS INT) AS year, round(arg_max(equity, t) / arg_min(equity, t) - 1, 6) AS ret, round(max(fall), 6) AS mdd FROM e GROUP BY year HAVING count(*) >= 5"""


def derived_check(curves: str, compositions: str, count: int) -> str:
    judged = """SELECT {by}, CASE WHEN mdd > 1e-6 THEN cagr / mdd ELSE 0.0 END AS calmar, cagr, mdd, CASE WHEN sd > 1e-12 THEN m / sd * sqrt(ppy) ELSE 0.0 END AS sharpe FROM (
    SELECT {by}, max(fall) AS mdd, avg(r) AS m, stddev_samp(r) AS sd, power(arg_max(eq, t), any_value(ppy) / count(*)) - 1 AS cagr, any_value(ppy) AS ppy FROM (
      SELECT *, 1 - eq / greatest(1.0, max(eq) OVER (PARTITION BY {by} ORDER BY t)) AS fall FROM (SELECT *, product(1 + r) OVER (PARTITION BY {by} ORDER BY t) AS eq FROM {rows}), y) GROUP BY {by})"""
    return f"""
WITH d AS (SELECT t, row_number() OVER (ORDER BY t) AS pos, count(*) OVER () AS n FROM {curves} GROUP BY t HAVING count(DISTINCT strategy) = {count}),
y AS (SELECT count(*) / ((epoch(max(t)) - epoch(min(t))) / (365.25 * 86400)) AS ppy FROM d),
g AS (SELECT c.strategy, t, c.equity / lag(c.equity) OVER w - 1 AS r, pos <= n // 2 AS early, lag(pos <= n // 2) OVER w AS before FROM {curves} c JOIN d USING (t) WINDOW w AS (PARTITION BY c.strategy ORDER BY t)),
m AS (SELECT * FROM g WHERE r IS NOT NULL),
own AS ({judged.format(by='strategy', rows='m')}),
s AS (SELECT label, strategy, calmar * calmar / sum(calmar * calmar) OVER (PARTITION BY label) AS share FROM {compositions} JOIN own USING (strategy)),
p AS (SELECT label, 'all' AS part, t, sum(share * r) AS r FROM m JOIN s USING (strategy) GROUP BY label, t UNION ALL SELECT label, CASE WHEN early THEN 'early' ELSE 'late' END, t, sum(share * r) FROM m JOIN s USING (strategy) WHERE early = before GROUP BY label, t, early)
SELECT label, part, round(calmar, 6) AS calmar, round(cagr, 6) AS cagr, round(mdd, 6) AS mdd, round(sharpe, 6) AS sharpe FROM ({judged.format(by='label, part', rows='p')})"""


def older_score_check(preds: str, thresh: float, cost: float = 5e-4, wild: bool = False) -> str:
    z = f"((q - {thresh!r}) / sqrt(q * (1 - q)))"
    g = "1.0"
    if wild:
        raw = f"least(1.0, greatest({FLOOR}, 1 + {SMOOTH} * (slow / fast - 1)))"
        g = f"CASE WHEN k - 2 >= {SLOW + 2} AND fast > 1e-9 AND slow > 1e-9 AND fast > (SELECT quantile_cont(v, {GATE}) FROM unnest(look) u(v)) AND {raw} <= {1 - DEAD} THEN {raw} ELSE 1.0 END"
    return f"""
WITH a AS (SELECT key, bar_ix, p, lr, lead(lr) OVER o AS nx, row_number() OVER o AS k, least(greatest(p, 1e-6), 1 - 1e-6) AS q, stddev_pop(lr) OVER (o ROWS BETWEEN {FAST + 1} PRECEDING AND 2 PRECEDING) AS fast, stddev_pop(lr) OVER (o ROWS BETWEEN {SLOW + 1} PRECEDING AND 2 PRECEDING) AS slow,
  CASE WHEN count(lr) OVER (o ROWS BETWEEN {FAST - 1} PRECEDING AND CURRENT ROW) = {FAST} THEN stddev_pop(lr) OVER (o ROWS BETWEEN {FAST - 1} PRECEDING AND CURRENT ROW) END AS roll FROM {preds} WINDOW o AS (PARTITION BY key ORDER BY bar_ix)),
b AS (SELECT *, list(roll) OVER (PARTITION BY key ORDER BY bar_ix ROWS BETWEEN {4 * SLOW - FAST + 2} PRECEDING AND 2 PRECEDING) AS look FROM a),
w AS (SELECT key, bar_ix, k, nx, CASE WHEN p > {thresh!r} THEN least(1.0, greatest(0.0, 2 * {phi(z)} - 1)) ELSE 0.0 END * {g} AS w FROM b WHERE nx IS NOT NULL),
t AS (SELECT *, lag(w, 1, 0.0) OVER (PARTITION BY key ORDER BY bar_ix) AS last FROM w),
r AS (SELECT *, CASE WHEN last = 0 AND w > 0 OR last > 0 AND w = 0 OR abs(w - last) > 0.01 THEN 1 ELSE 0 END AS traded, w * nx - CASE WHEN k > 1 AND abs(w - last) > 0.01 THEN {cost} * abs(w - last) ELSE 0.0 END AS r FROM t),
c AS (SELECT *, sum(r) OVER (PARTITION BY key ORDER BY bar_ix) AS cum FROM r),
d AS (SELECT *, cum - max(cum) OVER (PARTITION BY key ORDER BY bar_ix) AS dd FROM c),
e AS (SELECT key, CAST(sum(traded) AS BIGINT) AS trades, sum(r) AS total, abs(min(dd)) + 1e-9 AS mdd, avg(r) * 880 AS annual, sum(1 - exp(dd)) AS area, count(*) AS n FROM d GROUP BY key)
SELECT key, trades, {', '.join(f'round(CASE WHEN trades >= 2 AND n >= 2 THEN {c} ELSE 0.0 END, 6) AS {x}' for x, c in (('calmar', 'CASE WHEN mdd > 0.001 THEN annual / mdd ELSE 0.0 END'), ('total', 'total'), ('mdd', 'mdd'), ('annual', 'annual'), ('drawdown_area', 'area')))} FROM e"""
