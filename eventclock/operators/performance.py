"""Back-test and performance metrics over equity curves and sized positions.

Curves: strategy, t (order), equity or ret.  All are windows and aggregates by strategy.
The e-process is a product of bets set by earlier returns, so it is a window too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.functions.dialect import DUCK, render, steps, steps_sql

S = "(PARTITION BY strategy ORDER BY t)"
PAST = "(PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UNDERWATER = (
    {"peak": f"max(equity) OVER {S}"},
    {"dd": "CASE WHEN peak <> 0 THEN equity / peak - 1 ELSE 0.0 END", "dry": "CASE WHEN equity >= peak THEN 1 ELSE 0 END"},
    {"spell": f"sum(dry) OVER {S}"},
    {"wet": "sum(1 - dry) OVER (PARTITION BY strategy, spell ORDER BY t)", "n": "count(equity) OVER (PARTITION BY strategy)", "first": f"first_value(equity) OVER {S}"},
)
DRAWDOWN = {
    "max_drawdown": "-min(dd)",
    "pain_index": "-avg(dd)",
    "ulcer_index": "sqrt(avg(dd * dd))",
    "drawdown_area": "-sum(dd)",
    "max_dd_duration": "max(wet)",
    "martin_ratio": "CASE WHEN count(equity) < 2 OR min(first) <= 0 THEN 0.0 WHEN sqrt(avg(dd * dd)) <= 0 THEN CAST('Infinity' AS DOUBLE) "
    "ELSE (power(max(CASE WHEN pos = n THEN equity END) / min(first), 252.0 / (count(equity) - 1)) - 1) / sqrt(avg(dd * dd)) END",
}
_at = {"pos": f"row_number() OVER {S}"}

RATIOS = {
    "n_days": "count(ret)",
    "sharpe": "avg(ret) / nullif(stddev_samp(ret), 0.0) * sqrt(252.0)",
    "skew": "avg(z * z * z)",
    "kurt": "avg(z * z * z * z)",
    "sharpe_early": "avg(CASE WHEN pos <= n / 2 THEN ret END) / nullif(stddev_samp(CASE WHEN pos <= n / 2 THEN ret END), 0.0) * sqrt(252.0)",
    "sharpe_late": "avg(CASE WHEN pos > n / 2 THEN ret END) / nullif(stddev_samp(CASE WHEN pos > n / 2 THEN ret END), 0.0) * sqrt(252.0)",
}
_moments = (_at | {"n": "CAST(count(ret) OVER (PARTITION BY strategy) AS DOUBLE)", "mu": "avg(ret) OVER (PARTITION BY strategy)", "sd": "stddev_samp(ret) OVER (PARTITION BY strategy)"}, {"z": "(ret - mu) / nullif(sd, 0.0)"})

BETTING = (
    {"r": "greatest(-0.18, ret)", "seen": f"count(ret) OVER {PAST}"},
    {"m1": f"avg(r) OVER {PAST}", "m2": f"avg(r * r) OVER {PAST}"},
    {"bet": "CASE WHEN seen >= 5 THEN least(5.0, greatest(0.0, m1 / greatest(1e-9, m2 - m1 * m1))) ELSE 0.0 END"},
    {"wealth": f"exp(sum(ln(greatest(1e-12, 1 + bet * r))) OVER {S})"},
)

CHANGE = (
    {"n": "count(ret) OVER (PARTITION BY strategy)", "mu": "avg(ret) OVER (PARTITION BY strategy)", "sd": "stddev_samp(ret) OVER (PARTITION BY strategy)", "pos": f"row_number() OVER {S} - 1"},
    {"c": f"sum(ret - mu) OVER {S}"},
    # the sum held below zero is the running sum less its highest value so far, or zero
    {"low": f"c - greatest(0.0, max(c) OVER {S})"},
)


def _grouped(curves: DataFrame, parts: tuple[dict[str, str], ...], out: dict[str, str]) -> DataFrame:
    rows = steps(curves, *parts)
    return rows.groupBy("strategy").agg(*[F.expr(render(x)).cast("double").alias(k) for k, x in out.items()]).select("strategy", *[(F.round(k, 6) + F.lit(0.0)).alias(k) for k in out])


def _grouped_sql(source: str, parts: tuple[dict[str, str], ...], out: dict[str, str]) -> str:
    return f"SELECT strategy, {', '.join(f'round(CAST({render(x, DUCK)} AS DOUBLE), 6) + 0.0 AS {k}' for k, x in out.items())} FROM {steps_sql(source, *parts)} GROUP BY strategy"


AGGREGATES: dict[str, tuple[tuple[dict[str, str], ...], dict[str, str]]] = {
    "drawdown": ((*UNDERWATER[:-1], UNDERWATER[-1] | _at), DRAWDOWN),
    "ratios": (_moments, RATIOS),
    "decay": (
        _moments,
        {
            "early": RATIOS["sharpe_early"],
            "late": RATIOS["sharpe_late"],
            "stale": f"CASE WHEN ({RATIOS['sharpe_early']}) > 0 AND (({RATIOS['sharpe_late']}) <= 0 OR ({RATIOS['sharpe_late']}) < 0.4 * ({RATIOS['sharpe_early']})) THEN 1 ELSE 0 END",
        },
    ),
    "evalue": (BETTING, {"e_value": "max_by(wealth, t)", "highest": "max(wealth)", "first_over_20": "min(CASE WHEN wealth >= 20 THEN seen + 1 END)"}),
    "cusum": (CHANGE, {"change_at": "min(CASE WHEN n >= 8 AND low <= -4 * sd THEN pos END)"}),
    "page_hinkley": (CHANGE, {"change_at": "min(CASE WHEN n >= 8 AND sd > 0 AND low <= -4 * sd THEN pos END)"}),
    "regime_split": (
        (
            {"rms": "sqrt(avg(ret * ret) OVER (PARTITION BY strategy ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))", "k": f"row_number() OVER {S}"},
            {"med": f"pct{{CASE WHEN k >= 20 THEN rms END|0.5}} OVER (PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
            {"wild": "CASE WHEN k >= 20 THEN CASE WHEN rms > med THEN 1 ELSE 0 END END"},
        ),
        {
            "share_wild": "avg(wild)",
            "sharpe_calm": "avg(CASE WHEN wild = 0 THEN ret END) / nullif(stddev_samp(CASE WHEN wild = 0 THEN ret END), 0.0) * sqrt(252.0)",
            "sharpe_wild": "avg(CASE WHEN wild = 1 THEN ret END) / nullif(stddev_samp(CASE WHEN wild = 1 THEN ret END), 0.0) * sqrt(252.0)",
        },
    ),
    "deflation_inputs": (_moments, {"sr": "avg(ret) / nullif(stddev_samp(ret), 0.0)", "n": "count(ret)", "skew": "avg(z * z * z)", "kurt": "avg(z * z * z * z)"}),
}


def metric(curves: DataFrame, name: str) -> DataFrame:
    return _grouped(curves, *AGGREGATES[name])


def metric_check(source: str, name: str) -> str:
    text = _grouped_sql(source, *AGGREGATES[name])
    return text.replace("max_by(", "arg_max(")


def underwater(curves: DataFrame) -> DataFrame:
    """strategy, t, dd: share below the highest equity so far."""
    return steps(curves, *UNDERWATER[:2]).select("strategy", "t", (F.round("dd", 9) + F.lit(0.0)).alias("dd"))


def underwater_check(source: str) -> str:
    return f"SELECT strategy, t, round(dd, 9) + 0.0 AS dd FROM {steps_sql(source, *UNDERWATER[:2])}"


#: Sized positions: key, bar_ix, w, lr -> returns after costs of every change beyond the band.
SCORED = (
    {"nx": "lead(lr) OVER (PARTITION BY key ORDER BY bar_ix)", "pw": "lag(w, 1, 0.0) OVER (PARTITION BY key ORDER BY bar_ix)"},
    {"ret": "w * nx - CASE WHEN bar_ix > 0 AND abs(w - pw) > {band} THEN {cost} * abs(w - pw) ELSE 0.0 END", "trade": "CASE WHEN nx IS NOT NULL AND abs(w - pw) > {band} THEN 1 ELSE 0 END"},
    {"cum": "sum(ret) OVER (PARTITION BY key ORDER BY bar_ix)"},
    {"dd": "cum - max(cum) OVER (PARTITION BY key ORDER BY bar_ix)"},
)
SCORE = {
    "trades": "sum(trade)",
    "total": "sum(ret)",
    "mdd": "greatest(1e-9, 1 - exp(min(dd)))",
    "cagr": "exp(sum(ret) * 880.0 / count(ret)) - 1",
    "drawdown_area": "sum(1 - exp(dd))",
    "calmar": "CASE WHEN 1 - exp(min(dd)) > 0.001 AND sum(trade) >= 2 THEN (exp(sum(ret) * 880.0 / count(ret)) - 1) / (1 - exp(min(dd))) ELSE 0.0 END",
}


def _scored(cost: float, band: float) -> tuple[dict[str, str], ...]:
    return tuple({k: v.replace("{cost}", repr(cost)).replace("{band}", repr(band)) for k, v in s.items()} for s in SCORED)


def score(sized: DataFrame, cost: float = 5e-4, band: float = 0.01) -> DataFrame:
    """One row per key: what the position earns on the next bar, after costs."""
    rows = steps(sized, *_scored(cost, band)).where("nx IS NOT NULL")
    return rows.groupBy("key").agg(*[F.expr(x).cast("double").alias(k) for k, x in SCORE.items()]).select("key", *[(F.round(k, 6) + F.lit(0.0)).alias(k) for k in SCORE])


def score_check(sized: str, cost: float = 5e-4, band: float = 0.01) -> str:
    return f"SELECT key, {', '.join(f'round(CAST({x} AS DOUBLE), 6) + 0.0 AS {k}' for k, x in SCORE.items())} FROM {steps_sql(f'({sized})', *_scored(cost, band))} WHERE nx IS NOT NULL GROUP BY key"


def cost_stress(sized: DataFrame, costs: tuple[float, ...] = (5e-4, 1e-3, 1.5e-3)) -> DataFrame:
    """The score at several costs; the curves are read once."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [score(sized, c).withColumn("cost", F.lit(c)) for c in costs])


def cost_stress_check(sized: str, costs: tuple[float, ...] = (5e-4, 1e-3, 1.5e-3)) -> str:
    return " UNION ALL ".join(f"SELECT *, CAST({c!r} AS DOUBLE) AS cost FROM ({score_check(sized, c)})" for c in costs)
