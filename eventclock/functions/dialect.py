"""Expression text that Spark SQL evaluates, and its rendering for a checking engine.

Three forms differ between engines and are written as ``ffill{x} over (...)`` (last value
that is not null), ``pct{x|q}`` (exact interpolated percentile) and ``dow{t}`` (days since
Monday).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARK, DUCK = "spark", "duckdb"


def render(text: str, dialect: str = SPARK) -> str:
    fill = r"last_value(\1) ignore nulls" if dialect == SPARK else r"last_value(\1 ignore nulls)"
    pct = r"percentile(\1, \2)" if dialect == SPARK else r"quantile_cont(\1, \2)"
    text = re.sub(r"pct\{([^{}|]*)\|([^{}|]*)\}", pct, text)
    text = re.sub(r"dow\{([^{}]*)\}", r"weekday(\1)" if dialect == SPARK else r"(isodow(\1) - 1)", text)
    return re.sub(r"ffill\{([^{}]*)\}", fill, text)


def phi(x: str) -> str:
    """Standard normal distribution function, by a rational approximation of the error function.

    Absolute error below 1.5e-7 (Abramowitz and Stegun 7.1.26).
    """
    # fixed values of the approximation
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    z = f"(abs({x}) / {math.sqrt(2)!r})"
    t = f"(1 / (1 + {p} * {z}))"
    erf = f"(1 - ((((({a5} * {t} + ({a4})) * {t}) + {a3}) * {t} + ({a2})) * {t} + {a1}) * {t} * exp(-{z} * {z}))"
    return f"(0.5 * (1 + CASE WHEN ({x}) >= 0 THEN {erf} ELSE -{erf} END))"


def steps(df: DataFrame, *columns: dict[str, str]) -> DataFrame:
    """Adds columns step by step; a step can use those of the steps before."""
    for step in columns:
        df = df.withColumns({name: F.expr(render(text)) for name, text in step.items()})
    return df


def steps_sql(source: str, *columns: dict[str, str]) -> str:
    """The same as nested SQL for the checking engine."""
    for step in columns:
        cols = ", ".join(f"{render(text, DUCK)} AS {name}" for name, text in step.items())
        source = f"(SELECT *, {cols} FROM {source})"
    return source


def frame(preceding: int, following: int = 0, by: str = "key", order: str = "ts, seq") -> str:
    """A row frame from ``preceding`` rows back to ``following`` rows on; negative turns the side."""

    def bound(n: int, side: str, other: str) -> str:
        return "CURRENT ROW" if n == 0 else f"{n} {side}" if n > 0 else f"{-n} {other}"

    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {bound(preceding, 'PRECEDING', 'FOLLOWING')} AND {bound(following, 'FOLLOWING', 'PRECEDING')})"


def full(aggregate: str, column: str, size: int, window: str) -> str:
    """An aggregate over a frame, null until the frame holds ``size`` values."""
    return f"CASE WHEN count({column}) OVER {window} = {size} THEN {aggregate} OVER {window} END"


def phi_inv(p: str) -> str:
    """Quantile of the standard normal distribution, by Acklam's rational approximation (relative error below 1.2e-9)."""
    # fixed values of the approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(values: tuple[float, ...], x: str) -> str:
        text = repr(values[0])
        for v in values[1:]:
            text = f"({text} * {x} + ({v!r}))"
        return text

    r, low, high = f"(({p}) - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    rr = f"({r} * {r})"
    tail = lambda q: f"{horner(c, q)} / ({horner(d, q)} * {q} + 1)"
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < 0.02425 THEN {tail(low)} WHEN ({p}) > 0.97575 THEN -({tail(high)}) ELSE {horner(a, rr)} * {r} / ({horner(b, rr)} * {rr} + 1) END)"
