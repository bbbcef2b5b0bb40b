"""Causal features of bars, in blocks of window expressions.

Input: key, bar_ix, ts, seq, lc (log close), lr (log return).  Each block is steps of
named expressions and the columns it gives.  A statistic over a window is null until
the window is full; a price above a moving average that is still null counts as below.
All blocks window by key and order, so one exchange and sort serves all of them.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.functions.dialect import frame, full, steps, steps_sql

O = "(PARTITION BY key ORDER BY ts, seq)"


@dataclass(frozen=True)
class Block:
    steps: tuple[dict[str, str], ...]
    columns: tuple[str, ...]


def back(n: int) -> str:
    return frame(n - 1)


def _block(*parts: dict[str, str]) -> Block:
    return Block(parts, tuple(parts[-1]))


def _z(x: str, n: int, kind: str = "stddev_samp") -> str:
    """Distance from the window's mean in its deviations; the rounding makes it zero in a window without spread."""
    return f"round({x} - ({full(f'avg({x})', x, n, back(n))}), 12) / (({full(f'{kind}({x})', x, n, back(n))}) + 1e-12)"


def _kurtosis(x: str, n: int, engine: str = "") -> str:
    """Bias-corrected excess kurtosis from power sums about the window's mean, which differ less between engines."""
    w = back(n)
    m = f"avg({x}) OVER {w}"
    s2, s3, s4 = (f"avg({' * '.join([x] * k)}) OVER {w}" for k in (2, 3, 4))
    central2 = f"(({s2}) - ({m}) * ({m}))"
    central4 = f"(({s4}) - 4 * ({m}) * ({s3}) + 6 * ({m}) * ({m}) * ({s2}) - 3 * ({m}) * ({m}) * ({m}) * ({m}))"
    g2 = f"({central4} / nullif({central2} * {central2}, 0.0) - 3)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {(n - 1) / ((n - 2) * (n - 3))!r} * ({n + 1} * {g2} + 6) END"


def _returns(x: str, k: int) -> str:
    return f"{x} - lag({x}, {k}) OVER {O}"


def _variance_ratio() -> Block:
    moves = {f"m{k}": _returns("lc", k) for k in (1, 5, 10, 20, 40)}
    out = {}
    for w in (200, 400):
        for k in (5, 10, 20, 40):
            out[f"vr_{w}_{k}"] = f"({full(f'var_samp(m{k})', f'm{k}', w, back(w))}) / ({k} * ({full('var_samp(m1)', 'm1', w, back(w))}) + 1e-12) - 1"
    return _block(moves, out)


def _drawdown_state() -> Block:
    hi, lo = f"max(lc) OVER {frame(100, -1)}", f"min(lc) OVER {frame(100, -1)}"
    return _block(
        {"peak": f"max(lc) OVER {O}", "up": "CASE WHEN lr > 0 THEN 1 WHEN lr < 0 THEN -1 ELSE 0 END", "sd100": full("stddev_samp(lr)", "lr", 100, back(100)), "ma50": full("avg(lc)", "lc", 50, back(50))},
        {"at_peak": f"max(CASE WHEN lc >= peak THEN bar_ix END) OVER {O}", "turn": f"CASE WHEN up = lag(up) OVER {O} THEN 0 ELSE 1 END", "side": "CASE WHEN lc > ma50 THEN 1 ELSE 0 END"},
        {"island": f"sum(turn) OVER {O}", "flip": f"CASE WHEN side = lag(side) OVER {O} THEN 0 ELSE 1 END"},
        {"flips": f"sum(flip) OVER {O}", "run": "row_number() OVER (PARTITION BY key, island ORDER BY ts, seq)"},
        {
            "dd_depth": "peak - lc",
            "dd_age": "ln(1.0 + bar_ix - at_peak)",
            "dd_slope": f"(lc - lag(lc, 10) OVER {O}) / 10",
            "dd_norm": "(peak - lc) / (sd100 * sqrt(1.0 + bar_ix - at_peak) + 1e-12)",
            "dd_run": "greatest(-30, least(30, up * run)) / 30.0",
            "dd_trend_age": "ln(1.0 + row_number() OVER (PARTITION BY key, flips ORDER BY ts, seq))",
            "dd_to_high": f"CASE WHEN count(lc) OVER {frame(100, -1)} = 100 THEN lc - {hi} END",
            "dd_to_low": f"CASE WHEN count(lc) OVER {frame(100, -1)} = 100 THEN lc - {lo} END",
        },
    )


def _level(x: str, prefix: str) -> Block:
    return _block({f"{prefix}_level": x, f"{prefix}_z60": _z(x, 60), f"{prefix}_z252": _z(x, 252), **{f"{prefix}_d{k}": _returns(x, k) for k in (5, 20, 60)}})


def _binomial(order: int, stride: int, x: str) -> str:
    """Difference of an order, over a stride of bars."""
    terms = [f"{(-1) ** j * math.comb(order, j)} * " + (x if j == 0 else f"lag({x}, {j * stride}) OVER {O}") for j in range(order + 1)]
    return " + ".join(f"({t})" for t in terms)


_turn = 2 * math.pi
BLOCKS: dict[str, Block] = {
    "momentum": _block({f"mom_{k}": _returns("lc", k) for k in range(1, 21)}),
    "zmomentum": _block({f"mom_{k}": _returns("lc", k) for k in range(1, 21)}, {f"zmom_{k}": _z(f"mom_{k}", 100) for k in range(1, 21)}),
    "rolling": _block({f"{n}_{w}": full(f"{f}(lr)", "lr", w, back(w)) for w in (5, 10, 20, 50, 100, 200, 400, 800) for n, f in (("std", "stddev_samp"), ("mean", "avg"))}),
    "kurtosis": _block({"alr": "abs(lr)"}, {f"kurt_{x}_{w}": _kurtosis(x, w) for w in (50, 100, 200, 400) for x in ("lr", "alr")}),
    "vol_ratio": _block({f"vol_ratio_{w}": f"({full('stddev_samp(lr)', 'lr', w, back(w))}) / (({full('stddev_samp(lr)', 'lr', 200, back(200))}) + 1e-9)" for w in (5, 10, 20, 50)}),
    "above_ma": _block({f"above_{w}": f"CASE WHEN coalesce(lc > ({full('avg(lc)', 'lc', w, back(w))}), false) THEN 1.0 ELSE 0.0 END" for w in (25, 50, 100, 200)}),
    "rsi": _block({"gain": "greatest(lr, 0.0)", "loss": "greatest(-lr, 0.0)"}, {f"rsi_{w}": f"0.5 - 1 / (1 + ({full('avg(gain)', 'gain', w, back(w))}) / (({full('avg(loss)', 'loss', w, back(w))}) + 1e-12))" for w in (14, 30, 60)}),
    "bollinger": _block({f"band_{w}": f"(lc - ({full('avg(lc)', 'lc', w, back(w))})) / (2 * ({full('stddev_samp(lc)', 'lc', w, back(w))}) + 1e-12)" for w in (20, 50)}),
    "variance_ratio": _variance_ratio(),
    "calendar": _block(
        {"dow": "CAST(dow{ts} AS DOUBLE)", "dom": "CAST(day(ts) AS DOUBLE)", "mon": "CAST(month(ts) AS DOUBLE)", "eom": "CAST(day(last_day(ts)) AS DOUBLE)"},
        {
            "cal_dow_sin": f"sin({_turn!r} * dow / 7)", "cal_dow_cos": f"cos({_turn!r} * dow / 7)", "cal_dom_sin": f"sin({_turn!r} * dom / 31)", "cal_dom_cos": f"cos({_turn!r} * dom / 31)",
            "cal_mon_sin": f"sin({_turn!r} * mon / 12)", "cal_mon_cos": f"cos({_turn!r} * mon / 12)", "cal_turn": "CASE WHEN dom <= 3 OR eom - dom <= 2 THEN 1.0 ELSE 0.0 END", "cal_to_eom": "(eom - dom) / 31",
        },
    ),
    "ddstate": _drawdown_state(),
    "panel": _block(
        {"mom20": _returns("lc", 20), "mom5": _returns("lc", 5)},
        {
            "p_mom20": "mom20", "p_vol50": full("stddev_samp(lr)", "lr", 50, back(50)), "p_vol_ratio": f"({full('stddev_samp(lr)', 'lr', 10, back(10))}) / (({full('stddev_samp(lr)', 'lr', 100, back(100))}) + 1e-9)",
            "p_zmom": _z("mom20", 100), "p_ma": f"lc - ({full('avg(lc)', 'lc', 50, back(50))})", "p_abs5": "abs(mom5)",
        },
    ),
    "tail": _block(
        {f"q{w}": f"CASE WHEN count(lr) OVER {back(w)} = {w} THEN pct{{abs(lr)|0.9}} OVER {back(w)} END" for w in (100, 200)},
        {f"tail_{w}": f"CASE WHEN abs(lr) > q{w} THEN abs(lr) - q{w} WHEN q{w} IS NOT NULL THEN 0.0 END" for w in (100, 200)},
    ),
    "differences": _block({"alc": f"sum(abs(lr)) OVER {O}"}, {f"diff_{n}_{o}_{s}": _binomial(o, s, x) for x, n in (("lc", "p"), ("alc", "v")) for o in range(1, 6) for s in range(1, 17)}),
    "rate_level": _level("lc", "ry"),
    "implied_vol": _block(
        {"iv": full("stddev_samp(lr)", "lr", 20, back(20))},
        {"iv_z60": _z("iv", 60, "stddev_pop"), "iv_z252": _z("iv", 252, "stddev_pop"), **{f"iv_d{k}": _returns("iv", k) for k in (1, 5, 20)}, "iv_rank": f"CASE WHEN count(iv) OVER {back(252)} = 252 THEN (iv - min(iv) OVER {back(252)}) / ((max(iv) OVER {back(252)}) - (min(iv) OVER {back(252)}) + 1e-12) - 0.5 END", "vrp": f"iv - abs(lr)"},
    ),
}

#: Blocks that also read ``drv`` (log level of an outside series, as of the bar) and ``slp``.
_roll = lambda x, n: f"sum(coalesce({x}, 0.0)) OVER {back(n)}"
DRIVEN: dict[str, Block] = {
    "termstruct": _block(
        {"ratio": "lc - drv", "dm": f"drv - lag(drv) OVER {O}"},
        {
            "ts_ratio": "ratio", **{f"ts_z{w}": _z("ratio", w) for w in (20, 60, 200)}, **{f"ts_d{k}": _returns("ratio", k) for k in (10, 40)},
            **{f"ts_mom{k}": _returns("drv", k) for k in (1, 5, 20)}, **{f"ts_vol{w}": full("stddev_samp(dm)", "dm", w, back(w)) for w in (20, 60)}, **{f"ts_drv_z{w}": _z("drv", w) for w in (60, 200)},
        },
    ),
    "realyield": _block(
        {"ry_level": "drv", **{f"ry_z{w}": _z("drv", w) for w in (60, 252)}, **{f"ry_d{k}": _returns("drv", k) for k in (5, 20, 60)}, "ry_slope": "slp", "ry_slope_z252": _z("slp", 252), "ry_slope_d20": _returns("slp", 20)},
    ),
    "oilbasis": _block(
        {"gap": f"drv - lag(drv) OVER {O} - lr"},
        {
            **{f"ob_roll{w}": f"CASE WHEN row_number() OVER {O} >= {w} THEN {_roll('gap', w)} END" for w in (20, 60, 120)}, **{f"ob_mom{k}": _returns("drv", k) for k in (5, 20)},
            **{f"ob_z{w}": f"CASE WHEN count(drv) OVER {frame(w, -1)} = {w} THEN round(drv - avg(drv) OVER {frame(w, -1)}, 12) / (stddev_samp(drv) OVER {frame(w, -1)} + 1e-12) END" for w in (60, 252)},
        },
    ),
}


def build(bars: DataFrame, name: str) -> DataFrame:
    """key, bar_ix and the columns of the named block."""
    block = (BLOCKS | DRIVEN)[name]
    return steps(bars, *block.steps).select("key", "bar_ix", *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in block.columns])


def check(source: str, name: str) -> str:
    block = (BLOCKS | DRIVEN)[name]
    return f"SELECT key, bar_ix, {', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in block.columns)} FROM {steps_sql(source, *block.steps)}"


# --- kernels: statistics of the content of a window that no aggregate gives ---


def sample_entropy(x: np.ndarray, tolerance: float, depth: int = 2) -> float:
    """-ln of the share of matching runs of ``depth`` that also match one value on."""
    n = len(x) - depth
    if n < 2:
        return math.nan
    limit = tolerance * (x.std() + 1e-12)
    near = np.abs(x[:, None] - x[None]) <= limit
    runs = near[:n, :n].copy()
    for k in range(1, depth):
        runs &= near[k : n + k, k : n + k]
    longer = runs & near[depth : n + depth, depth : n + depth]
    a, b = longer.sum() - n, runs.sum() - n
    return -math.log(a / b) if a > 0 and b > 0 else math.nan


def dispersion_entropy(x: np.ndarray, classes: int = 6) -> float:
    """Entropy of pairs of neighbouring classes under the normal distribution, as a share of its most."""
    z = (x - x.mean()) / (x.std() + 1e-12)
    u = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    c = np.minimum((u * classes).astype(int), classes - 1)
    share = np.bincount(c[:-1] * classes + c[1:], minlength=classes**2) / max(1, len(c) - 1)
    share = share[share > 0]
    return float(-(share * np.log(share)).sum() / math.log(classes**2))


def signature(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Second-level path integrals of two series and the area between them, by their spread."""
    x, y = x - x[0], y - y[0]
    scale = (x.std() * y.std() + 1e-12) * len(x)
    xy = float((0.5 * (x[1:] + x[:-1]) * np.diff(y)).sum() / scale)
    yx = float((0.5 * (y[1:] + y[:-1]) * np.diff(x)).sum() / scale)
    return xy, yx, (xy - yx) / 2


def gpd_score(x: np.ndarray) -> float:
    """-ln of the tail probability of the last size under a generalised Pareto tail above the 90 % quantile."""
    a = np.abs(x)
    u = np.quantile(a, 0.9)
    over = a[a > u] - u
    last = a[-1] - u
    if last <= 0 or len(over) < 5 or over.var() <= 0:
        return 0.0
    mean, var = over.mean(), over.var()
    shape = 0.5 * (1 - mean * mean / var)
    scale = mean * (1 - shape)
    inner = 1 + shape * last / scale
    p = 0.1 * (inner ** (-1 / shape) if abs(shape) > 1e-9 and inner > 0 else math.exp(-last / scale))
    return -math.log(max(p, 0.0) + 1e-9)


#: Columns and a function of (lc, bar_ix) of one key that gives them.
KERNELS: dict[str, tuple[tuple[str, ...], Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]]] = {}


def _strided(values: Callable[[np.ndarray, np.ndarray], tuple[float, ...]], window: int, count: int):
    """Values on a grid of bars anchored at the absolute index, carried forward, zero before."""

    def over(lc: np.ndarray, ix: np.ndarray) -> list[np.ndarray]:
        step = max(1, window // 5)
        out = np.full((len(lc), count), np.nan)
        for i in np.flatnonzero((ix % step == 0) & (np.arange(len(lc)) >= window - 1)):
            out[i] = values(lc[i - window + 1 : i + 1], np.diff(lc[max(0, i - window) : i + 1]))
        return [pd.Series(c).ffill().fillna(0.0).to_numpy() for c in out.T]

    return over


def _kernel(name: str, parts: list[tuple[str, int, int, Callable]]) -> None:
    columns = tuple(f"{c}{'' if n == 1 else f'_{k}'}" for c, _, n, _ in parts for k in range(n))
    runs = [_strided(f, w, n) for _, w, n, f in parts]
    KERNELS[name] = columns, lambda lc, ix: (c for r in runs for c in r(lc, ix))




def _conditional_position(lc: np.ndarray, ix: np.ndarray) -> Iterator[np.ndarray]:
    """High-volatility flag, and the share of past returns of the same flag that are not above, less a half."""
    lr = pd.Series(np.diff(lc, prepend=lc[:1]))
    vol = lr.rolling(20).std()
    high = (vol > vol.rolling(252, min_periods=25).median()).to_numpy()
    past: dict[bool, list[float]] = {True: [], False: []}
    position = np.full(len(lc), np.nan)
    for i, (flag, r) in enumerate(zip(high.tolist(), lr.tolist(), strict=True)):
        own = past[flag]
        at = bisect.bisect_right(own, r)
        if len(own) > 5:
            position[i] = at / len(own) - 0.5
        own.insert(at, r)
    yield high.astype(float)
    yield position


KERNELS["regime"] = ("regime_high", "regime_position"), _conditional_position
_kernel("sample_entropy", [(f"sampen_{w}_{int(10 * t)}", w, 1, lambda x, d, t=t: (sample_entropy(x, t),)) for w in (50, 100, 200) for t in (0.1, 0.2)] + [(f"sampen_move_{w}", w, 1, lambda x, d: (sample_entropy(np.abs(d), 0.2),)) for w in (50, 100)])
_kernel("dispersion", [(f"disp_{w}", w, 1, lambda x, d: (dispersion_entropy(d),)) for w in (50, 100, 200)])
_kernel("signature", [(f"sig_{w}", w, 3, lambda x, d: signature(x, np.cumsum(np.abs(np.append(0.0, np.diff(x)))))) for w in (60, 200)])
_kernel("evt", [(f"evt_{w}", w, 1, lambda x, d: (gpd_score(d),)) for w in (100, 200)])


def build_kernel(bars: DataFrame, name: str) -> DataFrame:
    """key, bar_ix and the columns of the named kernel, one key to a task."""
    columns, run = KERNELS[name]

    def over(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_ix")
        out = part[["key", "bar_ix"]].copy()
        for c, v in zip(columns, run(part["lc"].to_numpy(), part["bar_ix"].to_numpy()), strict=True):
            out[c] = v
        return out.astype(object).where(out.notna(), None)

    found = bars.select("key", "bar_ix", "lc").groupBy("key").applyInPandas(over, "key string, bar_ix long, " + ", ".join(f"{c} double" for c in columns))
    return found.select("key", "bar_ix", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns])


def regime_check(source: str) -> str:
    lr = f"CASE WHEN count(lr) OVER {back(20)} = 20 THEN stddev_samp(lr) OVER {back(20)} END"
    return f"""
WITH v AS (SELECT *, {lr} AS vol FROM {source}),
m AS (SELECT *, CASE WHEN count(vol) OVER {back(252)} >= 25 THEN quantile_cont(vol, 0.5) OVER {back(252)} END AS med FROM v),
h AS MATERIALIZED (SELECT key, bar_ix, lr, CASE WHEN coalesce(vol > med, false) THEN 1.0 ELSE 0.0 END AS high FROM m),
c AS (SELECT a.key, a.bar_ix, count(*) AS n, count(*) FILTER (b.lr <= a.lr) AS below FROM h a JOIN h b ON a.key = b.key AND a.high = b.high AND b.bar_ix < a.bar_ix GROUP BY 1, 2)
SELECT key, bar_ix, CAST(high AS DOUBLE) AS regime_high, CASE WHEN n > 5 THEN round(below / n - 0.5, 6) + 0.0 END AS regime_position FROM h LEFT JOIN c USING (key, bar_ix)"""
