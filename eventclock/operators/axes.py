"""Bar axes: re-sampling of ticks onto information clocks.

An axis is (1) a filter of valid ticks, (2) window expressions that give each tick its
value ``x``, (3) a threshold fitted on TRAIN ticks only, (4) a clock that reads the
values in order.  The first three are DataFrame operations; the clock runs in one Arrow
kernel per key, to which only time, log price and value travel.  ``jump``, ``tick`` and
``sess2`` have no running state and are windows throughout.

Thresholds are a TRAIN rate times ``per_bar`` ticks a bar, not times the number of all
rows, so rows that come later never move earlier bars.

Ticks with a price of zero or less never count; ``guard`` says whether a volume of zero
or less is bad too, and whether a bad tick breaks the chain of returns.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.functions.dialect import DUCK, phi, render, steps, steps_sql
from eventclock.operators import axis_checks, clocks

PER_BAR = 20
K = "(PARTITION BY key ORDER BY ts, seq)"
B = "(PARTITION BY key, chain ORDER BY ts, seq)"


def over(preceding: int, following: int = 0, by: str = "key, chain") -> str:
    end = "CURRENT ROW" if following == 0 else f"{-following} PRECEDING"
    return f"(PARTITION BY {by} ORDER BY ts, seq ROWS BETWEEN {preceding} PRECEDING AND {end})"


@dataclass(frozen=True)
class Axis:
    """guard: c or cv, with a leading ! if a bad tick breaks the chain.

    threshold: aggregate text over TRAIN ticks, the mean value times ticks a bar if there is none. fit: a threshold or clock from the TRAIN values instead.
    mode: name of the clock in the recursive SQL of ``bars_check``.
    """

    guard: str
    columns: tuple[dict[str, str], ...]
    threshold: str | None = None
    clock: Callable | None = clocks.Reset
    fit: Callable | str | None = None
    mode: str = "reset"


R = {"r": f"lc - lag(lc) OVER {B}"}
_sign = {"s": f"coalesce(ffill{{nullif(CAST(sign(r) AS DOUBLE), 0.0)}} OVER {K}, 1.0)"}
_pattern = {
    "pat": f"CASE WHEN lag(lc, 2) OVER {B} IS NULL THEN NULL WHEN lag(lc, 2) OVER {B} <= lag(lc) OVER {B} THEN CASE WHEN lag(lc) OVER {B} <= lc THEN 0 WHEN lag(lc, 2) OVER {B} <= lc THEN 1 ELSE 2 END "
    f"WHEN lag(lc) OVER {B} <= lc THEN CASE WHEN lag(lc, 2) OVER {B} <= lc THEN 3 ELSE 4 END ELSE 5 END"
}


def _entropy_of_patterns(window: int = 60) -> tuple[dict[str, str], ...]:
    """Permutation entropy of the last patterns, null until there are ``window``."""
    by = f"(PARTITION BY key ORDER BY ts, seq ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    counts = {f"n{k}": f"sum(CASE WHEN pat = {k} THEN 1 ELSE 0 END) OVER {by}" for k in range(6)}
    total = " + ".join(f"CASE WHEN n{k} > 0 THEN n{k} / {window}e0 * ln(n{k} / {window}e0) ELSE 0e0 END" for k in range(6))
    return counts | {"np": f"count(pat) OVER {by}"}, {"pe": f"CASE WHEN np = {window} THEN -({total}) / {math.log(6)!r} END"}


def _bisected(machine, low: float, high: float, rounds: int) -> Callable:
    def fit(values: list, per_bar: float) -> float:
        return clocks.bisect(machine, values, max(1.0, len(values) / per_bar), low, high, rounds)

    return fit


def _run_fit(values: list, per_bar: float) -> float:
    spread = float(np.std(values)) or 1e-9
    return clocks.bisect(clocks.Run, values, max(1.0, len(values) / per_bar), spread / 2, 300 * spread, 22)


def _ratio_fit(values: list, per_bar: float) -> float:
    probe = clocks.VarianceRatio(math.inf)
    off = [x for x in map(probe.off, values) if x is not None]
    return float(np.mean(off)) * per_bar if off else math.inf


def ffd_weights(d: float, least: float = 1e-4, most: int = 2_000) -> np.ndarray:
    """Weights of a fractional difference, until they are small; ``most`` is the filter's own bound."""
    w = [1.0]
    while len(w) < most:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < least:
            break
        w.append(nxt)
    return np.array(w)


def unit_root_t(x: np.ndarray) -> float:
    """Dickey-Fuller t statistic with a constant; zero for short or flat series."""
    if len(x) < 100:
        return 0.0
    past, step = x[:-1] - x[:-1].mean(), np.diff(x)
    step = step - step.mean()
    size = past @ past
    if size <= 0:
        return 0.0
    b = past @ step / size
    rest = step - b * past
    return b / max(math.sqrt(rest @ rest / max(1, len(past) - 2) / size), 1e-300)


class FractionalMoves(clocks.Reset):
    """Sums absolute moves of a fractionally differenced log price."""

    def __init__(self, threshold: float, weights: np.ndarray):
        super().__init__(threshold)
        # the last prices twice over, so that those within the filter always lie side by side
        self.weights, self.ring, self.seen, self.last = weights[::-1].copy(), np.zeros(2 * len(weights)), 0, None

    def move(self, lc: float) -> float | None:
        n, at = len(self.weights), self.seen % len(self.weights)
        self.ring[at] = self.ring[at + n] = lc
        self.seen += 1
        if self.seen < n:
            return None
        now, before = float(self.weights @ self.ring[at + 1 : at + 1 + n]), self.last
        self.last = now
        return None if before is None else abs(now - before)

    def step(self, lc: float) -> bool:
        x = self.move(lc)
        return x is not None and super().step(x)


def _fractional(values: list, per_bar: float) -> FractionalMoves:
    """The least order of 0.1 to 0.9 at which TRAIN looks stationary, else the most stationary one, and its rate of moves.

    Filters of half the TRAIN ticks or more are passed over.
    """
    x, best = np.array(values), None
    for d in np.arange(1, 10) / 10:
        w = ffd_weights(float(d))
        if len(w) < 2 or len(w) >= len(x) // 2:
            continue
        t = unit_root_t(np.convolve(x, w, "valid"))
        if best is None or t < best[0] or t <= -2.9:
            best = t, w
        if t <= -2.9:
            break
    if best is None:
        return FractionalMoves(math.inf, ffd_weights(0.5)[:2])
    moves = np.abs(np.diff(np.convolve(x, best[1], "valid")))
    return FractionalMoves(float(moves.mean()) * per_bar if len(moves) else math.inf, best[1])


def _filter_losses(values: np.ndarray, noise: float, level: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Log likelihood of a local linear trend for each pair of noises, by the filter with its changing gains."""
    at, trend = np.full(len(level), values[0]), np.zeros(len(level))
    p00, p01, p10, p11, fit = np.full(len(level), noise), np.zeros(len(level)), np.zeros(len(level)), np.full(len(level), noise), np.zeros(len(level))
    for y in values[1:].tolist():
        a00, a01, a10, a11 = p00 + p01 + p10 + p11 + level, p01 + p11, p10 + p11, p11 + slope
        total, miss = a00 + noise, y - at - trend
        gain, turn = a00 / total, a10 / total
        at, trend = at + trend + gain * miss, trend + turn * miss
        p00, p01, p10, p11 = a00 - gain * a00, a01 - gain * a01, a10 - turn * a00, a11 - turn * a01
        fit -= 0.5 * (math.log(2 * math.pi) + np.log(total) + miss * miss / total)
    return fit


def _fixed_point(noise: float, level: float, slope: float, rounds: int = 3_000) -> tuple[float, float, float]:
    """Gains and the slope's variance where the filter settles: until they change by less than 1e-13."""
    p, gain, turn, spread = np.diag([noise, noise]), 0.0, 0.0, noise
    step, extra = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([level, slope])
    for _ in range(rounds):
        ahead = step @ p @ step.T + extra
        k = ahead[:, 0] / (ahead[0, 0] + noise)
        p, spread = ahead - np.outer(k, ahead[0]), float(ahead[1, 1])
        settled = abs(k[0] - gain) < 1e-13 and abs(k[1] - turn) < 1e-13
        gain, turn = float(k[0]), float(k[1])
        if settled:
            break
    return gain, turn, spread


def _nearest(grid: np.ndarray, counts: list[int], wanted: float) -> float:
    """The grid value whose count is nearest, the largest of equals; counts of none are passed over."""
    some = [(abs(n - wanted), -t) for t, n in zip(grid.tolist(), counts, strict=True) if n > 0]
    return -min(some)[1] if some else math.inf


def _slope(values: list, per_bar: float) -> clocks.Slope:
    """Noises by maximum likelihood over a grid, gains where the filter settles; the threshold by the bar rate."""
    x = np.array(values)
    noise = float(np.var(np.diff(x))) if len(x) > 1 else 0.0
    if noise <= 0:
        return clocks.Slope(math.inf, 0.0, 0.0, 1.0)
    level, slope = (g.ravel() for g in np.meshgrid(noise * np.array([1e-1, 1e-2, 1e-3, 1e-4]), noise * np.array([1e-5, 1e-7, 1e-9, 1e-11])))
    best = int(_filter_losses(x, noise, level, slope).argmax())
    gain, turn, spread = _fixed_point(noise, float(level[best]), float(slope[best]))
    probe = clocks.Slope(math.inf, gain, turn, math.sqrt(spread))
    seen = [z for z in map(probe.strength, values) if z is not None]
    grid = np.exp(np.linspace(math.log(0.05), math.log(30.0), 50))
    threshold = _nearest(grid, [clocks.rises(seen, t) for t in grid.tolist()], max(1.0, len(values) / per_bar))
    return clocks.Slope(threshold, gain, turn, math.sqrt(spread))


class Novelty(clocks.Edge):
    """Edge over the distance of a slow and a fast average of random Fourier features of recent returns."""

    SIZE, DEPTH, SEED = 24, 4, 20260606

    def __init__(self, threshold: float, width: float, slow: float, fast: float):
        super().__init__(threshold)
        self.frequency = np.random.default_rng(self.SEED).standard_normal((self.SIZE, self.DEPTH)) / width
        self.rates, self.recent, self.means = (slow, fast), [], None

    def statistic(self, r: float) -> float | None:
        self.recent = [*self.recent, r][-self.DEPTH :]
        if len(self.recent) < self.DEPTH:
            return None
        at = self.frequency @ self.recent
        feature = np.concatenate([np.cos(at), np.sin(at)]) / math.sqrt(self.SIZE)
        if self.means is None:
            self.means = feature, feature
            return None
        self.means = tuple(m + k * (feature - m) for m, k in zip(self.means, self.rates, strict=True))
        return float(np.linalg.norm(self.means[0] - self.means[1]))

    def step(self, r: float) -> bool:
        x = self.statistic(r)
        return x is not None and super().step(x)


def _paired(span: float, fast: float) -> float:
    """The slower rate whose weight at the span's end equals that of the fast one."""
    low, high = 1e-9, 1 / (span + 1)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if middle * (1 - middle) ** span < fast * (1 - fast) ** span else (low, middle)
    return (low + high) / 2


def _novelty(values: list, per_bar: float) -> Novelty:
    """Kernel width: median distance of TRAIN windows; threshold: the grid value nearest the bar rate."""
    x = np.lib.stride_tricks.sliding_window_view(np.array(values), Novelty.DEPTH) if len(values) >= Novelty.DEPTH else np.zeros((1, Novelty.DEPTH))
    x = x[np.linspace(0, len(x) - 1, min(300, len(x))).astype(int)]  # windows that the width is measured on
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    width = float(np.median(far[far > 0])) if (far > 0).any() else 1.0
    fast = 2 / (max(2.0, per_bar) + 1)
    slow = _paired(max(2.0, per_bar), fast)
    probe = Novelty(math.inf, width, slow, fast)
    seen = np.array([s for s in map(probe.statistic, values) if s is not None] or [1.0])
    grid = np.linspace(seen.min(), seen.max(), 80)
    counts = [int(((seen >= t) & (np.append(0.0, seen[:-1]) < t)).sum()) for t in grid]
    return Novelty(_nearest(grid, counts, max(1.0, len(values) / per_bar)), width, slow, fast)


def _surprise(values: list, per_bar: float) -> clocks.Surprise:
    """Surprise of each return's TRAIN quintile, and the threshold for the bar rate."""
    r = np.array(values)
    edges = np.quantile(r, [0.2, 0.4, 0.6, 0.8])
    bucket = np.searchsorted(edges, r, side="right")
    table = -np.log(np.maximum(np.bincount(bucket, minlength=5) / len(r), 1e-12))
    x = table[bucket]
    return clocks.Surprise(clocks.bisect(clocks.Reset, x.tolist(), round(len(r) / per_bar), 1e-6, float(x.sum()) + 1, 40), edges.tolist(), table.tolist())


@functools.lru_cache(16)
def axes_for(per_bar: int) -> dict[str, Axis]:
    """All axes at so many ticks a bar."""
    _M = per_bar
    found = {
        "dollar": Axis("cv", ({"x": "close * volume"},)),
        "tick": Axis("c", ({"x": f"row_number() OVER {K}"}, {"hit": f"x % {_M} = 0"}), clock=None),
        "vol": Axis("c", (R, {"x": "r * r * sqrt(volume)"})),
        "range": Axis("c", ({"x": "close"},), threshold="max(0.003)", clock=clocks.Distance, mode="distance"),
        "logdollar": Axis("cv", ({"x": "ln(1 + close * volume)"},)),
        "entropy": Axis("c", (R,), clock=None, fit=_surprise),
        "imbalance": Axis("!cv", (R, _sign, {"x": "CASE WHEN r IS NOT NULL THEN s * close * volume END"}), f"stddev_pop(x) * sqrt({_M}.0)", clocks.AbsReset, mode="abs"),
        "tickimb": Axis("!c", (R, _sign, {"x": "CASE WHEN r IS NOT NULL THEN s END"}), f"greatest(2.0, max(sqrt({_M}.0)))", clocks.AbsReset, mode="abs"),
        "volumeimb": Axis("!cv", (R, _sign, {"x": "CASE WHEN r IS NOT NULL THEN s * volume END"}), f"stddev_pop(x) * sqrt({_M}.0)", clocks.AbsReset, mode="abs"),
        "fracdiff": Axis("c", ({"x": "lc"},), clock=None, fit=_fractional),
        "dc": Axis("c", (R, {"x": "lc"}), f"stddev_pop(r) * sqrt({_M}.0)", clocks.Reversal, mode="reversal"),
        "zcusum": Axis("cv", ({"u": "ln(close * volume)"}, {"cnt": f"count(u) OVER {over(1949)}", "mu": f"avg(u) OVER {over(1949)}", "va": f"var_pop(u) OVER {over(1949)}"}, {"x": "CASE WHEN cnt >= 30 AND va > 1e-18 THEN (u - mu) / sqrt(va) END"}), f"max(sqrt({_M}.0))", clocks.TwoSided, mode="two"),
        "vratio": Axis("c", (R, {"q": f"lc - lag(lc, 20) OVER {B}"}, {"x": "CASE WHEN q IS NOT NULL THEN r END"}), clock=clocks.VarianceRatio, fit=_ratio_fit),
        "kyle": Axis("cv", (R, {"x": "abs(r) / sqrt(volume)"})),
        "run": Axis("!c", (R, {"x": "r"}), clock=clocks.Run, fit=_run_fit),
        "spectral": Axis("c", ({"x": "lc"},), clock=clocks.Cycle, fit=_bisected(clocks.Cycle, 1.0, 2_000.0, 20)),
        "vpin": Axis("!cv", (R, {"n": f"count(r) OVER {over(239, by='key')}", "sg": f"sqrt(avg(r * r) OVER {over(239, by='key')})"}, {"x": f"CASE WHEN n >= 20 AND sg > 0 THEN volume * abs(2 * {phi('r / sg')} - 1) END"})),
        "jump": Axis(
            "!c", (R, {"rr": f"abs(r * lag(r) OVER {B})"}, {"n": f"count(rr) OVER {over(60, -1)}", "bp": f"{math.pi / 2!r} * avg(rr) OVER {over(60, -1)}"}, {"x": "CASE WHEN n >= 20 AND bp > 0 THEN abs(r) / sqrt(bp) END"}), f"pct{{x|{1 - 1 / _M}}}", clock=None
        ),
        "volofvol": Axis("!c", (R, {"rr": f"abs(r * lag(r) OVER {B})"}, {"n": f"count(rr) OVER {over(59)}", "bp": f"{math.pi / 2!r} * avg(rr) OVER {over(59)}"}, {"lv": "CASE WHEN n >= 20 AND bp > 0 THEN ln(bp) END"}, {"x": f"abs(lv - lag(lv) OVER {B})"})),
        "wavelet": Axis(
            "c",
            ({"fl": f"first_value(lc) OVER {K}"}, {"s1": f"(lc + coalesce(lag(lc) OVER {K}, fl)) / 2"}, {"s2": f"(s1 + coalesce(lag(s1, 2) OVER {K}, fl)) / 2"}, {"s3": f"(s2 + coalesce(lag(s2, 4) OVER {K}, fl)) / 2"}, {"x": "(s2 - s3) * (s2 - s3)"}),
        ),
        "amihud": Axis("cv", (R, {"x": "abs(r) / (close * volume) * 1e9"})),
        "ddonset": Axis("!c", (R, {"dd": f"max(lc) OVER {B} - lc"}, {"x": f"CASE WHEN r IS NOT NULL THEN greatest(0.0, dd - lag(dd) OVER {B}) END"})),
        "semivar": Axis("!c", (R, {"x": "CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0.0 END"})),
        "chl": Axis(
            "c",
            (
                {"blk": f"CAST(floor((row_number() OVER {K} - 1) / 30.0) AS BIGINT)"},
                {"eta": "(max(lc) OVER (PARTITION BY key, blk) + min(lc) OVER (PARTITION BY key, blk)) / 2", "full": "count(lc) OVER (PARTITION BY key, blk)", "pos": "row_number() OVER (PARTITION BY key, blk ORDER BY ts, seq)"},
                {"c1": f"lag(lc, 30) OVER {K}", "e1": f"lag(eta, 30) OVER {K}"},
                {"x": "CASE WHEN pos = 30 AND c1 IS NOT NULL THEN sqrt(4 * greatest(0.0, (c1 - e1) * (c1 - eta))) END"},
            ),
            f"avg(x) * {_M / 30!r}",
        ),
        "diurnal": Axis(
            "!c",
            (R, {"mod": "hour(ts) * 60 + minute(ts)"}, {"tr": "CASE WHEN is_train THEN abs(r) END"}, {"pn": "count(tr) OVER (PARTITION BY key, mod)", "pm": "avg(tr) OVER (PARTITION BY key, mod)", "pg": "avg(tr) OVER (PARTITION BY key)"}, {"pf": "CASE WHEN pn >= 20 AND pm > 0 THEN pm ELSE pg END"}, {"x": "(r / pf) * (r / pf)"}),
        ),
        "kalman": Axis("c", ({"x": "lc"},), clock=None, fit=_slope),
        "newma": Axis("!c", (R, {"x": "r"}), clock=None, fit=_novelty),
        "signedjumpvar": Axis("!c", (R, {"x": "r * abs(r)"}), f"stddev_pop(x) * sqrt({_M}.0)", clocks.AbsReset, mode="abs"),
        "logdollar_rc": Axis("cv", ({"x": "ln(1 + close * volume)"},), clock=lambda t: clocks.Recalibrated(t, _M, 400, 40), mode="recal"),
        "sess2": Axis(
            "c",
            (
                {"band": "CASE WHEN hour(ts) * 60 + minute(ts) >= 960 THEN 2 WHEN hour(ts) * 60 + minute(ts) >= 930 THEN 1 ELSE 0 END", "day": "CAST(ts AS DATE)"},
                {"hit": "band > 0 AND row_number() OVER (PARTITION BY key, day, band ORDER BY ts, seq) = 1"},
            ),
            clock=None,
        ),
        "gapflow": Axis(
            "!c",
            (
                R,
                {"gap": f"CASE WHEN r IS NULL THEN NULL WHEN CAST(ts AS DATE) = lag(CAST(ts AS DATE)) OVER {B} THEN 0 ELSE 1 END"},
                {"ki": "avg(CASE WHEN is_train AND gap = 0 THEN r * r END) OVER (PARTITION BY key)", "kg": "avg(CASE WHEN is_train AND gap = 1 THEN r * r END) OVER (PARTITION BY key)"},
                {"x": "r * r * CASE WHEN gap = 1 THEN least(500.0, greatest(1.0, coalesce(ki / nullif(kg, 0.0), 1.0))) ELSE 1.0 END"},
            ),
            clock=clocks.Carry,
            mode="carry",
        ),
        "permclock": Axis("!c", (_pattern, *_entropy_of_patterns(), {"x": f"round(abs(pe - lag(pe) OVER {B}), 9)"}), f"round(avg(x) * {_M}, 9) + 5e-10", clocks.Carry, mode="carry"),  # on a grid, so that sums never tie with the threshold
        "mpnov": Axis(
            "!c",
            (
                R,
                {"n": f"count(r) OVER {over(15)}", "m": f"avg(r) OVER {over(15)}", "sd": f"stddev_pop(r) OVER {over(15)}"},
                {f"g{k}": f"avg(r) OVER {over(15 - 4 * k, -(12 - 4 * k))}" for k in range(4)},
                {"word": "CASE WHEN n = 16 AND sd > 0 THEN " + " + ".join(f"{4**k} * CASE WHEN (g{k} - m) / sd < -0.6745 THEN 0 WHEN (g{k} - m) / sd < 0 THEN 1 WHEN (g{k} - m) / sd < 0.6745 THEN 2 ELSE 3 END" for k in range(4)) + " END"},
                {"x": "CASE WHEN word IS NOT NULL THEN 1 / sqrt(row_number() OVER (PARTITION BY key, word ORDER BY ts, seq) + 0.0) END"},
            ),
            clock=clocks.Carry,
            mode="carry",
        ),
        "pecusum": Axis("!c", (_pattern, *_entropy_of_patterns(), {"x": "pe"}), clock=clocks.Complexity, fit=_bisected(clocks.Complexity, 1e-4, 5.0, 18)),
        "calmonset": Axis("!c", (_pattern, *_entropy_of_patterns(), {"x": "pe"}), clock=clocks.CalmOnset, fit=_bisected(clocks.CalmOnset, 1e-4, 5.0, 18)),
    }

    return {k: replace(a, threshold=a.threshold or f"avg(x) * {per_bar}") for k, a in found.items()}


AXES = axes_for(PER_BAR)


def valid(ticks: DataFrame, guard: str, train_end: str) -> DataFrame:
    """Ticks that count, with lc, is_train and the number of the chain they are in."""
    good = "close > 0 AND volume > 0" if guard.endswith("v") else "close > 0"
    chain = f"sum(CASE WHEN {good} THEN 0 ELSE 1 END) OVER {K}" if guard[0] == "!" else "0"
    return ticks.withColumn("chain", F.expr(f"CAST({chain} AS BIGINT)")).where(good).withColumns({"lc": F.ln("close"), "is_train": F.col("ts") < F.lit(train_end).cast("timestamp_ntz")})


def build(ticks: DataFrame, name: str, train_end: str, per_bar: int = PER_BAR) -> DataFrame:
    """key, bar_ix, ts, log_close of the named axis; per_bar: ticks of a TRAIN bar, on average."""
    if name not in AXES:
        raise ValueError(f"unknown axis {name!r}")
    axis = axes_for(per_bar)[name]
    rows = steps(valid(ticks, axis.guard, train_end), *axis.columns)
    if axis.clock is None and axis.fit is None:
        if name == "jump":
            limit = rows.where("is_train").groupBy("key").agg(F.expr(render(axis.threshold)).alias("t"))
            rows = rows.join(limit, "key").withColumn("hit", F.expr("x >= t"))
        hits = rows.where("hit").select("key", "ts", "seq", "lc")
    else:
        hits = _folded(rows, name, axis, per_bar)
    return hits.select("key", (F.expr(f"row_number() OVER {K}") - 1).cast("long").alias("bar_ix"), "ts", F.round("lc", 9).alias("log_close"))


def fitted(axis: Axis, values: list, per_bar: float):
    """The clock of an axis whose fit is a search over TRAIN values."""
    found = axis.fit(values, per_bar)
    return axis.clock(found) if axis.clock else found


def _folded(rows: DataFrame, name: str, axis: Axis, per_bar: int) -> DataFrame:
    """Ticks at which a bar ends.

    A task reads the ticks of its keys in order, a batch at a time, and holds a clock.  Only
    where the fit is a search it holds a key's TRAIN ticks too, until the first tick behind them.

    The numbers of a key's ticks are a window, so that the plan needs whole keys in order.  A
    repartition by key is dropped where its input has been dealt by key already, for a join, say;
    when that join becomes a broadcast as the plan runs, its shuffle is read in parts of a key.
    """
    column = "r" if name == "entropy" else "x"
    value = F.array("x", "q") if name == "vratio" else F.col(column)
    sent = rows.withColumn("__v", value).where(F.col(column).isNotNull())
    if axis.fit is None:
        # one row for each key
        limit = rows.where("is_train").groupBy("key").agg(F.expr(render(axis.threshold)).cast("double").alias("__t"))
        sent = sent.join(limit, "key")
    else:
        sent = sent.withColumn("__t", F.lit(None).cast("double"))

    def ended(clock, part: pa.RecordBatch, values: list) -> Iterator[pa.RecordBatch]:
        hits = [i for i, x in enumerate(values) if clock.step(x)]
        if hits:
            yield part.take(pa.array(hits, pa.int64())).select(["key", "ts", "seq", "lc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock, train = None, []  # train: a key's TRAIN ticks before its clock is fitted

        def fit_train():
            found = fitted(axis, [x for _, values in train for x in values], per_bar)
            for part, values in train:
                yield from ended(found, part, values)
            return found

        for batch in batches:
            is_train, values, numbers = (batch.column(i).to_pylist() for i in (4, 5, 7))
            begins = [0, *(i for i in range(1, len(numbers)) if numbers[i] == 1), len(numbers)]
            for a, b in itertools.pairwise(begins):
                if a == b:
                    continue
                if numbers[a] == 1:
                    if train:
                        yield from fit_train()
                    clock, train = None, []
                    if axis.fit is None:
                        clock = axis.clock(batch.column(6)[a].as_py())
                part, own = batch.slice(a, b - a), values[a:b]
                if axis.fit is not None and clock is None:
                    cut = is_train[a:b].index(False) if False in is_train[a:b] else b - a
                    if cut:
                        train.append((part.slice(0, cut), own[:cut]))
                    if cut == b - a or not train:
                        continue  # more TRAIN ticks may follow, or the key has none
                    clock = yield from fit_train()
                    train, part, own = [], part.slice(cut), own[cut:]
                yield from ended(clock, part, own)
        if train:
            yield from fit_train()

    numbered = sent.select("key", "ts", "seq", "lc", "is_train", "__v", "__t", F.expr(f"row_number() OVER {K}").alias("__n"))
    dealt = numbered.sortWithinPartitions("key", "ts", "seq")  # the order that the window leaves
    return dealt.mapInArrow(run, "key string, ts timestamp_ntz, seq long, lc double")


def bars_check(source: str, name: str, train_end: str) -> str | None:
    """SQL for the checking engine; None for some axes whose fit is a search."""
    axis, _M = AXES[name], PER_BAR
    good = "close > 0 AND volume > 0" if axis.guard.endswith("v") else "close > 0"
    chain = f"sum(CASE WHEN {good} THEN 0 ELSE 1 END) OVER {K}" if axis.guard[0] == "!" else "0"
    base = f"(SELECT *, ln(close) AS lc, ts < TIMESTAMP '{train_end}' AS is_train FROM (SELECT *, {chain} AS chain FROM {source}) WHERE {good})"
    rows = steps_sql(base, *axis.columns)
    if axis.fit is not None:
        return axis_checks.searched(rows, name, PER_BAR)
    final = "SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts, seq) - 1 AS bar_ix, ts, round(lc, 9) AS log_close FROM "
    if axis.clock is None:
        if name == "jump":
            return f"WITH v AS MATERIALIZED {rows}, t AS (SELECT key, {render(axis.threshold, DUCK)} AS t FROM v WHERE is_train GROUP BY key) {final} v JOIN t USING (key) WHERE x >= t"
        return f"{final} {rows} WHERE hit"
    first, following, hit = {
        "reset": ({"a": "x"}, {"a": "CASE WHEN f.hit THEN 0.0 ELSE f.a END + i.x"}, "a >= t"),
        "carry": ({"a": "x"}, {"a": "CASE WHEN f.hit THEN f.a - i.t ELSE f.a END + i.x"}, "a >= t"),
        "abs": ({"a": "x"}, {"a": "CASE WHEN f.hit THEN 0.0 ELSE f.a END + i.x"}, "abs(a) >= t"),
        "two": ({"a": "greatest(0.0, x)", "b": "greatest(0.0, -x)"}, {"a": "greatest(0.0, CASE WHEN f.hit THEN 0.0 ELSE f.a END + i.x)", "b": "greatest(0.0, CASE WHEN f.hit THEN 0.0 ELSE f.b END - i.x)"}, "a >= t OR b >= t"),
        "distance": ({"a": "x", "y": "x"}, {"a": "CASE WHEN f.hit THEN f.y ELSE f.a END", "y": "i.x"}, "abs(y / a - 1) >= t"),
        "reversal": (
            {"m": "1", "e": "x", "y": "x"},
            {"m": "CASE WHEN f.hit THEN -f.m ELSE f.m END", "e": "CASE WHEN f.hit THEN f.y WHEN (f.y - f.e) * f.m > 0 THEN f.y ELSE f.e END", "y": "i.x"},
            "(e - y) * m >= t",
        ),
        "recal": ({"a": "x", "h": "t"}, {"a": "CASE WHEN f.hit THEN 0.0 ELSE f.a END + i.x", "h": f"CASE WHEN f.hit AND f.rn >= 40 THEN {_M} * f.tm ELSE f.h END"}, "a >= h"),
    }[axis.mode]
    extra = ", avg(x) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS tm" if axis.mode == "recal" else ""
    carried = ["key", "rn", "ts", "seq", "lc", "t", *["tm"] * bool(extra)]
    begin = ", ".join(f"{v} AS {k}" for k, v in first.items())
    more = ", ".join(f"{v} AS {k}" for k, v in following.items())
    kept, inner = ", ".join(carried), ", ".join(f"i.{c}" for c in carried)
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT * FROM {rows}),
t AS (SELECT key, CAST({render(axis.threshold, DUCK)} AS DOUBLE) AS t FROM v WHERE is_train GROUP BY key),
i AS MATERIALIZED (SELECT key, ts, seq, lc, CAST(x AS DOUBLE) AS x, t, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn{extra} FROM v JOIN t USING (key) WHERE x IS NOT NULL),
f AS (
  SELECT *, {hit} AS hit FROM (SELECT {kept}, {begin} FROM i WHERE rn = 1)
  UNION ALL
  SELECT *, {hit} AS hit FROM (SELECT {inner}, {more} FROM f JOIN i ON i.key = f.key AND i.rn = f.rn + 1)
)
{final} f WHERE hit"""
