"""Labels that are iterative over a key's bars: one Arrow kernel per key.

A labeler is a generator of tries (labels, reach[, score]) over a ``Bars`` view of one
key; labels are 1, 0 and -1.  ``choose`` applies the shared gates.  Forward windows are
built in blocks of rows, so memory stays bounded for long keys.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 20_000
Try = tuple


class Bars:
    """Log closes and returns of one key in order, with its split."""

    def __init__(self, part: pd.DataFrame):
        self.lc, self.lr = part["lc"].to_numpy(float), part["lr"].to_numpy(float)
        split = part["split"].to_numpy()
        self.train, self.val, self.test = split == "train", split == "val", split == "test"
        self.n = len(self.lc)

    def forward(self, h: int) -> np.ndarray:
        out = np.full(self.n, np.nan)
        if self.n > h:
            out[:-h] = self.lc[h:] - self.lc[:-h]
        return out

    def spread(self, h: int) -> np.ndarray:
        """Deviation of the next h returns."""
        return self.ahead(h, lambda w: np.diff(w, axis=1).std(axis=1))

    def ahead(self, h: int, f: Callable, of: np.ndarray | None = None, shape: int = 1) -> np.ndarray:
        """f over windows of a bar and the h behind it, null where they are not all there."""
        x = self.lc if of is None else of
        out = np.full((shape, self.n), np.nan)
        if self.n > h:
            windows = np.lib.stride_tricks.sliding_window_view(x, h + 1)
            for a in range(0, len(windows), BLOCK):
                out[:, a : a + BLOCK][:, : len(windows[a : a + BLOCK])] = f(windows[a : a + BLOCK])
        return out[0] if shape == 1 else out

    def sigma(self) -> np.ndarray:
        """Trailing deviation of 50 returns, at least the TRAIN median where it is missing."""
        s = pd.Series(self.lr).rolling(50).std().to_numpy()
        seen = s[self.train & np.isfinite(s)]
        floor = float(np.median(seen)) if len(seen) else 0.0
        return np.where(np.isfinite(s) & (s > 0), s, floor if floor > 0 else 1e-6)

    def first_test(self) -> int:
        at = np.flatnonzero(self.test)
        return int(at[0]) if len(at) else self.n


def choose(bars: Bars, tries: Iterator[Try], least: tuple[int, int] = (100, 20), share: tuple[float, float] = (0.2, 0.8), judged: str = "train") -> np.ndarray:
    """Labels of the best try; the first of equals; -1 throughout if none counts."""
    best, found = -np.inf, np.full(bars.n, -1)
    for y, *score in tries:
        labelled = y >= 0
        train, val = labelled & bars.train, labelled & bars.val
        if train.sum() < least[0] or val.sum() < least[1]:
            continue
        ones = y[val if judged == "val" else train].mean()
        if not share[0] < ones < share[1]:
            continue
        own = score[0] if score else min(ones, 1 - ones)
        if own > best:
            best, found = own, y
    return found


def strong(bars: Bars, strength: np.ndarray, direction: np.ndarray, quantiles: tuple[float, ...]) -> Iterator[Try]:
    """Direction of bars whose strength is at least a TRAIN quantile."""
    seen = strength[bars.train & np.isfinite(strength)]
    if len(seen) < 100:
        return
    for q in quantiles:
        ok = np.isfinite(strength) & np.isfinite(direction) & (strength >= np.quantile(seen, q))
        yield (np.where(ok, (direction > 0).astype(int), -1),)


def states(bars: Bars, state: np.ndarray, count: int, h: int, every_up: bool = False, least: int = 1) -> np.ndarray:
    """One for bars in the state (or all states) whose TRAIN bars go up (most)."""
    ahead = bars.forward(h)
    ok = np.isfinite(ahead) & (state >= 0)
    means = np.array([ahead[ok & bars.train & (state == k)].mean() if (ok & bars.train & (state == k)).sum() >= least else -np.inf for k in range(count)])
    up = means > 0 if every_up else np.arange(count) == means.argmax()
    return np.where(ok, up[np.maximum(state, 0)].astype(int), -1)


# --- first touches ---


def barriers(width: float):
    def tries(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
        sigma = b.sigma()
        for h in hs:
            y = np.full(b.n, -1)
            if b.n > h:
                windows = np.lib.stride_tricks.sliding_window_view(b.lc, h + 1)
                for a in range(0, len(windows), BLOCK):
                    moves = windows[a : a + BLOCK, 1:] - windows[a : a + BLOCK, :1]
                    limit = width * sigma[a : a + len(moves), None]
                    up, down = moves >= limit, moves <= -limit
                    at = np.where((up | down).any(axis=1), (up | down).argmax(axis=1), h - 1)
                    y[a : a + len(moves)] = moves[np.arange(len(moves)), at] > 0
            yield (y,)

    return tries


def time_to_rise(b: Bars, width: float = 2.0, h: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, and bounds of the time until the price is up by the width: both equal, or open above."""
    y, low, high = np.full(b.n, -1), np.full(b.n, np.nan), np.full(b.n, np.nan)
    if b.n > h:
        moves = np.lib.stride_tricks.sliding_window_view(b.lc, h + 1)
        touched = moves[:, 1:] - moves[:, :1] >= width * b.sigma()[: len(moves), None]
        hit, at = touched.any(axis=1), touched.argmax(axis=1) + 1.0
        y[: len(moves)], low[: len(moves)], high[: len(moves)] = hit, np.where(hit, at, h), np.where(hit, at, np.inf)
    return y, low, high


def legs(horizons: tuple[int, ...]):
    def tries(b: Bars, hs: tuple[int, ...] = horizons) -> Iterator[Try]:
        sigma = float(b.lr[b.train].std()) if b.train.any() else 0.0
        if sigma <= 0:
            return
        for h in hs:
            for k in (2.0, 3.5):

                def leg(w: np.ndarray, h: int = h, k: float = k) -> np.ndarray:
                    start = w[:, :1]
                    top, low = np.maximum.accumulate(w, axis=1), np.minimum.accumulate(w, axis=1)
                    back = k * sigma * np.sqrt(np.arange(h + 1))
                    fell, rose = (top - w >= back) & (top > start), (w - low >= back) & (low < start)
                    end = np.where((fell | rose).any(axis=1), (fell | rose).argmax(axis=1), h)
                    row = np.arange(len(w))
                    gain = np.where(fell[row, end], top[row, end], np.where(rose[row, end], low[row, end], w[row, end]))
                    return gain - start[:, 0]

                net = b.ahead(h, leg)
                yield from strong(b, np.abs(net), net, (0.4, 0.5, 0.6))

    return tries


# --- statistics of the bars ahead ---


def by_statistic(horizons: tuple[int, ...], quantiles: tuple[float, ...], statistic: Callable):
    """statistic: over blocks of (bar, h behind it), gives strength and direction."""

    def tries(b: Bars, hs: tuple[int, ...] = horizons) -> Iterator[Try]:
        for h in hs:
            made = b.ahead(h, statistic, shape=2)
            yield from strong(b, made[0], made[1], quantiles)

    return tries


def _net(w: np.ndarray) -> np.ndarray:
    return w[:, -1] - w[:, 0]


def calmar(w: np.ndarray) -> np.ndarray:
    fall = (np.maximum.accumulate(w, axis=1) - w).max(axis=1)
    rise = (w - np.minimum.accumulate(w, axis=1)).max(axis=1)
    return np.stack([np.abs(_net(w)) / (np.where(_net(w) > 0, fall, rise) + 1e-6), _net(w)])


def mean_shift(w: np.ndarray) -> np.ndarray:
    d = np.diff(w, axis=1)
    h = d.shape[1]
    m = np.arange(3, h - 2)
    before = np.cumsum(d, axis=1)[:, m - 1]
    after = (d.sum(axis=1, keepdims=True) - before) / (h - m)
    sizes = np.abs(after - before / m) * np.sqrt(m * (h - m) / h) / np.maximum(d.std(axis=1, keepdims=True), 1e-9)
    at = sizes.argmax(axis=1)
    row = np.arange(len(w))
    return np.stack([sizes[row, at], after[row, at]])


def variance_break(w: np.ndarray) -> np.ndarray:
    s = np.diff(w, axis=1) ** 2
    h = s.shape[1]
    total = s.sum(axis=1)
    part = np.cumsum(s, axis=1)[:, :-1]
    m = np.arange(1, h)
    off = np.abs(part / np.where(total > 1e-18, total, np.nan)[:, None] - m / h)
    at = np.where(np.isnan(off).all(axis=1), 0, np.nan_to_num(off, nan=-1).argmax(axis=1))
    row = np.arange(len(w))
    calmer = part[row, at] / m[at] - (total - part[row, at]) / (h - m[at])
    return np.stack([math.sqrt(h / 2) * off[row, at], calmer])


def recursive_break(w: np.ndarray) -> np.ndarray:
    """Largest cumulative one-step error of a growing trend line, by its spread."""
    y = w[:, 1:]
    h = y.shape[1]
    x = np.arange(h, dtype=float)
    n = np.arange(max(4, h // 10), h)
    sx, sxx = np.cumsum(x)[n - 1], np.cumsum(x * x)[n - 1]
    sy, sxy = np.cumsum(y, axis=1)[:, n - 1], np.cumsum(x * y, axis=1)[:, n - 1]
    centred = sxx - sx * sx / n
    slope = (sxy - sx * sy / n) / centred
    error = (y[:, n] - sy / n - slope * (x[n] - sx / n)) / np.sqrt(1 + 1 / n + (x[n] - sx / n) ** 2 / centred)
    spread = np.sqrt(np.maximum((error**2).mean(axis=1, keepdims=True), 1e-24))
    return np.stack([np.abs(np.cumsum(error, axis=1) / spread).max(axis=1) / math.sqrt(len(n)), _net(w)])


def explosive(w: np.ndarray) -> np.ndarray:
    """Largest Dickey-Fuller statistic over a few starts."""
    h = w.shape[1] - 1
    least = max(10, h // 4)
    best = np.full(len(w), -1e9)
    for start in range(0, h - least + 1, max(1, (h - least) // 4)):
        x, d = w[:, start:-1], np.diff(w[:, start:], axis=1)
        n = x.shape[1]
        xc, dc = x - x.mean(axis=1, keepdims=True), d - d.mean(axis=1, keepdims=True)
        sxx = (xc * xc).sum(axis=1)
        slope = (xc * dc).sum(axis=1) / np.maximum(sxx, 1e-300)
        rest = ((dc - slope[:, None] * xc) ** 2).sum(axis=1) / (n - 2)
        error = np.sqrt(rest / np.maximum(sxx, 1e-300))
        best = np.maximum(best, np.where((sxx >= 1e-12) & (error > 1e-12), slope / np.maximum(error, 1e-300), -1e9))
    return np.stack([best, _net(w)])


def persistence(w: np.ndarray) -> np.ndarray:
    """Slope of log detrended fluctuation against log scale."""
    x = w[:, 1:]
    n = x.shape[1]
    z = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    scales, size = [max(4, n // 8), max(5, n // 4), max(6, n // 2)], []
    for s in scales:
        parts = z[:, : n // s * s].reshape(len(z), n // s, s)
        t = np.arange(s) - (s - 1) / 2
        centred = parts - parts.mean(axis=2, keepdims=True)
        rest = centred - ((centred * t).sum(axis=2, keepdims=True) / (t * t).sum()) * t
        size.append(np.log(np.sqrt((rest**2).mean(axis=2)).mean(axis=1) + 1e-12))
    t = np.log(scales) - np.log(scales).mean()
    return np.stack([(t[:, None] * np.array(size)).sum(axis=0) / (t * t).sum(), _net(w)])


def _horizons_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the next higher value and of the last one that is not lower, and whether that is equal."""
    after, before, same = np.full(len(x), 1 << 40), np.full(len(x), -1), np.zeros(len(x), bool)
    open_: list[int] = []
    for i, v in enumerate(x.tolist()):
        while open_ and x[open_[-1]] < v:
            after[open_.pop()] = i
        if open_:
            before[i], same[i] = open_[-1], x[open_[-1]] == v
        open_.append(i)
    return after, before, same


def visibility(b: Bars, hs: tuple[int, ...] = (40, 80, 160)) -> Iterator[Try]:
    """Imbalance of links to lower and to higher bars in the horizontal visibility graph ahead.

    Two bars see each other if the later is the next higher of the earlier, or the earlier the
    last not lower of the later; so links of a window are counts over the whole series' links.
    """
    after, before, same = _horizons_of(b.lc)
    for h in hs:
        out = np.full(b.n, np.nan)
        for a in range(0, max(0, b.n - h - 1), BLOCK):
            at = np.arange(a, min(a + BLOCK, b.n - h - 1))
            nxt, last, equal = (np.lib.stride_tricks.sliding_window_view(x[1:], h + 1)[at] for x in (after, before, same))
            inside = last > at[:, None]
            rising = (nxt <= at[:, None] + h + 1).sum(axis=1) + (inside & equal).sum(axis=1)
            falling = (inside & ~equal).sum(axis=1)
            out[at] = (rising - falling) / np.maximum(1, rising + falling)
        yield from strong(b, np.abs(out), out, (0.4, 0.5, 0.6))


def sign_memory(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    """Mean autocorrelation of return signs at lags 1 to 5."""
    for h in hs:

        def memory(s: np.ndarray) -> np.ndarray:
            s, all_lags = s[:, :-1], []
            for k in range(1, 6):
                x, y = s[:, :-k], s[:, k:]
                x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
                size = np.sqrt((x * x).mean(axis=1) * (y * y).mean(axis=1))
                all_lags.append(np.where(size > 1e-12, (x * y).mean(axis=1) / np.where(size > 1e-12, size, 1), np.nan))
            lags = np.array(all_lags)
            known = np.isfinite(lags).sum(axis=0)
            return np.round(np.where(known > 0, np.nansum(lags, axis=0) / np.maximum(known, 1), np.nan), 12)

        yield from strong(b, b.ahead(h, memory, np.sign(b.lr)), b.forward(h), (0.4, 0.5, 0.6))


def information_flow(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    """What the symbol before adds about the next beyond the one two back, in bits; symbols are TRAIN thirds of returns ahead.

    Sizes of equal counts must tie, so they lie on a grid; so do those of ``sign_memory``.
    """
    for h in hs:
        if b.n <= h + 1:
            continue
        ahead = np.lib.stride_tricks.sliding_window_view(b.lr, h)[1:]
        low, high = np.quantile(ahead[b.train[: len(ahead)]], [1 / 3, 2 / 3]) if b.train[: len(ahead)].sum() >= 50 else (0.0, 0.0)
        if not low < high:
            continue
        symbol = (b.lr > low).astype(int) + (b.lr > high)
        flow = np.full(b.n, np.nan)
        code = symbol[2:] * 9 + symbol[1:-1] * 3 + symbol[:-2]
        sums = np.concatenate([np.zeros((1, 27)), np.cumsum(np.eye(27)[code], axis=0)])
        p = (sums[h - 1 :] - sums[1 : len(sums) - h + 2])[: b.n - h].reshape(-1, 3, 3, 3) / (h - 2)

        def entropy(q: np.ndarray) -> np.ndarray:
            return -(q * np.log(np.where(q > 0, q, 1))).reshape(len(q), -1).sum(axis=1)

        bits = (entropy(p.sum(axis=1)) + entropy(p.sum(axis=2)) - entropy(p.sum(axis=(1, 2))) - entropy(p)) / math.log(2)
        flow[: len(bits)] = np.round(np.maximum(bits, 0), 12)
        yield from strong(b, flow, b.forward(h), (0.4, 0.5, 0.6))


def excursion(b: Bars, hs: tuple[int, ...] = (40, 80)) -> Iterator[Try]:
    """One if the price reaches its target with little root-mean-square drawdown on the way."""
    for h in hs:
        past = pd.Series(b.lr).rolling(h).std(ddof=0).shift(1).to_numpy()
        ulcer = b.ahead(h, lambda w: np.sqrt(((np.maximum.accumulate(w, axis=1) - w)[:, 1:] ** 2).mean(axis=1)))
        top = b.ahead(h, lambda w: w[:, 1:].max(axis=1))
        for k in (0.5, 1.0):
            ok = np.isfinite(past) & (past > 0) & np.isfinite(ulcer) & (np.arange(b.n) >= h)
            reach = ok & (top >= b.lc + k * np.nan_to_num(past) * math.sqrt(h))
            if (reach & b.train).sum() < 60:
                continue
            for q in (0.5, 0.7):
                yield (np.where(ok, (reach & (ulcer <= np.quantile(ulcer[reach & b.train], q))).astype(int), -1),)


def best_action(b: Bars, hs: tuple[int, ...] = (50, 100, 200), cost: float = 0.0005) -> Iterator[Try]:
    """One if the best path of short, flat and long positions with costs starts long."""
    position = np.array([-1.0, 0.0, 1.0])
    change = cost * np.abs(position[:, None] - position)
    for h in hs:
        if b.n <= h:
            continue
        moves = np.diff(np.lib.stride_tricks.sliding_window_view(b.lc, h + 1), axis=1)
        value = position[:, None] * moves[:, -1]
        for k in range(h - 2, -1, -1):
            value = position[:, None] * moves[:, k] + (value[:, None] - change[:, :, None]).max(axis=0)
        y = np.full(b.n, -1)
        y[: len(moves)] = (value - cost * np.abs(position)[:, None]).argmax(axis=0) == 2
        labelled = (y >= 0) & b.train
        yield y, -abs(y[labelled].mean() - 0.5) if labelled.any() else -1


# --- turning points of the path so far ---


def turns(lc: np.ndarray, back: float) -> tuple[np.ndarray, np.ndarray]:
    """Trend at each bar (1 or -1), and whether it turned there."""
    from eventclock.operators.clocks import Reversal

    clock, trend, turned = Reversal(back), np.empty(len(lc), int), np.zeros(len(lc), bool)
    for i, x in enumerate(lc.tolist()):
        turned[i] = clock.step(x)
        trend[i] = clock.trend
    return trend, turned


def next_event(at: np.ndarray, value: np.ndarray, n: int, reach: int) -> np.ndarray:
    """Value of the first event behind each bar, -1 if it is farther than the reach."""
    k = np.searchsorted(at, np.arange(n), side="right")
    near = k < len(at)
    out = np.full(n, -1)
    k = np.minimum(k, max(0, len(at) - 1))
    near &= (at[k] - np.arange(n) <= reach) if len(at) else False
    out[near] = value[k][near]
    return out


def _train_sigma(b: Bars) -> float:
    return float(b.lr[b.train].std()) if b.train.sum() >= 50 else 0.0


def reversal_ahead(b: Bars) -> Iterator[Try]:
    for k in (3.0, 5.0, 8.0):
        trend, turned = turns(b.lc, k * _train_sigma(b))
        at = np.flatnonzero(turned)
        if _train_sigma(b) > 0 and len(at) >= 20:
            yield next_event(at, (trend[at] > 0).astype(int), b.n, 200), -k  # the first that is balanced


def trend_now(b: Bars) -> Iterator[Try]:
    for k in (3.0, 5.0, 8.0, 12.0):
        if _train_sigma(b) > 0:
            yield (turns(b.lc, k * _train_sigma(b))[0] > 0).astype(int), -k


def line_break(b: Bars) -> Iterator[Try]:
    """Whether the next line of a three-line-break chart is a reversal."""
    for k in (0.5, 1.0, 1.5, 2.0, 3.0):
        gap = k * _train_sigma(b)
        if gap <= 0:
            continue
        lines, trend, at, turned = [b.lc[0]], 0, [], []
        for i, x in enumerate(b.lc.tolist()):
            on = (x >= lines[-1] + gap) if trend >= 0 else False
            down_on = (x <= lines[-1] - gap) if trend <= 0 else False
            back = (trend > 0 and x <= min(lines[-3:])) or (trend < 0 and x >= max(lines[-3:]))
            if on or down_on or back:
                lines.append(x)
                at.append(i)
                turned.append(int(not (on or down_on)))
                trend = (1 if on else -1) if on or down_on else -trend
        if len(at) >= 20:
            y = next_event(np.array(at), np.array(turned), b.n, 200)
            seen = (y >= 0) & b.train
            yield y, -abs(y[seen].mean() - 0.5) if seen.any() else -1


# --- regimes ---


def two_means(x: np.ndarray, train: np.ndarray, k: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """k-means fitted on TRAIN rows from quantiles of the first column; cluster of each row, centres."""
    order = np.argsort(x[train][:, 0], kind="stable")
    centres = x[train][order[((np.arange(k) + 0.5) / k * (len(order) - 1)).astype(int)]]
    for _ in range(rounds):
        own = ((x[train][:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[train][own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1), centres


def _calm(b: Bars, h: int) -> np.ndarray:
    """Bars of the calmer of two clusters of the deviation ahead."""
    vol = b.spread(h)
    known = np.isfinite(vol)
    out = np.zeros(b.n, bool)
    if (known & b.train).sum() >= 30:
        own, centres = two_means(vol[known][:, None], b.train[known], 2)
        out[known] = own == centres[:, 0].argmin()
    return out


def _moves(b: Bars, h: int, calm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised (move, size of move) of calm bars, and which are TRAIN."""
    x = np.stack([b.forward(h), np.abs(b.forward(h))], axis=1)[calm]
    train = b.train[calm]
    if train.sum() < 60:
        return x[:0], train[:0]
    return (x - x[train].mean(axis=0)) / (x[train].std(axis=0) + 1e-9), train


def two_stage(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    for h in hs:
        calm = _calm(b, h)
        x, train = _moves(b, h, calm)
        for k in (2, 3) if len(x) else ():
            own, centres = two_means(x, train, k)
            y = np.full(b.n, -1)
            y[calm] = own == centres[:, 0].argmax()
            seen = (y >= 0) & b.val
            ones = y[seen].mean() if seen.any() else 0.0
            yield y, min(ones, 1 - ones)


def _shares(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _log_normal(z: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    c = z - mean
    return -0.5 * (((c @ np.linalg.inv(spread)) * c).sum(axis=1) + np.linalg.slogdet(2 * np.pi * spread)[1])


def gaussian_mixture(x: np.ndarray, k: int, rounds: int = 100) -> Callable[[np.ndarray], np.ndarray]:
    """Mixture with full covariances by expectation maximisation from k-means; gives shares of each component."""
    own, means = two_means(x, np.ones(len(x), bool), k)
    d = x.shape[1]
    share = np.eye(k)[own]
    for _ in range(rounds):
        n = share.sum(axis=0) + 1e-9
        weight = n / n.sum()
        means = share.T @ x / n[:, None]
        spread = np.stack([(share[:, j, None] * (x - means[j])).T @ (x - means[j]) / n[j] + 1e-5 * np.eye(d) for j in range(k)])

        def part(z: np.ndarray, weight=weight, means=means, spread=spread) -> np.ndarray:
            return _shares(np.stack([np.log(weight[j]) + _log_normal(z, means[j], spread[j]) for j in range(k)], axis=1))

        new = part(x)
        if np.abs(new - share).max() < 1e-5:
            break
        share = new
    part.means = means
    return part


def digamma(x: np.ndarray) -> np.ndarray:
    """Slope of the logarithm of the gamma function, for positive values."""
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def bayesian_mixture(x: np.ndarray, k: int, concentration: float = 0.1, rounds: int = 300) -> Callable[[np.ndarray], np.ndarray]:
    """Mixture whose weights are broken off a stick, by variational Bayes from k-means; gives shares of each component.

    Priors: the data's mean with one row's weight, its covariance with as many degrees of
    freedom as columns.  Components that the data don't need shrink.
    """
    d = x.shape[1]
    own, _ = two_means(x, np.ones(len(x), bool), k)
    share, centre, wide = np.eye(k)[own], x.mean(axis=0), np.cov(x.T)
    for _ in range(rounds):
        n = share.sum(axis=0) + 1e-9
        mean = share.T @ x / n[:, None]
        held = 1 + n
        means = (centre + n[:, None] * mean) / held[:, None]
        freedom = d + n
        spread = np.stack([(wide + (share[:, j, None] * (x - mean[j])).T @ (x - mean[j]) + n[j] * 1e-6 * np.eye(d) + n[j] / held[j] * np.outer(mean[j] - centre, mean[j] - centre)) / freedom[j] for j in range(k)])
        one, rest = 1 + n, concentration + np.append(np.cumsum(n[::-1])[-2::-1], 0.0)
        total = digamma(one + rest)
        weight = digamma(one) - total + np.append(0.0, np.cumsum(digamma(rest) - total)[:-1])
        looser = sum(digamma(0.5 * (freedom - i)) for i in range(d)) + d * math.log(2) - d / held - d * np.log(freedom)

        def part(z: np.ndarray, weight=weight, looser=looser, means=means, spread=spread) -> np.ndarray:
            return _shares(np.stack([weight[j] + 0.5 * looser[j] + _log_normal(z, means[j], spread[j]) for j in range(k)], axis=1))

        new = part(x)
        if np.abs(new - share).max() < 1e-4:
            break
        share = new
    part.means = means
    return part


def calm_mixture(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    for h in hs:
        calm = _calm(b, h)
        x, train = _moves(b, h, calm)
        for k in (3, 4, 5) if train.sum() >= 100 else ():
            part = bayesian_mixture(x[train], k)
            share = part(x)
            up = part.means[:, 0].argmax()
            y = np.full(b.n, -1)
            y[calm] = (share.argmax(axis=1) == up) & (share[:, up] > 0.4)
            ones = y[(y >= 0) & b.train].mean()
            yield y, min(ones, 1 - ones) + 0.01 * min((y >= 0).sum() / 1000, 1)


def ward(x: np.ndarray, counts: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Centres of each of several numbers of clusters, from one chain of nearest neighbours.

    Ward's cost never falls as clusters merge, so the merges of the chain in order of cost
    are those of the greedy method; memory is linear in the rows.
    """
    n = alive = len(x)
    c, w = np.array(x, float), np.ones(n)
    slot, place = np.arange(n), np.arange(n)  # the living clusters are the first ``alive`` in c and w
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while alive > 1:
        if not chain:
            chain.append(int(slot[0]))
        while True:
            i = place[chain[-1]]
            cost = w[i] * w[:alive] / (w[i] + w[:alive]) * ((c[:alive] - c[i]) ** 2).sum(axis=1)
            cost[i] = np.inf
            j = int(cost.argmin())
            if len(chain) > 1 and cost[place[chain[-2]]] <= cost[j]:
                j = int(place[chain[-2]])
                break
            chain.append(int(slot[j]))
        one, other = chain.pop(), chain.pop()
        merges.append((float(cost[j]), one, other))
        i, j = place[one], place[other]
        c[i], w[i] = (w[i] * c[i] + w[j] * c[j]) / (w[i] + w[j]), w[i] + w[j]
        alive -= 1
        c[j], w[j], slot[j] = c[alive], w[alive], slot[alive]
        place[slot[j]] = j
    merges = [merges[m] for m in np.argsort([m[0] for m in merges], kind="stable")]
    root = np.arange(n)

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    found = {}
    for m in range(n):
        if n - m in counts:
            own = np.array([top(v) for v in range(n)])
            found[n - m] = np.array([x[own == r].mean(axis=0) for r in np.unique(own)])
        if m < len(merges):
            root[top(merges[m][2])] = top(merges[m][1])
    return found


def merged(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    for h in hs:
        calm = _calm(b, h)
        x = np.stack([b.forward(h), np.abs(b.forward(h))], axis=1)[calm]
        train = b.train[calm]
        found = ward(x[train], (2, 3, 4)) if train.sum() >= 100 else {}
        for _, centres in sorted(found.items()):
            own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            y = np.full(b.n, -1)
            y[calm] = own == centres[:, 0].argmax()
            yield (y,)


def penalised_path(cost: np.ndarray, jump: float) -> np.ndarray:
    """Cheapest sequence of states where each change costs ``jump``."""
    n, k = cost.shape
    total, came = cost[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        least = total.argmin()
        stay = total <= total[least] + jump
        came[i] = np.where(stay, np.arange(k), least)
        total = np.where(stay, total, total[least] + jump) + cost[i]
    out = np.empty(n, int)
    out[-1] = total.argmin()
    for i in range(n - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


def jumps(b: Bars, hs: tuple[int, ...] = (50, 100)) -> Iterator[Try]:
    """States of a k-means with a price on changes, decoded apart before and from TEST."""
    for h in hs:
        x = np.stack([b.forward(h), b.spread(h)], axis=1)
        ok = np.isfinite(x).all(axis=1)
        train, at = b.train[ok], np.flatnonzero(ok)
        if train.sum() < 100:
            continue
        z = (x[ok] - x[ok][train].mean(axis=0)) / (x[ok][train].std(axis=0) + 1e-9)
        base, cut = (z[train] ** 2).sum(axis=1).mean(), int((at < b.first_test()).sum())
        for k in (2, 3):
            for price in (0.0, 3 * base):
                centres = z[train][np.arange(k) * max(1, train.sum() // k)]
                for _ in range(6):
                    path = penalised_path(((z[:cut, None] - centres) ** 2).sum(axis=2), price)
                    centres = np.array([z[:cut][train[:cut] & (path == j)].mean(axis=0) if (train[:cut] & (path == j)).any() else centres[j] for j in range(k)])
                parts = [penalised_path(((p[:, None] - centres) ** 2).sum(axis=2), price) for p in (z[:cut], z[cut:]) if len(p)]
                state = np.full(b.n, -1)
                state[at] = np.concatenate(parts)
                yield (states(b, state, k, h),)


class GaussianChain:
    """Hidden Markov chain with Gaussian emissions, by expectation maximisation; ``full`` covariances or variances only."""

    def __init__(self, x: np.ndarray, k: int, sticky: float = 0.0, rounds: int = 15, full: bool = False):
        self.k, d = k, x.shape[1]
        self.means = np.tile(x.mean(axis=0), (k, 1))
        self.means[:, 0] = np.quantile(x[:, 0], (np.arange(k) + 0.5) / k)
        self.spread = np.tile(np.diag(x.var(axis=0) + 1e-9), (k, 1, 1))
        stay = sticky or 0.9
        self.turn = np.full((k, k), (1 - stay) / (k - 1)) + (stay - (1 - stay) / (k - 1)) * np.eye(k)
        self.start = np.full(k, 1 / k)
        for _ in range(rounds):
            share, pairs = self.shares(x, True)
            self.start, self.turn = share[0], pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1e-12)
            for j in range(k) if sticky else ():
                rest = np.delete(self.turn[j], j)
                if self.turn[j, j] < sticky:
                    rest = rest / rest.sum() * (1 - sticky) if rest.sum() > 0 else np.full(k - 1, (1 - sticky) / (k - 1))
                    self.turn[j] = np.insert(rest, j, sticky)
            weight = share.sum(axis=0) + 1e-12
            self.means = share.T @ x / weight[:, None]
            for j in range(k):
                off = x - self.means[j]
                both = (share[:, j, None] * off).T @ off / weight[j]
                self.spread[j] = (both if full else np.diag(np.diag(both))) + 1e-9 * np.eye(d)

    def _emit(self, x: np.ndarray) -> np.ndarray:
        logs = np.empty((len(x), self.k))
        for j in range(self.k):
            off = x - self.means[j]
            logs[:, j] = -0.5 * (((off @ np.linalg.inv(self.spread[j])) * off).sum(axis=1) + np.linalg.slogdet(2 * np.pi * self.spread[j])[1])
        return np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-300

    def filtered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, out, scale = self._emit(x), np.empty((len(x), self.k)), np.empty(len(x))
        now = self.start
        for i in range(len(x)):
            now = (now if i == 0 else now @ self.turn) * e[i]
            scale[i] = now.sum()
            now = out[i] = now / scale[i]
        return out, scale

    def shares(self, x: np.ndarray, pairs: bool = False):
        """Smoothed shares of the states; with the expected changes."""
        e, (ahead, scale) = self._emit(x), self.filtered(x)
        back = np.ones((len(x), self.k))
        for i in range(len(x) - 2, -1, -1):
            back[i] = self.turn @ (e[i + 1] * back[i + 1]) / scale[i + 1]
        share = ahead * back
        share /= share.sum(axis=1, keepdims=True)
        if not pairs:
            return share
        moved = (ahead[:-1] / scale[1:, None]).T @ (e[1:] * back[1:]) * self.turn
        return share, moved


def hidden_states(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    x = np.stack([b.lr, np.abs(b.lr)], axis=1)
    if b.train.sum() < 200:
        return
    state = GaussianChain(x[b.train], 3, rounds=100, full=True).filtered(x)[0].argmax(axis=1)
    for h in hs:
        yield (states(b, state, 3, h),)


def sticky_states(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    x, cut = np.stack([b.lr, np.abs(b.lr)], axis=1), b.first_test()
    if b.train.sum() < 300:
        return
    chain = GaussianChain(x[b.train], 3, 0.95)
    state = np.concatenate([chain.shares(p).argmax(axis=1) for p in (x[:cut], x[cut:]) if len(p)])
    for h in hs:
        yield (states(b, state, 3, h),)


def causal_mixture(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    """Mixture regimes of six causal features."""
    lc, lr = pd.Series(b.lc), pd.Series(b.lr)
    mom = lc.diff(20)
    x = np.stack([mom, lr.rolling(50).std(), lr.rolling(10).std() / (lr.rolling(100).std() + 1e-9), (mom - mom.rolling(100).mean()) / (mom.rolling(100).std() + 1e-12), lc - lc.rolling(50).mean(), lc.diff(5).abs()], axis=1)
    ok = np.isfinite(x).all(axis=1)
    if (ok & b.train).sum() < 200:
        return
    z = (x - x[ok & b.train].mean(axis=0)) / (x[ok & b.train].std(axis=0) + 1e-12)
    for k in (2, 3, 4):
        state = np.full(b.n, -1)
        state[ok] = gaussian_mixture(z[ok & b.train], k)(z[ok]).argmax(axis=1)
        for h in hs:
            yield (states(b, state, k, h, True, 20),)


def segments(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    """Sign of a slow average that restarts at change points; judged by VAL hits less a price for segments."""
    if b.train.sum() < 200 or b.lr[b.train].std() <= 0:
        return
    z = (b.lr - b.lr[b.train].mean()) / b.lr[b.train].std()
    slack = 0.1 * np.abs(z[b.train]).mean()

    def changes(x: np.ndarray, limit: float) -> list[int]:
        up = down = 0.0
        out = []
        for i, v in enumerate(x.tolist()):
            up, down = max(0.0, up + v - slack), min(0.0, down + v + slack)
            if up >= limit or -down >= limit:
                out.append(i)
                up = down = 0.0
        return out

    for wanted in (10, 20, 40):
        low, high = 0.5, 5_000.0
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if len(changes(z[b.train], middle)) + 1 > wanted else (low, middle)
        at = changes(z, (low + high) / 2)
        first = np.zeros(b.n, bool)
        first[[0, *(i + 1 for i in at if i + 1 < b.n)]] = True
        mean, sign = 0.0, np.zeros(b.n, int)
        for i, r in enumerate(b.lr.tolist()):
            mean = r if first[i] else 0.05 * r + 0.95 * mean
            sign[i] = mean > 0
        for h in hs:
            ahead = b.forward(h)
            y = np.where(np.isfinite(ahead), sign, -1)
            seen = (y >= 0) & b.val
            yield y, (y[seen] == (ahead[seen] > 0)).mean() - 0.0008 * (len(at) + 1) if seen.any() else -1


def smooth_slope(y: np.ndarray, level: float, slope: float, noise: float) -> tuple[np.ndarray, float]:
    """Smoothed slope of a local linear trend, and the log likelihood."""
    turn, extra = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([level, slope])
    x, p, kept, loss = np.array([y[0], 0.0]), 1e4 * np.eye(2), [], 0.0
    kept.append((x, p, x, p))
    for v in y[1:].tolist():
        xa, pa = turn @ x, turn @ p @ turn.T + extra
        s = pa[0, 0] + noise
        miss = v - xa[0]
        loss -= 0.5 * (math.log(2 * math.pi * s) + miss * miss / s)
        gain = pa[:, 0] / s
        x, p = xa + gain * miss, pa - np.outer(gain, pa[0])
        kept.append((x, p, xa, pa))
    out, later = np.empty(len(y)), x
    out[-1] = x[1]
    for i in range(len(y) - 2, -1, -1):
        x, p = kept[i][:2]
        xa, pa = kept[i + 1][2:]
        later = x + p @ turn.T @ np.linalg.solve(pa, later - xa)
        out[i] = later[1]
    return out, loss


def smoothed_trend(b: Bars) -> Iterator[Try]:
    if b.train.sum() < 300 or b.lr[b.train].var() <= 0:
        return
    noise, cut = float(b.lr[b.train].var()), b.first_test()
    grid = [(noise * a, noise * c) for a in (0.01, 1.0, 100.0) for c in (1e-6, 1e-4, 1e-2)]
    level, slope = max(grid, key=lambda g: smooth_slope(b.lc[b.train], *g, noise)[1])
    s = np.concatenate([smooth_slope(p, level, slope, noise)[0] if len(p) > 1 else np.full(len(p), np.nan) for p in (b.lc[:cut], b.lc[cut:])])
    for q in (0.4, 0.5, 0.6):
        yield (np.where(np.isfinite(s), (s >= np.quantile(s[b.train], q)).astype(int), -1),)


def run_lengths(x: np.ndarray, mean: float, var: float, hazard: float, most: int = 300) -> np.ndarray:
    """Probability at each step that a new regime has just begun (unknown mean and variance).

    most: the labeler's own bound of run lengths; longer runs than that are dropped from the belief.
    """
    gamma = np.vectorize(math.lgamma)
    mu, k, a, beta, logp = np.array([mean]), np.ones(1), np.ones(1), np.array([var]), np.zeros(1)
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        df, scale = 2 * a, np.maximum(beta * (k + 1) / (a * k), 1e-300)
        fit = gamma((df + 1) / 2) - gamma(df / 2) - 0.5 * np.log(df * math.pi * scale) - (df + 1) / 2 * np.log1p((v - mu) ** 2 / (df * scale))
        joint = logp + fit
        top = joint.max()
        fresh = top + math.log(np.exp(joint - top).sum() * hazard)
        new = np.append(fresh, joint + math.log1p(-hazard))[:most]
        new -= new.max() + math.log(np.exp(new - new.max()).sum())
        beta = np.append(var, beta + k * (v - mu) ** 2 / (2 * (k + 1)))[:most]
        mu, k, a = np.append(mean, (k * mu + v) / (k + 1))[:most], np.append(1.0, k + 1)[:most], np.append(1.0, a + 0.5)[:most]
        logp, out[i] = new, math.exp(new[0])
    return out


def break_ahead(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    if b.train.sum() < 300 or b.lr[b.train].std() <= 0:
        return
    for wanted in (10, 20, 40):
        p = run_lengths(b.lr, float(b.lr[b.train].mean()), float(b.lr[b.train].var()), wanted / b.train.sum())
        for h in hs:
            top = b.ahead(h, lambda w: w[:, 1:].max(axis=1), p)
            for q in (0.5, 0.6, 0.7):
                yield (np.where(np.isfinite(top), (top >= np.quantile(p[b.train], q)).astype(int), -1),)


def threshold_model(b: Bars, hs: tuple[int, ...] = (50, 100, 200)) -> Iterator[Try]:
    """Sign of a two-regime autoregressive forecast; judged by VAL hits less a price for lags."""
    if b.train.sum() < 200:
        return
    lagged = lambda k: np.concatenate([np.zeros(k), b.lr[:-k]])
    for d in (1, 2, 3):
        z = lagged(d)
        for p in (1, 2):
            x, warm = np.stack([np.ones(b.n), *map(lagged, range(1, p + 1))], axis=1), np.arange(b.n) >= max(d, p)
            fit, best = b.train & warm, None
            for c in np.quantile(z[fit], np.linspace(0.15, 0.85, 17)):
                low, high = fit & (z <= c), fit & (z > c)
                if min(low.sum(), high.sum()) >= p + 2:
                    made = [np.linalg.lstsq(x[s], b.lr[s], rcond=None)[0] for s in (low, high)]
                    loss = sum(((b.lr[s] - x[s] @ w) ** 2).sum() for s, w in zip((low, high), made, strict=True))
                    if best is None or loss < best[0]:
                        best = loss, c, made
            if best is None:
                continue
            y = np.where(warm, (np.where(z <= best[1], x @ best[2][0], x @ best[2][1]) > 0).astype(int), -1)
            for h in hs:
                ahead = b.forward(h)
                seen = b.val & np.isfinite(ahead) & (y >= 0)
                if seen.sum() >= 20:
                    yield y, (y[seen] == (ahead[seen] > 0)).mean() - 0.02 * p


def return_shapes(b: Bars, hs: tuple[int, ...] = (60, 120)) -> Iterator[Try]:
    """Regimes of sorted returns ahead, by k-medians under the mean absolute difference."""
    for h in hs:
        if b.n <= h + 2:
            continue
        x = np.sort(np.lib.stride_tricks.sliding_window_view(b.lr, h)[1:-1], axis=1)
        train = b.train[: len(x)]
        if train.sum() < 200:
            continue
        fit = x[train]
        if len(fit) > 2_500:  # the labeler's own bound of windows to fit
            fit = fit[np.random.RandomState(42).choice(len(fit), 2_500, replace=False)]
        for k in (2, 3):
            order = fit.mean(axis=1).argsort()
            centres = fit[order[((np.arange(k) + 0.5) / k * (len(order) - 1)).astype(int)]]
            for _ in range(8):
                own = np.stack([np.abs(fit - c).mean(axis=1) for c in centres]).argmin(axis=0)
                centres = np.array([np.median(fit[own == j], axis=0) if (own == j).any() else centres[j] for j in range(k)])
            state = np.full(b.n, -1)
            state[: len(x)] = np.stack([np.abs(x - c).mean(axis=1) for c in centres]).argmin(axis=0)
            yield (states(b, state, k, h, True, 20),)


def law_mixture(z: np.ndarray, y: np.ndarray, k: int, rounds: int = 12):
    """Mixture of linear laws with a softmax gate: function to (law by fit, law by gate), and law shares."""
    x = np.column_stack([z, np.ones(len(z))])
    share = np.eye(k)[two_means(np.column_stack([y, z]), np.ones(len(y), bool), k)[0]] * 0.8 + 0.2 / k
    gate = np.zeros((x.shape[1], k))
    for _ in range(rounds):
        law = np.stack([np.linalg.solve((x * share[:, j, None]).T @ x + 1e-6 * np.eye(x.shape[1]), (x * share[:, j, None]).T @ y) for j in range(k)])
        var = np.array([(share[:, j] * (y - x @ law[j]) ** 2).sum() / (share[:, j].sum() + 1e-9) + 1e-12 for j in range(k)])
        for _ in range(20):
            e = np.exp(x @ gate - (x @ gate).max(axis=1, keepdims=True))
            gate += 0.5 * x.T @ (share - e / e.sum(axis=1, keepdims=True)) / len(x)

        def logs(x: np.ndarray, y: np.ndarray, law=law, var=var, gate=gate.copy()) -> tuple[np.ndarray, np.ndarray]:
            g = x @ gate
            g = g - g.max(axis=1, keepdims=True)
            g = g - np.log(np.exp(g).sum(axis=1, keepdims=True))
            return g - 0.5 * ((y[:, None] - x @ law.T) ** 2 / var + np.log(var)), g

        both = logs(x, y)[0]
        share = np.exp(both - both.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)

    def assign(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit, g = logs(np.column_stack([z, np.ones(len(z))]), y)
        return fit.argmax(axis=1), g.argmax(axis=1)

    return assign, share


def laws(b: Bars, hs: tuple[int, ...] = (60, 120)) -> Iterator[Try]:
    """Sign of the law a bar follows, where its gate agrees."""
    past = pd.Series(b.lr)
    for back in (30, 60):
        size = past.abs().rolling(back).sum().shift(1)
        x = np.stack([past.rolling(back).mean().shift(1), past.rolling(back).std(ddof=0).shift(1), (pd.Series(b.lc).shift(1) - pd.Series(b.lc).shift(back)).abs() / size], axis=1)
        for h in hs:
            ahead = b.forward(h)
            ok = np.isfinite(x).all(axis=1) & np.isfinite(ahead)
            train = ok & b.train
            if train.sum() < 300:
                continue
            z = (x - x[train].mean(axis=0)) / (x[train].std(axis=0) + 1e-12)
            for k in (2, 3):
                assign, share = law_mixture(z[train], ahead[train], k)
                means = (share * ahead[train][:, None]).sum(axis=0) / (share.sum(axis=0) + 1e-9)
                fit, gate = assign(z[ok], ahead[ok])
                keep = (fit == gate) & (np.abs(means[fit]) > 0.05 * ahead[train].std())
                y = np.full(b.n, -1)
                y[np.flatnonzero(ok)[keep]] = (means[fit] > 0)[keep]
                yield y, float((fit == gate)[b.train[ok]].mean())


#: Tries, gates (least TRAIN and VAL, share of ones), reach.
KERNELS: dict[str, tuple[Callable[[Bars], Iterator[Try]], dict, int]] = {
    "triple_barrier": (barriers(2.0), {}, 200),
    "triple_barrier_tight": (barriers(1.5), {}, 200),
    "triple_barrier_meta": (barriers(2.0), {}, 200),
    "triple_barrier_tight_meta": (barriers(1.5), {}, 200),
    "triple_barrier_ae": (barriers(2.0), {}, 200),
    "survival_aft": (lambda b: iter([(time_to_rise(b)[0],)]), {"least": (0, 0), "share": (-1, 2)}, 200),
    "dp_oracle": (best_action, {"least": (200, 0), "share": (-1, 2)}, 200),
    "kmeans2stage": (two_stage, {"least": (0, 30), "judged": "val"}, 200),
    "bgm": (calm_mixture, {}, 200),
    "jump_model": (jumps, {}, 100),
    "agglomerative": (merged, {}, 200),
    "hmm": (hidden_states, {}, 200),
    "sticky_hmm": (sticky_states, {}, 200),
    "regime_gmm": (causal_mixture, {"least": (200, 20)}, 200),
    "cusum_regime": (segments, {"least": (200, 20)}, 200),
    "dc_reversal": (reversal_ahead, {"least": (0, 0), "share": (0.25, 0.75)}, 200),
    "dc_trend": (trend_now, {"least": (0, 0), "share": (0.25, 0.75)}, 0),
    "trend_leg": (legs((40, 80)), {}, 80),
    "tleg_fast": (legs((20,)), {}, 20),
    "tleg_mid": (legs((60,)), {}, 60),
    "tleg_slow": (legs((150,)), {}, 150),
    "ofsc": (sign_memory, {}, 200),
    "bde_cusum": (by_statistic((100, 200), (0.5, 0.6, 0.7), recursive_break), {}, 200),
    "changepoint": (by_statistic((40, 80, 150), (0.5, 0.6, 0.7), mean_shift), {}, 150),
    "calmar_scan": (by_statistic((40, 80), (0.4, 0.5, 0.6, 0.7), calmar), {}, 80),
    "dd_excursion": (excursion, {}, 80),
    "sadf_explosive": (by_statistic((100, 200), (0.5, 0.7, 0.85), explosive), {}, 200),
    "hurst_persist": (by_statistic((80, 160), (0.4, 0.5, 0.6), persistence), {}, 160),
    "sliced_wasserstein": (return_shapes, {}, 120),
    "transfer_entropy_dir": (information_flow, {}, 200),
    "visgraph": (visibility, {}, 161),
    "kllt": (smoothed_trend, {"share": (0.1, 0.9)}, 0),
    "icss_var": (by_statistic((60, 120, 200), (0.5, 0.6, 0.7), variance_break), {}, 200),
    "bocpd_label": (break_ahead, {}, 200),
    "setar": (threshold_model, {"least": (100, 0)}, 0),
    "tlb_reversal": (line_break, {"least": (100, 0), "share": (0.15, 0.85)}, 200),
    "moe_law": (laws, {}, 120),
}


def sweeps(name: str) -> bool:
    """Whether the labeler looks ahead over horizons that can be given."""
    return "hs" in inspect.signature(KERNELS[name][0]).parameters


def build(bars: DataFrame, name: str, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """key, bar_ix, y of the named labeler; horizons: bars ahead instead of its own."""
    tries, gates, _ = KERNELS[name]
    if horizons is not None and not sweeps(name):
        raise ValueError(f"labeler {name!r} has no horizons")
    own = {} if horizons is None else {"hs": tuple(horizons)}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_ix")
        b = Bars(part)
        out = part[["key", "bar_ix"]].copy()
        with np.errstate(all="ignore"):
            out["y"] = choose(b, tries(b, **own), **gates).astype("int32")
        return out

    return bars.select("key", "bar_ix", "lc", "lr", "split").groupBy("key").applyInPandas(run, "key string, bar_ix long, y int")


def survival_bounds(bars: DataFrame) -> DataFrame:
    """key, bar_ix, lower, upper, censored of the time until the price has risen."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_ix")
        y, low, high = time_to_rise(Bars(part))
        out = part[["key", "bar_ix"]].assign(lower=low, upper=high, censored=y == 0)
        return out[y >= 0]

    return bars.select("key", "bar_ix", "lc", "lr", "split").groupBy("key").applyInPandas(run, "key string, bar_ix long, lower double, upper double, censored boolean")
