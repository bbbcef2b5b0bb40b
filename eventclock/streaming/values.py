"""Values of ticks, one after the other: what the window expressions of an axis give, kept as state.

``of`` gets time, close, volume, log price and the return within the chain (None behind
an invalid tick) and gives the value that the axis' clock reads, or None.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable, Iterable

import numpy as np


class Simple:
    """A value of the tick alone."""

    def __init__(self, f: Callable):
        self.f = f

    def of(self, ts, c: float, v: float, lc: float, r: float | None):
        return self.f(c, v, lc, r)


def _dollar(c, v, lc, r):
    return c * v


def _logdollar(c, v, lc, r):
    return math.log(1 + c * v)


def _vol(c, v, lc, r):
    return None if r is None else r * r * math.sqrt(v)


def _kyle(c, v, lc, r):
    return None if r is None else abs(r) / math.sqrt(v)


def _amihud(c, v, lc, r):
    return None if r is None else abs(r) / (c * v) * 1e9


def _fall(c, v, lc, r):
    return None if r is None else (r * r if r < 0 else 0.0)


def _signed(c, v, lc, r):
    return None if r is None else r * abs(r)


def _close(c, v, lc, r):
    return c


def _level(c, v, lc, r):
    return lc


def _move(c, v, lc, r):
    return r


def _one(c, v, lc, r):
    return 1


class Flow:
    """The sign of the last move that was not flat, times price and volume as asked for."""

    def __init__(self, price: bool, volume: bool):
        self.price, self.volume, self.sign = price, volume, None

    def of(self, ts, c, v, lc, r):
        if r:
            self.sign = math.copysign(1.0, r)
        if r is None:
            return None
        x = 1.0 if self.sign is None else self.sign
        x = x * c if self.price else x
        return x * v if self.volume else x


class Surge:
    """How many deviations the log of notional lies above its mean of ``span`` ticks."""

    def __init__(self, span: int = 1950, least: int = 30):
        self.recent, self.least = deque(maxlen=span), least

    def of(self, ts, c, v, lc, r):
        u = math.log(c * v)
        self.recent.append(u)
        if len(self.recent) < self.least:
            return None
        x = np.array(self.recent)
        var = float(x.var())
        return (u - float(x.mean())) / math.sqrt(var) if var > 1e-18 else None


class Moves:
    """The return, and the return over ``span`` ticks."""

    def __init__(self, span: int = 20):
        self.recent = deque(maxlen=span + 1)

    def of(self, ts, c, v, lc, r):
        self.recent.append(lc)
        return None if len(self.recent) < self.recent.maxlen or r is None else (r, lc - self.recent[0])


def _phi(x: float) -> float:
    # fixed values of the approximation (Abramowitz and Stegun 7.1.26)
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    z = abs(x) / math.sqrt(2)
    t = 1 / (1 + p * z)
    erf = 1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * math.exp(-z * z)
    return 0.5 * (1 + (erf if x >= 0 else -erf))


class Informed:
    """The part of the volume that a move beyond the usual stands for."""

    def __init__(self, span: int = 240, least: int = 20):
        self.recent, self.least = deque(maxlen=span), least

    def of(self, ts, c, v, lc, r):
        self.recent.append(r)
        known = [x for x in self.recent if x is not None]
        if r is None or len(known) < self.least:
            return None
        spread = math.sqrt(sum(x * x for x in known) / len(known))
        return v * abs(2 * _phi(r / spread) - 1) if spread > 0 else None


class _Products:
    """Products of neighbouring moves in the chain; a mean of the last ones, behind the tick or with it."""

    def __init__(self, span: int, least: int = 20):
        self.recent, self.least, self.last = deque(maxlen=span), least, None

    def add(self, r) -> None:
        if r is None:
            self.recent.clear()
        self.recent.append(None if r is None or self.last is None else abs(r * self.last))
        self.last = r

    def mean(self) -> float | None:
        known = [x for x in self.recent if x is not None]
        if len(known) < self.least:
            return None
        m = math.pi / 2 * (sum(known) / len(known))
        return m if m > 0 else None


class Jump:
    """Size of a move by the usual size of the moves before it."""

    def __init__(self):
        self.products = _Products(60)

    def of(self, ts, c, v, lc, r):
        if r is None:
            self.products.add(r)
            return None
        usual = self.products.mean()
        self.products.add(r)
        return None if usual is None else abs(r) / math.sqrt(usual)


class Unsteady:
    """Change of the log of the usual size of moves."""

    def __init__(self):
        self.products, self.last = _Products(60), None

    def of(self, ts, c, v, lc, r):
        self.products.add(r)
        usual = self.products.mean()
        now, before = None if usual is None else math.log(usual), None if r is None else self.last
        self.last = now
        return None if now is None or before is None else abs(now - before)


class Detail:
    """Squared detail of the third level of a causal transform by means."""

    def __init__(self):
        self.first, self.last, self.one, self.two = None, None, deque(maxlen=2), deque(maxlen=4)

    def of(self, ts, c, v, lc, r):
        if self.first is None:
            self.first = self.last = lc
        s1 = (lc + self.last) / 2
        s2 = (s1 + (self.one[0] if len(self.one) == 2 else self.first)) / 2
        s3 = (s2 + (self.two[0] if len(self.two) == 4 else self.first)) / 2
        self.last = lc
        self.one.append(s1)
        self.two.append(s2)
        return (s2 - s3) * (s2 - s3)


class Deeper:
    """By how much the fall from the chain's highest price grew."""

    def __init__(self):
        self.top, self.fall = -math.inf, 0.0

    def of(self, ts, c, v, lc, r):
        if r is None:
            self.top, self.fall = -math.inf, 0.0
        self.top = max(self.top, lc)
        now, before = self.top - lc, self.fall
        self.fall = now
        return None if r is None else max(0.0, now - before)


class Range:
    """Spread of blocks by close, high and low, at a block's last tick."""

    def __init__(self, size: int = 30):
        self.size, self.block, self.close, self.middle = size, [], None, None

    def of(self, ts, c, v, lc, r):
        self.block.append(lc)
        if len(self.block) < self.size:
            return None
        middle, x = (max(self.block) + min(self.block)) / 2, None
        if self.close is not None:
            x = math.sqrt(4 * max(0.0, (self.close - self.middle) * (self.close - middle)))
        self.close, self.middle, self.block = lc, middle, []
        return x


class Unusual:
    """Squared move by the usual one of its minute; profile: by minute of the day, None for others."""

    def __init__(self, profile: dict):
        self.profile = profile

    def of(self, ts, c, v, lc, r):
        usual = self.profile.get(ts.hour * 60 + ts.minute, self.profile.get(None))
        return None if r is None or not usual else (r / usual) * (r / usual)


class Session:
    """One at a day's first tick of each band, else zero."""

    def __init__(self):
        self.last = None

    def of(self, ts, c, v, lc, r):
        minute = ts.hour * 60 + ts.minute
        band = 2 if minute >= 960 else 1 if minute >= 930 else 0
        now, before = (ts.date(), band), self.last
        self.last = now
        return 1 if band and now != before else 0


class Overnight:
    """Squared move, weighted where it spans days."""

    def __init__(self, weight: float):
        self.weight, self.day = weight, None

    def of(self, ts, c, v, lc, r):
        same, self.day = ts.date() == self.day, ts.date()
        return None if r is None else r * r * (1.0 if same else self.weight)


class Patterns:
    """Entropy of the order patterns of the last ticks; change: how far it moved."""

    def __init__(self, change: bool, span: int = 60):
        self.change, self.span, self.levels, self.seen, self.last = change, span, deque(maxlen=3), deque(maxlen=span), None

    def of(self, ts, c, v, lc, r):
        if r is None:
            self.levels.clear()
        self.levels.append(lc)
        self.seen.append(self._pattern() if len(self.levels) == 3 else None)
        now, before = self._entropy(), None if r is None else self.last
        self.last = now
        if not self.change:
            return now
        return None if now is None or before is None else round(abs(now - before), 9)

    def _pattern(self) -> int:
        a, b, c = self.levels
        if a <= b:
            return 0 if b <= c else 1 if a <= c else 2
        if b <= c:
            return 3 if a <= c else 4
        return 5

    def _entropy(self) -> float | None:
        if len(self.seen) < self.span or None in self.seen:
            return None
        counts, total = Counter(self.seen), 0.0
        for k in range(6):
            total += counts[k] / self.span * math.log(counts[k] / self.span) if counts[k] else 0.0
        return -total / math.log(6)


class Word:
    """How new the coarse shape of the last 16 moves is."""

    def __init__(self):
        self.recent, self.seen = deque(maxlen=16), Counter()

    def of(self, ts, c, v, lc, r):
        if r is None:
            self.recent.clear()
        else:
            self.recent.append(r)
        if r is None or len(self.recent) < 16:
            return None
        x = np.array(self.recent)
        mean, spread = float(x.mean()), float(x.std())
        if spread <= 0:
            return None
        # fixed values: quarters of the normal distribution
        word = sum(4**k * sum((float(x[4 * k : 4 * k + 4].mean()) - mean) / spread >= q for q in (-0.6745, 0.0, 0.6745)) for k in range(4))
        self.seen[word] += 1
        return 1 / math.sqrt(self.seen[word])


#: Makes the values of an axis; ``diurnal`` and ``gapflow`` need what TRAIN gave.
VALUES: dict[str, Callable] = {
    "dollar": lambda: Simple(_dollar),
    "tick": lambda: Simple(_one),
    "vol": lambda: Simple(_vol),
    "range": lambda: Simple(_close),
    "logdollar": lambda: Simple(_logdollar),
    "entropy": lambda: Simple(_move),
    "imbalance": lambda: Flow(True, True),
    "tickimb": lambda: Flow(False, False),
    "volumeimb": lambda: Flow(False, True),
    "fracdiff": lambda: Simple(_level),
    "dc": lambda: Simple(_level),
    "zcusum": Surge,
    "vratio": Moves,
    "kyle": lambda: Simple(_kyle),
    "run": lambda: Simple(_move),
    "spectral": lambda: Simple(_level),
    "vpin": Informed,
    "jump": Jump,
    "volofvol": Unsteady,
    "wavelet": Detail,
    "amihud": lambda: Simple(_amihud),
    "ddonset": Deeper,
    "semivar": lambda: Simple(_fall),
    "chl": Range,
    "diurnal": Unusual,
    "kalman": lambda: Simple(_level),
    "newma": lambda: Simple(_move),
    "signedjumpvar": lambda: Simple(_signed),
    "logdollar_rc": lambda: Simple(_logdollar),
    "sess2": Session,
    "gapflow": Overnight,
    "permclock": lambda: Patterns(True),
    "mpnov": Word,
    "pecusum": lambda: Patterns(False),
    "calmonset": lambda: Patterns(False),
}


def over(value, ticks: Iterable[tuple]) -> list:
    """Values of ticks (ts, close, volume, log price, return)."""
    return [value.of(*t) for t in ticks]
