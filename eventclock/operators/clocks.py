"""Clocks: small machines that read one value a tick and say when a bar ends.

A machine's state is its attributes; the same machine serves batch jobs and streams.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import deque
from functools import reduce
from operator import add


class Reset:
    """Sums values, a bar ends when the sum reaches the threshold; the rest is discarded."""

    def __init__(self, threshold: float):
        self.threshold, self.total = threshold, 0.0

    def size(self, total: float) -> float:
        return total

    def step(self, x: float) -> bool:
        self.total += x
        if self.size(self.total) >= self.threshold:
            self.total = self.rest()
            return True
        return False

    def rest(self) -> float:
        return 0.0


class Surprise(Reset):
    """As Reset, over the surprise of the range that a value lies in."""

    def __init__(self, threshold: float, edges: list[float], table: list[float]):
        super().__init__(threshold)
        self.edges, self.table = edges, table

    def step(self, x: float) -> bool:
        return super().step(self.table[bisect_right(self.edges, x)])


class AbsReset(Reset):
    """As Reset, by the size of a signed sum."""

    def size(self, total: float) -> float:
        return abs(total)


class Carry(Reset):
    """As Reset, but what exceeds the threshold is kept; one bar a tick at most."""

    def rest(self) -> float:
        return self.total - self.threshold


class TwoSided:
    """Cumulative sums of rises and of falls, each held above zero; both restart at a bar."""

    def __init__(self, threshold: float, falls_only: bool = False):
        self.threshold, self.falls_only, self.up, self.down = threshold, falls_only, 0.0, 0.0

    def step(self, x: float) -> bool:
        self.up, self.down = max(0.0, self.up + x), max(0.0, self.down - x)
        if self.down >= self.threshold or not self.falls_only and self.up >= self.threshold:
            self.up = self.down = 0.0
            return True
        return False


class Distance:
    """A bar ends when the price has moved by a share of the last bar's price."""

    def __init__(self, threshold: float):
        self.threshold, self.anchor = threshold, None

    def step(self, close: float) -> bool:
        if self.anchor is None:
            self.anchor = close
            return False
        if abs(close / self.anchor - 1) >= self.threshold:
            self.anchor = close
            return True
        return False


class Reversal:
    """A bar ends when the log price comes back by the threshold from the trend's extreme."""

    def __init__(self, threshold: float):
        self.threshold, self.trend, self.extreme = threshold, 1, None

    def step(self, lc: float) -> bool:
        if self.extreme is None:
            self.extreme = lc
            return False
        ahead = (lc - self.extreme) * self.trend
        if ahead > 0:
            self.extreme = lc
        elif -ahead >= self.threshold:
            self.trend, self.extreme = -self.trend, lc
            return True
        return False


class Run:
    """Sums moves of one direction; a turn starts afresh, flat moves keep the direction."""

    def __init__(self, threshold: float):
        self.threshold, self.total, self.sign = threshold, 0.0, 0

    def step(self, move: float) -> bool:
        sign = (move > 0) - (move < 0) or self.sign
        turned = sign != self.sign and self.sign != 0
        self.total = abs(move) + (0.0 if turned else self.total)
        self.sign = sign
        if self.total >= self.threshold:
            self.total = 0.0
            return True
        return False


class Cycle:
    """A bar ends where a band-pass filter of the log price crosses zero; threshold: the fast span."""

    def __init__(self, span: float):
        self.rates = 2 / (span + 1), 2 / (4 * span + 1)
        self.fast = self.slow = None
        self.last = 0.0

    def step(self, lc: float) -> bool:
        if self.fast is None:
            self.fast = self.slow = lc
            return False
        self.fast += self.rates[0] * (lc - self.fast)
        self.slow += self.rates[1] * (lc - self.slow)
        now, before = self.fast - self.slow, self.last
        self.last = now
        return before != 0.0 and now * before < 0


class VarianceRatio(Reset):
    """Sums how far the ratio of long-move to short-move variance is from one; moves: (1 tick, q ticks)."""

    RATE, LONG = 0.02, 20

    def __init__(self, threshold: float):
        super().__init__(threshold)
        self.short = self.long = None

    def off(self, moves: tuple[float, float]) -> float | None:
        a, b = moves[0] ** 2, moves[1] ** 2
        if self.short is None:
            self.short, self.long = a, b
        else:
            self.short += self.RATE * (a - self.short)
            self.long += self.RATE * (b - self.long)
        return None if self.short <= 1e-18 else abs(self.long / (self.LONG * self.short) - 1)

    def step(self, moves: tuple[float, float]) -> bool:
        x = self.off(moves)
        return x is not None and super().step(x)


class Complexity(TwoSided):
    """TwoSided over the distance of a complexity measure from its slow average."""

    RATE = 0.01

    def __init__(self, threshold: float, falls_only: bool = False):
        super().__init__(threshold, falls_only)
        self.base = None

    def step(self, x: float) -> bool:
        if self.base is None:
            self.base = x
            return False
        off = x - self.base
        self.base += self.RATE * off
        return super().step(off)


class CalmOnset(Complexity):
    def __init__(self, threshold: float):
        super().__init__(threshold, True)


class Recalibrated(Reset):
    """As Reset; at each bar the threshold becomes ticks a bar times the trailing mean."""

    def __init__(self, threshold: float, per_bar: float, window: int = 23_400, least: int = 2_340):
        super().__init__(threshold)
        self.per_bar, self.least, self.recent, self.seen = per_bar, least, deque(maxlen=window), 0

    def step(self, x: float) -> bool:
        self.recent.append(x)
        self.seen += 1
        done = super().step(x)
        if done and (n := len(self.recent)) >= self.least:
            self.threshold = self.per_bar * (blocked_sum(list(self.recent), self.seen - n) / n)
        return done


def blocked_sum(values: list[float], at: int, size: int = 16) -> float:
    """Sum of values, the first being number ``at`` of a series; whole blocks of the series are added up first, then blocks of blocks.

    A sum that is carried along drifts.  These blocks are those of the checking engine's windows: over
    equal values a bar's sum just reaches the threshold, and the last bit says whether it ends there.
    """
    left, right = [], []
    while at // size != (end := at + len(values)) // size:
        first, last = -at % size, len(values) - end % size
        left, right = left + values[:first], values[last:] + right
        values = [reduce(add, values[i : i + size]) for i in range(first, last, size)]
        at = (at + first) // size
    return reduce(add, left + values + right, 0.0)  # sum() would round otherwise


class Slope:
    """Local linear trend with fixed gains; a bar ends when the slope's strength rises to the threshold."""

    def __init__(self, threshold: float, gain_level: float, gain_slope: float, noise: float):
        self.threshold, self.gains, self.noise = threshold, (gain_level, gain_slope), noise
        self.level, self.slope, self.armed = None, 0.0, True

    def strength(self, lc: float) -> float | None:
        if self.level is None:
            self.level = lc
            return None
        miss = lc - self.level - self.slope
        self.level += self.slope + self.gains[0] * miss
        self.slope += self.gains[1] * miss
        return abs(self.slope / self.noise)

    def step(self, lc: float) -> bool:
        z = self.strength(lc)
        if z is None:
            return False
        done = self.armed and z >= self.threshold
        self.armed = z < self.threshold / 2 or self.armed and not done
        return done


def rises(strengths: list[float], threshold: float) -> int:
    """Times that a strength rises to the threshold after it was below half of it."""
    n, armed = 0, True
    for z in strengths:
        if armed and z >= threshold:
            armed, n = False, n + 1
        if z < threshold / 2:
            armed = True
    return n


class Above:
    """Each value of the threshold or more ends a bar."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def step(self, x: float) -> bool:
        return x >= self.threshold


class Edge:
    """A bar ends when a statistic rises to the threshold from below."""

    def __init__(self, threshold: float):
        self.threshold, self.before = threshold, 0.0

    def step(self, x: float) -> bool:
        done = x >= self.threshold > self.before
        self.before = x
        return done


def bisect(machine, values: list, wanted: float, low: float, high: float, rounds: int, geometric: bool = True) -> float:
    """Threshold at which a machine ends ``wanted`` bars over the values."""
    for _ in range(rounds):
        middle = math.sqrt(low * high) if geometric else (low + high) / 2
        clock = machine(middle)
        if sum(map(clock.step, values)) > wanted:
            low = middle
        else:
            high = middle
    return math.sqrt(low * high) if geometric else (low + high) / 2
