"""Bars from a stream of ticks, by the values and clocks that batch jobs use.

What TRAIN fits is frozen first (``frozen``): a clock for each key, and where an axis
needs it a profile or a weight.  Each key's state is its clock, what its values remember
and the number of bars so far.  Duplicates within the watermark are dropped; rows of one
micro-batch are put in order before the clock reads them; a tick that is not after the
last one read is late and is counted, not used.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventclock.functions.dialect import render, steps
from eventclock.operators import clocks
from eventclock.operators.axes import AXES, PER_BAR, axes_for, fitted, valid
from eventclock.streaming.values import VALUES


@dataclass
class OnlineAxis:
    """One key of one axis: ``update`` gives (bar_ix, log price) when a bar ends."""

    clock: object
    value: object
    guard: str
    last: float | None = None
    bars: int = 0
    late: int = 0
    seen: tuple = ()

    def update(self, ts, seq: int, close: float, volume: float) -> tuple[int, float] | None:
        if self.seen and (ts, seq) <= self.seen:
            self.late += 1
            return None
        self.seen = (ts, seq)
        if not close > 0 or self.guard.endswith("v") and not volume > 0:
            if self.guard[0] == "!":
                self.last = None
            return None
        lc = math.log(close)
        x = self.value.of(ts, close, volume, lc, None if self.last is None else lc - self.last)
        self.last = lc
        if x is None or not self.clock.step(x):
            return None
        self.bars += 1
        return self.bars - 1, lc


def start(name: str, clock, extra=None) -> OnlineAxis:
    """clock: a clock that TRAIN fitted, or its threshold; extra: the profile or weight of an axis that has one."""
    if name not in VALUES:
        raise ValueError(f"axis {name!r} has no online form")
    made = clock if hasattr(clock, "step") else _clock(name, float(clock), PER_BAR)
    return OnlineAxis(pickle.loads(pickle.dumps(made)), VALUES[name](*([] if extra is None else [extra])), AXES[name].guard)


def _clock(name: str, threshold: float, per_bar: int):
    axis = axes_for(per_bar)[name]
    if axis.clock:
        return axis.clock(threshold)
    return clocks.Above(threshold) if name == "jump" else clocks.Reset(threshold)


def frozen(ticks: DataFrame, name: str, train_end: str, per_bar: int = PER_BAR) -> dict[str, OnlineAxis]:
    """An axis at its start for each key with TRAIN ticks: what TRAIN fits, a few numbers a key."""
    axis = axes_for(per_bar)[name]
    if name in ("tick", "sess2"):
        keys = [r.key for r in ticks.where(F.col("ts") < F.lit(train_end).cast("timestamp_ntz")).select("key").distinct().collect()]
        return {k: start(name, float(per_bar if name == "tick" else 1)) for k in keys}
    rows = steps(valid(ticks, axis.guard, train_end), *axis.columns).where("is_train")
    if axis.fit is None:
        found = rows.groupBy("key").agg(F.expr(render(axis.threshold)).cast("double").alias("t")).where("t IS NOT NULL").collect()
        made = {r.key: _clock(name, r.t, per_bar) for r in found}
    else:
        column = "r" if name == "entropy" else "x"
        value = F.array("x", "q") if name == "vratio" else F.col(column)

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            values = part.sort_values(["ts", "seq"])["v"].tolist()
            return pd.DataFrame({"key": part["key"].iloc[:1], "clock": [pickle.dumps(fitted(axis, values, per_bar))]})

        sent = rows.where(F.col(column).isNotNull()).select("key", "ts", "seq", value.alias("v"))
        made = {r.key: pickle.loads(r.clock) for r in sent.groupBy("key").applyInPandas(fit, "key string, clock binary").collect()}
    extras = _extras(rows, name)
    return {k: start(name, c, extras.get(k)) for k, c in made.items()}


def _extras(rows: DataFrame, name: str) -> dict:
    """By key: the usual move of each minute (``diurnal``), the weight of a move over days (``gapflow``)."""
    if name == "diurnal":
        found: dict = {}
        for r in rows.groupBy("key", "mod").agg(F.max("pf").alias("pf"), F.max("pg").alias("pg")).collect():  # minutes of a day
            found.setdefault(r.key, {None: r.pg})[r.mod] = r.pf
        return found
    if name == "gapflow":
        weight = F.least(F.lit(500.0), F.greatest(F.lit(1.0), F.coalesce(F.max("ki") / F.when(F.max("kg") != 0, F.max("kg")), F.lit(1.0))))
        return {r.key: r.w for r in rows.groupBy("key").agg(weight.alias("w")).collect()}
    return {}


OUTPUT = "key string, bar_ix long, ts timestamp, log_close double, late long"
STATE = "axis binary"


def bars(ticks: DataFrame, axes: dict[str, OnlineAxis], watermark: str = "10 minutes") -> DataFrame:
    """Bars of a streaming DataFrame with key, ts (timestamp), seq, close, volume.

    axes: frozen axes by key (``frozen``); keys without one give no bars.
    """
    first = {k: pickle.dumps(a) for k, a in axes.items()}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] not in first:
            return
        axis = pickle.loads(state.get[0] if state.exists else first[key[0]])
        rows = pd.concat(parts).sort_values(["ts", "seq"])
        out = []
        for ts, seq, close, volume in zip(rows["ts"], rows["seq"], rows["close"], rows["volume"], strict=True):
            bar = axis.update(ts, int(seq), float(close), float(volume))
            if bar:
                out.append((key[0], bar[0], ts, round(bar[1], 9), axis.late))
        state.update((pickle.dumps(axis),))
        if out:
            yield pd.DataFrame(out, columns=["key", "bar_ix", "ts", "log_close", "late"])

    clean = ticks.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["key", "ts", "seq"])
    return clean.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(ticks: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and volume of fixed time windows; rows behind the watermark are dropped."""
    by = ticks.withWatermark("ts", watermark).groupBy("key", F.window("ts", width))
    order = F.struct("ts", "seq")
    out = by.agg(F.min_by("close", order).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))
    return out.select("key", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Ticks and volume of each stretch without a gap."""
    by = ticks.withWatermark("ts", watermark).groupBy("key", F.session_window("ts", gap))
    return by.agg(F.count(F.lit(1)).alias("ticks"), F.sum("volume").alias("volume")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "ticks", "volume")
