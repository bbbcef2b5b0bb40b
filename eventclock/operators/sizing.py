"""Position sizes from calibrated probabilities, as expressions and windows.

Input: key, bar_ix, ts, seq, p (probability), lc, lr.  A size at a bar sees returns up to
the bar before only.  ``aim_*`` sizes move towards their target by a fixed share of the
way and the dead-band replay keeps the executed size; both are folds over a key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.functions.dialect import frame, phi, steps, steps_sql

FAST, SLOW = 10, 60
_slow, _fast = frame(SLOW, -1), frame(FAST, -1)
O = "(PARTITION BY key ORDER BY ts, seq)"

#: What all sizes use: the clipped probability, and the returns before the bar.
BASE = (
    {"q": "least(greatest(p, 1e-6), 1 - 1e-6)", "m": f"count(lr) OVER {_slow}"},
    {
        "sf": f"stddev_pop(lr) OVER {_fast}",
        "ss": f"stddev_pop(lr) OVER {_slow}",
        "dd": f"lag(lc) OVER {O} - max(lc) OVER {_slow}",
    },
    {"frac": f"CASE WHEN m >= {FAST + 2} AND 3 * ss * sqrt(m) > 1e-9 THEN 1 + dd / (3 * ss * sqrt(m)) ELSE 1.0 END"},
)


def _bet(level: str) -> str:
    """Normal distribution bet: how far the probability lies above the level."""
    z = f"((q - {level}) / sqrt(q * (1 - q)))"
    return f"(2 * {phi(z)} - 1)"


def modes(thresh: float) -> dict[str, str]:
    t = repr(thresh)
    bet = f"CASE WHEN p > {t} THEN least(1.0, greatest(0.0, {_bet(t)})) ELSE 0.0 END"
    ratio = "ss / nullif(CASE WHEN sf > 1e-9 THEN sf END, 0.0)"
    calm = f"CASE WHEN m >= {FAST + 2} AND sf > 1e-9 THEN least(1.0, greatest({{low}}, {ratio})) ELSE 1.0 END"
    both = f"least(1.0, greatest(-1.0, {_bet('0.5')}))"
    return {
        "ramp": f"CASE WHEN p > {t} THEN least(1.0, (p - {t}) * 200) ELSE 0.0 END",
        "binary": f"CASE WHEN p > {t} THEN 1.0 ELSE 0.0 END",
        "cdf_plain": bet,
        "cdf_overlay": f"({bet}) * {calm.format(low='0.6')}",
        "dd_overlay": f"({bet}) * least(1.0, greatest(0.5, frac))",
        "ddbreaker": f"CASE WHEN frac < 0.4 THEN 0.0 ELSE ({bet}) * least(1.0, greatest(0.4, frac)) END",
        "longshort": f"CASE WHEN p > {t} THEN 1.0 WHEN p < 1 - {t} THEN -1.0 ELSE 0.0 END",
        "ls_cdf": both,
        "ls_overlay": f"({both}) * {calm.format(low='0.45')}",
        "crashveto": f"CASE WHEN p > {t} THEN 0.0 ELSE 1.0 END",
        "crashsoft": f"CASE WHEN p <= {t} / 2 THEN 1.0 ELSE greatest(0.0, ({t} - p) / ({t} / 2)) END",
        "short_carry": f"CASE WHEN p > {t} THEN 0.0 ELSE -1.0 END",
        "tilt": "greatest(0.5, least(1.0, 0.5 + p))",
        "tilt_up": f"CASE WHEN p > {t} THEN 1 + 0.5 * least(1.0, greatest(0.0, {_bet(t)})) ELSE 1.0 END",
        "kelly_dd": f"CASE WHEN p > {t} THEN least(1.0, greatest(0.0, (2 * p - 1) / 1.857)) ELSE 0.0 END",
    }


AIMS = {"aim": "cdf_plain", "aim_dd": "dd_overlay", "aim_cdf": "cdf_overlay"}


def _tail_mean(n: int) -> F.Column:
    """Mean loss of the worst fifth of the last n returns before the bar."""
    before = F.expr(f"array_sort(collect_list(lr) OVER {frame(n, -1)})")
    k = F.greatest(F.lit(1), (F.size(before) * 0.2).cast("int"))
    return -F.aggregate(F.slice(before, 1, k), F.lit(0.0), lambda a, x: a + x) / k


def size(preds: DataFrame, mode: str, thresh: float) -> DataFrame:
    """key, bar_ix, w of the named mode."""
    rows = steps(preds, *BASE)
    if mode == "cond_es":
        rows = steps(rows, {"b": modes(thresh)["cdf_plain"]}).withColumns({"ef": _tail_mean(FAST), "es": _tail_mean(SLOW)})
        rows = steps(rows, {"w": f"b * CASE WHEN m >= {FAST + 2} AND ef > 1e-9 AND es > 0 THEN least(1.0, greatest(0.4, es / ef)) ELSE 1.0 END"})
    elif mode in AIMS:
        return aimed(steps(rows, {"w": modes(thresh)[AIMS[mode]]}))
    elif mode in modes(thresh):
        rows = steps(rows, {"w": modes(thresh)[mode]})
    else:
        raise ValueError(f"unknown sizing {mode!r}")
    return rows.select("key", "bar_ix", F.round(F.col("w").cast("double"), 6).alias("w"))


def size_check(source: str, mode: str, thresh: float) -> str:
    if mode == "cond_es":
        tail = "-list_sum(list_sort(list(lr) OVER {f})[1:greatest(1, CAST(floor(len(list(lr) OVER {f}) * 0.2) AS INT))]) / greatest(1, CAST(floor(len(list(lr) OVER {f}) * 0.2) AS INT))"
        rows = steps_sql(source, *BASE, {"b": modes(thresh)["cdf_plain"], "ef": tail.format(f=_fast), "es": tail.format(f=_slow)})
        w = f"b * CASE WHEN m >= {FAST + 2} AND ef > 1e-9 AND es > 0 THEN least(1.0, greatest(0.4, es / ef)) ELSE 1.0 END"
        return f"SELECT key, bar_ix, round(CAST({w} AS DOUBLE), 6) AS w FROM {rows}"
    if mode in AIMS:
        rows = steps_sql(source, *BASE, {"w": modes(thresh)[AIMS[mode]]})
        return f"""
WITH RECURSIVE i AS MATERIALIZED (SELECT key, bar_ix, CAST(w AS DOUBLE) AS w FROM {rows}),
f AS (SELECT key, bar_ix, 0.3 * w AS w FROM i WHERE bar_ix = 0 UNION ALL SELECT i.key, i.bar_ix, 0.7 * f.w + 0.3 * i.w FROM f JOIN i ON i.key = f.key AND i.bar_ix = f.bar_ix + 1)
SELECT key, bar_ix, round(w, 6) AS w FROM f"""
    return f"SELECT key, bar_ix, round(CAST({modes(thresh)[mode]} AS DOUBLE), 6) AS w FROM {steps_sql(source, *BASE)}"


def aimed(targets: DataFrame, share: float = 0.3) -> DataFrame:
    """Moves a share of the way to the target at each bar."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, now, out = part.sort_values("bar_ix"), 0.0, []
        for w in part["w"].tolist():
            now = (1 - share) * now + share * w
            out.append(round(now, 6))
        return part[["key", "bar_ix"]].assign(w=out)

    return targets.select("key", "bar_ix", F.col("w").cast("double").alias("w")).groupBy("key").applyInPandas(run, "key string, bar_ix long, w double")


def executed(sizes: DataFrame, band: float = 0.01, flat: float = 0.01) -> DataFrame:
    """Size that is held: changes of no more than the band are not traded, sizes below ``flat`` close the position."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, now, out, traded = part.sort_values("bar_ix"), 0.0, [], []
        for w in part["w"].tolist():
            w = 0.0 if abs(w) < flat else w
            moved = abs(w - now) > band or (w == 0.0 and now != 0.0)
            now = w if moved else now
            out.append(now)
            traded.append(moved)
        return part[["key", "bar_ix"]].assign(held=out, traded=traded)

    return sizes.select("key", "bar_ix", F.col("w").cast("double").alias("w")).groupBy("key").applyInPandas(run, "key string, bar_ix long, held double, traded boolean")


def executed_check(sizes: str, band: float = 0.01, flat: float = 0.01) -> str:
    target = f"CASE WHEN abs(i.w) < {flat} THEN 0.0 ELSE i.w END"
    moved = f"(abs(({target}) - f.held) > {band} OR (({target}) = 0.0 AND f.held <> 0.0))"
    return f"""
WITH RECURSIVE i AS MATERIALIZED (SELECT key, bar_ix, CAST(w AS DOUBLE) AS w FROM ({sizes})),
f AS (
  SELECT key, CAST(-1 AS BIGINT) AS bar_ix, CAST(0 AS DOUBLE) AS held, false AS traded FROM i WHERE bar_ix = 0
  UNION ALL
  SELECT i.key, i.bar_ix, CASE WHEN {moved} THEN {target} ELSE f.held END, {moved} FROM f JOIN i ON i.key = f.key AND i.bar_ix = f.bar_ix + 1
)
SELECT key, bar_ix, held, traded FROM f WHERE bar_ix >= 0"""
