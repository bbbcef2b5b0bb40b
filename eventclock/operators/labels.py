"""Labels of bars that look forward, by window expressions.

A labeler tries a small grid; each try gives 1, 0 or null (no label).  A try counts if
it labels enough TRAIN and VAL bars and its share of ones on TRAIN is inside bounds; the
share closest to a half wins, the first of equals.  Tries, cuts, counts and choice are
windows over one partitioning by key, so a labeler costs one exchange.

Quantile cuts see TRAIN rows only.  ``reach`` is how far a labeler looks, for embargoes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.functions.dialect import frame, steps, steps_sql

O = "(PARTITION BY key ORDER BY ts, seq)"
ALL = "(PARTITION BY key)"


@dataclass(frozen=True)
class Labeler:
    steps: tuple[dict[str, str], ...]
    tries: tuple[str, ...]
    reach: int
    least: tuple[int, int] = (100, 20)
    share: tuple[float, float] = (0.2, 0.8)
    score: str = "least({b}, 1 - {b})"
    judged: str = "train"
    fallback: str | None = None


def ahead(h: int) -> str:
    """The next h bars."""
    return frame(-1, h)


def forward(h: int) -> str:
    return f"lead(lc, {h}) OVER {O} - lc"


def cut(x: str, q: float) -> str:
    """Quantile over TRAIN."""
    return f"pct{{CASE WHEN split = 'train' THEN {x} END|{q}}} OVER {ALL}"


def by_strength(strengths: dict[int, tuple[str, str]], quantiles: tuple[float, ...], before: dict[str, str] | None = None, side: str = ">=", rising: str = "> 0") -> tuple[tuple[dict[str, str], ...], tuple[str, ...]]:
    """Tries that label the direction of bars whose strength is beyond a TRAIN quantile.

    strengths: by horizon, texts of strength and of direction.
    """
    first, second, tries = {}, {}, []
    for h, (strength, direction) in strengths.items():
        first |= {f"st{h}": strength, f"di{h}": direction}
        for q in quantiles:
            name = f"cut{h}_{int(100 * q)}"
            second[name] = cut(f"st{h}", q)
            tries.append(f"CASE WHEN st{h} {side} {name} THEN CASE WHEN di{h} {rising} THEN 1 WHEN di{h} IS NOT NULL THEN 0 END END")
    return (*([before] if before else []), first, second), tuple(tries)


def _ker(horizons: tuple[int, ...]) -> Labeler:
    s = {h: (f"CASE WHEN count(lr) OVER {ahead(h)} = {h} THEN abs({forward(h)}) / nullif(sum(abs(lr)) OVER {ahead(h)}, 0.0) END", forward(h)) for h in horizons}
    return Labeler(*by_strength(s, (0.4, 0.5, 0.6, 0.7)), max(horizons))


def _sharpe(hs: tuple[int, ...]) -> Labeler:
    s = {h: (f"CASE WHEN count(lr) OVER {ahead(h)} = {h} THEN abs({forward(h)}) / nullif(stddev_pop(lr) OVER {ahead(h)} * sqrt({h}.0), 0.0) END", forward(h)) for h in hs}
    return Labeler(*by_strength(s, (0.4, 0.5, 0.6, 0.7)), max(hs))


def _sortino(hs: tuple[int, ...]) -> Labeler:
    s = {}
    for h in hs:
        fall = f"sqrt(avg(CASE WHEN lr < 0 THEN lr * lr ELSE 0.0 END) OVER {frame(-2, h + 1)})"
        s[h] = f"CASE WHEN count(lr) OVER {frame(-2, h + 1)} = {h} THEN abs({forward(h)}) / (greatest({fall}, 1e-9) * sqrt({h}.0)) END", forward(h)
    return Labeler(*by_strength(s, (0.4, 0.5, 0.6, 0.7)), max(hs) + 1)


def _revert(hs: tuple[int, ...]) -> Labeler:
    first, second, tries = {}, {}, []
    for h in hs:
        first |= {f"fw{h}": f"CASE WHEN lag(lc, {h}) OVER {O} IS NOT NULL THEN {forward(h)} END", f"tr{h}": f"lc - lag(lc, {h}) OVER {O}"}
        for q in (0.4, 0.5, 0.6, 0.7):
            name = f"cut{h}_{int(100 * q)}"
            second[name] = cut(f"abs(fw{h})", q)
            tries.append(f"CASE WHEN abs(fw{h}) >= {name} THEN CASE WHEN tr{h} < 0 AND fw{h} > 0 THEN 1 WHEN tr{h} > 0 AND fw{h} < 0 THEN 0 END END")
    return Labeler((first, second), tuple(tries), max(hs))


def _turns(hs: tuple[int, ...]) -> Labeler:
    first, tries = {}, []
    for h in hs:
        first |= {f"fw{h}": forward(h), f"lo{h}": f"min(lc) OVER {ahead(h)}", f"hi{h}": f"max(lc) OVER {ahead(h)}"}
        for share in (0.25, 0.4, 0.5):
            n = max(1, int(h * share))
            first |= {f"lo{h}_{n}": f"min(lc) OVER {ahead(n)}", f"hi{h}_{n}": f"max(lc) OVER {ahead(n)}"}
            tries.append(f"CASE WHEN hi{h}_{n} = hi{h} AND fw{h} < 0 THEN 0 WHEN lo{h}_{n} = lo{h} AND fw{h} > 0 THEN 1 END")
    return Labeler((first,), tuple(tries), max(hs))


def _ordinal(hs: tuple[int, ...]) -> Labeler:
    a, b, c = "lc", f"lead(lc, 1) OVER {O}", f"lead(lc, 2) OVER {O}"
    code = {"code": f"CASE WHEN {a} < {b} THEN 4 ELSE 0 END + CASE WHEN {a} < {c} THEN 2 ELSE 0 END + CASE WHEN {b} < {c} THEN 1 ELSE 0 END"}
    counts = {f"n{h}_{k}": f"sum(CASE WHEN code = {k} THEN 1 ELSE 0 END) OVER {frame(-1, h - 2)}" for h in hs for k in range(8)}
    s = {}
    for h in hs:
        n = f"{h - 2}e0"
        total = " + ".join(f"CASE WHEN n{h}_{k} > 0 THEN n{h}_{k} / {n} * ln(n{h}_{k} / {n}) ELSE 0e0 END" for k in range(8))
        # on a grid, as entropies of equal counts in another order must tie
        s[h] = f"CASE WHEN lead(lc, {h}) OVER {O} IS NOT NULL THEN round(-({total}) / ln(6e0), 9) END", forward(h)
    made, tries = by_strength(s, (0.3, 0.4, 0.5), side="<=")
    return Labeler((code, counts, *made), tries, max(hs))


def _excursions(hs: tuple[int, ...]) -> Labeler:
    first, second, tries = {}, {}, []
    for h in hs:
        up, down = f"(greatest(lc, max(lc) OVER {ahead(h)}) - lc)", f"(lc - least(lc, min(lc) OVER {ahead(h)}))"
        first[f"as{h}"] = f"CASE WHEN lead(lc, {h}) OVER {O} IS NOT NULL THEN ({up} - {down}) / nullif({up} + {down}, 0.0) END"
        for q in (0.3, 0.4, 0.5, 0.6):
            name = f"cut{h}_{int(100 * q)}"
            second[name] = cut(f"abs(as{h})", q)
            tries.append(f"CASE WHEN as{h} >= {name} THEN 1 WHEN as{h} <= -{name} THEN 0 END")
    return Labeler((first, second), tuple(tries), max(hs))


def _skew(hs: tuple[int, ...]) -> Labeler:
    first, second, third, tries = {}, {}, {}, []
    for h in hs:
        w = ahead(h)
        first[f"sk{h}"] = f"CASE WHEN count(lr) OVER {w} = {h} AND sum(lr * lr) OVER {w} > 1e-12 THEN sqrt({h}.0) * sum(lr * lr * lr) OVER {w} / power(sum(lr * lr) OVER {w}, 1.5) END"
        second[f"sc{h}"] = f"sk{h} - {cut(f'sk{h}', 0.5)}"
        for q in (0.3, 0.4, 0.5):
            name = f"cut{h}_{int(100 * q)}"
            third[name] = cut(f"abs(sc{h})", q)
            tries.append(f"CASE WHEN sc{h} <= -{name} THEN 1 WHEN sc{h} >= {name} THEN 0 END")
    return Labeler((first, second, third), tuple(tries), max(hs))


def _trend_scan(hs: tuple[int, ...]) -> Labeler:
    spans = hs
    first, second, third = {}, {}, {}
    for n in spans:
        w = frame(0, n)
        sxx = (n + 1) * ((n + 1) ** 2 - 1) / 12
        first |= {f"b{n}": f"CASE WHEN count(lc) OVER {w} = {n + 1} THEN covar_pop(lc, CAST(bar_ix AS DOUBLE)) OVER {w} * {n + 1} / {sxx!r} END", f"yy{n}": f"var_pop(lc) OVER {w} * {n + 1}"}
        second[f"se{n}"] = f"sqrt(greatest(0.0, yy{n} - b{n} * b{n} * {sxx!r}) / {n - 1} / {sxx!r})"
        third[f"at{n}"] = f"CASE WHEN b{n} IS NULL THEN -1.0 WHEN se{n} > 1e-12 THEN abs(b{n} / se{n}) ELSE 0.0 END"
    best = "greatest(-1.0, " + ", ".join(f"at{n}" for n in spans) + ")"
    label = f"CASE WHEN {best} > 0 THEN CASE {best} " + " ".join(f"WHEN at{n} THEN CASE WHEN b{n} > 0 THEN 1 ELSE 0 END" for n in spans) + " END END"
    return Labeler((first, second, third), (label,), max(hs), (200, 30), (0.1, 0.9))


def _crash(hs: tuple[int, ...]) -> Labeler:
    first, second, tries = {}, {}, []
    for h in hs:
        first[f"fw{h}"] = forward(h)
        second[f"sd{h}"] = f"stddev_pop(CASE WHEN split = 'train' THEN fw{h} END) OVER {ALL}"
        tries += [f"CASE WHEN fw{h} < -{k} * sd{h} THEN 1 WHEN fw{h} IS NOT NULL THEN 0 END" for k in (1.0, 1.25, 1.5)]
    return Labeler((first, second), tuple(tries), max(hs), (200, 30), (0.05, 0.35), "-abs({b} - 0.15)")


def _carry(hs: tuple[int, ...]) -> Labeler:
    first = {f"vo{h}": f"CASE WHEN count(lr) OVER {ahead(h)} = {h} THEN stddev_pop(lr) OVER {ahead(h)} END" for h in hs}
    second = {f"md{h}": cut(f"vo{h}", 0.5) for h in hs}
    tries = tuple(f"CASE WHEN md{h} > 0 AND vo{h} <= md{h} THEN 1 WHEN md{h} > 0 AND vo{h} IS NOT NULL THEN 0 END" for h in hs)
    return Labeler((first, second), tries, 0, (0, 30), judged="val", fallback="CASE " + " ".join(f"WHEN md{h} > 0 THEN {t}" for h, t in reversed([*zip(hs, tries, strict=True)])) + f" ELSE {tries[0]} END")


def _tertile(hs: tuple[int, ...]) -> Labeler:
    first = {f"fw{h}": forward(h) for h in hs}
    second = {f"c{h}_{n}": cut(f"fw{h}", n / 100) for h in hs for n in (33, 67)}
    return Labeler((first, second), tuple(f"CASE WHEN fw{h} <= c{h}_33 THEN 0 WHEN fw{h} >= c{h}_67 THEN 1 END" for h in hs), max(hs), share=(0.3, 0.7))


def _acceleration(hs: tuple[int, ...]) -> Labeler:
    first, tries = {}, []
    for h in hs:
        first |= {f"a{h}": forward(h // 2), f"b{h}": f"lead(lc, {h}) OVER {O} - lead(lc, {h // 2}) OVER {O}"}
        tries.append(f"CASE WHEN b{h} > 0 AND b{h} > a{h} THEN 1 WHEN b{h} < 0 AND b{h} < a{h} THEN 0 END")
    return Labeler((first,), tuple(tries), max(hs))


def _consensus(hs: tuple[int, ...]) -> Labeler:
    first = {f"fw{h}": forward(h) for h in hs}
    up, down = " AND ".join(f"fw{h} >= 0" for h in hs), " AND ".join(f"fw{h} < 0" for h in hs)
    return Labeler((first,), (f"CASE WHEN {up} THEN 1 WHEN {down} THEN 0 END",), max(hs))


def _diurnal(hs: tuple[int, ...]) -> Labeler:
    profile = {"mod": "hour(ts) * 60 + minute(ts)", "r2": "lr * lr"}
    train = "CASE WHEN split = 'train' THEN r2 END"
    means = {"mn": f"count({train}) OVER (PARTITION BY key, mod)", "mm": f"avg({train}) OVER (PARTITION BY key, mod)", "mg": f"avg({train}) OVER {ALL}"}
    z = {"z": "r2 / nullif(CASE WHEN mn >= 20 AND mm > 0 THEN mm ELSE mg END, 0.0)"} | {f"fw{h}": forward(h) for h in hs}
    cuts = {f"cut{int(100 * q)}": cut("z", q) for q in (0.6, 0.7, 0.8)}
    tries = tuple(f"CASE WHEN z >= cut{q} THEN CASE WHEN fw{h} > 0 THEN 1 WHEN fw{h} IS NOT NULL THEN 0 END END" for h in hs for q in (60, 70, 80))
    return Labeler((profile, means, z, cuts), tries, max(hs))


#: What makes a labeler of its horizons, and its own horizons.
MAKERS: dict[str, tuple[Callable[[tuple[int, ...]], Labeler], tuple[int, ...]]] = {
    "carry": (_carry, (50, 100, 200)),
    "tertile": (_tertile, (50, 100, 200)),
    "multi_horizon": (_consensus, (50, 100, 200)),
    "trend_scan": (_trend_scan, (20, 40, 80)),
    "crash_ahead": (_crash, (50, 100, 200)),
    "ker": (_ker, (20, 40, 80)),
    "ker_fast": (_ker, (20,)),
    "ker_mid": (_ker, (60,)),
    "ker_slow": (_ker, (150,)),
    "accel": (_acceleration, (20, 40, 80)),
    "revert": (_revert, (20, 40, 80)),
    "turn_scan": (_turns, (20, 40, 80)),
    "perment": (_ordinal, (20, 40, 80)),
    "sharpe_scan": (_sharpe, (20, 40, 80)),
    "sortino_scan": (_sortino, (40, 80, 160)),
    "mfe_mae": (_excursions, (20, 40, 80)),
    "rskew": (_skew, (40, 80, 160)),
    "diurnal_anomaly": (_diurnal, (50, 100, 200)),
}
LABELERS: dict[str, Labeler] = {name: make(hs) for name, (make, hs) in MAKERS.items()} | {"always_long": Labeler(({"one": "1"},), ("one",), 0, (0, 0), (0.0, 2.0), "{b}")}


def labeler_of(name: str, horizons: tuple[int, ...] | None = None) -> Labeler:
    """The named labeler; horizons: bars ahead instead of its own."""
    if horizons is None:
        return LABELERS[name]
    if name not in MAKERS:
        raise ValueError(f"labeler {name!r} has no horizons")
    return MAKERS[name][0](tuple(horizons))


def _choice(labeler: Labeler) -> tuple[dict[str, str], ...]:
    tries, a, b, c = {}, {}, {}, {}
    for k, text in enumerate(labeler.tries):
        tries[f"y{k}"] = text
        a |= {f"t{k}": f"count(CASE WHEN split = 'train' THEN y{k} END) OVER {ALL}", f"v{k}": f"count(CASE WHEN split = 'val' THEN y{k} END) OVER {ALL}", f"b{k}": f"avg(CASE WHEN split = '{labeler.judged}' THEN CAST(y{k} AS DOUBLE) END) OVER {ALL}"}
        low, high = labeler.share
        b[f"s{k}"] = f"CASE WHEN t{k} >= {labeler.least[0]} AND v{k} >= {labeler.least[1]} AND b{k} > {low} AND b{k} < {high} THEN {labeler.score.format(b=f'b{k}')} ELSE -9.0 END"
    c["top"] = f"greatest({', '.join(b)}, -9.0)"
    other = labeler.fallback or "NULL"
    y = "CASE WHEN top <= -9.0 THEN " + other + " " + " ".join(f"WHEN s{k} = top THEN y{k}" for k in range(len(labeler.tries))) + " END"
    return tries, a, b, c, {"y": f"coalesce(CAST({y} AS INT), -1)"}


def build(bars: DataFrame, name: str, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """key, bar_ix, y: 1, 0, or -1 for no label (all of a key if no try counts)."""
    labeler = labeler_of(name, horizons)
    return steps(bars, *labeler.steps, *_choice(labeler)).select("key", "bar_ix", "y")


def check(source: str, name: str) -> str:
    labeler = LABELERS[name]
    return f"SELECT key, bar_ix, y FROM {steps_sql(source, *labeler.steps, *_choice(labeler))}"


def report(bars: DataFrame, name: str) -> DataFrame:
    """One row per key: labelled TRAIN and VAL bars, share of ones, declared reach."""
    y = build(bars, name).join(bars.select("key", "bar_ix", "split"), ["key", "bar_ix"])
    count = lambda split: F.count(F.when((F.col("split") == split) & (F.col("y") >= 0), 1))
    share = F.avg(F.when((F.col("split") == "train") & (F.col("y") >= 0), F.col("y")))
    return y.groupBy("key").agg(count("train").alias("n_train"), count("val").alias("n_val"), share.alias("balance")).withColumn("reach", F.lit(LABELERS[name].reach))
