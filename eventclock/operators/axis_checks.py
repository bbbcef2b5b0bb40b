"""SQL of axes whose threshold is a search over TRAIN, for the checking engine.

A clock is a fold over a key's values: a state, what it becomes with the next value ``x``,
and the condition under which a bar has ended in it.  The search is one query a round.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Fold:
    """start: fields of the first state; then: their texts over s (state), x.v (value) and t (threshold); ends: a bar ended in s."""

    start: dict[str, str]
    then: dict[str, str]
    ends: str

    def over(self, values: str, threshold: str, field: str, start: str, then: str) -> str:
        """The fold with one more field."""
        begin = ", ".join(f"'{k}': {v}" for k, v in ({"v": "0.0::DOUBLE", "i": "0::BIGINT"} | self.start | {field: start}).items())
        step = ", ".join(f"'{k}': {v}" for k, v in ({"v": "x.v", "i": "x.i"} | self.then | {field: then}).items())
        none = ", ".join(f"'{k}': {v}" for k, v in (self.start | {field: start}).items())
        wide = f"list_transform({values}, lambda e: {{'v': e.v, 'i': e.i, {none}}})"
        ended = self.ends
        return f"list_reduce({wide}, lambda s, x: {{{step}}}, {{{begin}}})".replace("{t}", threshold).replace("{ended}", ended.replace("{t}", threshold))

    def count(self, values: str, threshold: str) -> str:
        done = self.over(values, threshold, "n", "0::BIGINT", "s.n + CASE WHEN {ended} THEN 1 ELSE 0 END")
        return f"list_transform([{done}], lambda s: s.n + CASE WHEN {self.ends} THEN 1 ELSE 0 END)[1]".replace("{t}", threshold)

    def hits(self, values: str, threshold: str) -> str:
        done = self.over(values, threshold, "h", "[]::BIGINT[]", "CASE WHEN {ended} THEN list_append(s.h, s.i) ELSE s.h END")
        return f"list_transform([{done}], lambda s: CASE WHEN {self.ends} THEN list_append(s.h, s.i) ELSE s.h END)[1]".replace("{t}", threshold)


_sign = "CASE WHEN x.v > 0 THEN 1 WHEN x.v < 0 THEN -1 ELSE s.g END"
_fast, _slow = "coalesce(s.f + 2 / ({t} + 1) * (x.v - s.f), x.v)", "coalesce(s.l + 2 / (4 * {t} + 1) * (x.v - s.l), x.v)"
RESET = Fold({"a": "0.0::DOUBLE"}, {"a": "CASE WHEN {ended} THEN 0.0 ELSE s.a END + x.v"}, "s.a >= {t}")
RUN = Fold({"a": "0.0::DOUBLE", "g": "0::INTEGER"}, {"a": f"abs(x.v) + CASE WHEN {{ended}} OR ({_sign} <> s.g AND s.g <> 0) THEN 0.0 ELSE s.a END", "g": _sign}, "s.a >= {t}")
CYCLE = Fold({"f": "NULL::DOUBLE", "l": "NULL::DOUBLE", "b": "0.0::DOUBLE", "o": "0.0::DOUBLE"}, {"f": _fast, "l": _slow, "b": "s.o", "o": f"{_fast} - {_slow}"}, "(s.b <> 0 AND s.o * s.b < 0)")
_two = {
    "b": "coalesce(s.b + 0.01 * (x.v - s.b), x.v)",
    "u": "coalesce(greatest(0.0, CASE WHEN {ended} THEN 0.0 ELSE s.u END + (x.v - s.b)), 0.0)",
    "d": "coalesce(greatest(0.0, CASE WHEN {ended} THEN 0.0 ELSE s.d END - (x.v - s.b)), 0.0)",
}
# the greatest of zero and null is zero here, so a first value must not count
_two |= {k: f"CASE WHEN s.b IS NULL THEN 0.0 ELSE {_two[k]} END" for k in "ud"}
_none = {"b": "NULL::DOUBLE", "u": "0.0::DOUBLE", "d": "0.0::DOUBLE"}
COMPLEXITY, CALM = Fold(_none, _two, "(s.u >= {t} OR s.d >= {t})"), Fold(_none, _two, "s.d >= {t}")

#: Fold, lowest and highest threshold over the TRAIN list ``w``, rounds.
_spread = "coalesce(nullif(list_stddev_pop(list_transform(w, lambda e: e.v)), 0.0), 1e-9)"
SEARCHED = {
    "run": (RUN, f"{_spread} / 2", f"300 * {_spread}", 22),
    "spectral": (CYCLE, "1.0::DOUBLE", "2000.0::DOUBLE", 20),
    "pecusum": (COMPLEXITY, "1e-4::DOUBLE", "5.0::DOUBLE", 18),
    "calmonset": (CALM, "1e-4::DOUBLE", "5.0::DOUBLE", 18),
    "entropy": (RESET, "1e-6::DOUBLE", "list_sum(list_transform(w, lambda e: e.v)) + 1", 40),
}
FINAL = "SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts, seq) - 1 AS bar_ix, ts, round(lc, 9) AS log_close FROM"


def searched(rows: str, name: str, per_bar: int) -> str | None:
    """SQL of the axis over its rows; None where there is none."""
    if name in _OTHERS:
        return _OTHERS[name](rows, per_bar)
    if name not in SEARCHED:
        return None
    fold, low, high, rounds = SEARCHED[name]
    column, wanted = ("r", f"round_even(len(w) / {per_bar}.0, 0)") if name == "entropy" else ("x", f"greatest(1.0, len(w) / {per_bar}.0)")
    surprise = "i AS MATERIALIZED (SELECT * FROM n),"
    if name == "entropy":
        surprise = """q AS (SELECT key, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS edges, count(*) AS total FROM n WHERE is_train GROUP BY key),
b AS (SELECT n.*, total, len(list_filter(edges, lambda e: e <= v)) AS bucket FROM n JOIN q USING (key)),
p AS (SELECT key, bucket, -ln(greatest(count(*) / any_value(total), 1e-12)) AS v FROM b WHERE is_train GROUP BY key, bucket),
i AS MATERIALIZED (SELECT b.* EXCLUDE (v, total, bucket), coalesce(p.v, -ln(1e-12)) AS v FROM b LEFT JOIN p USING (key, bucket)),"""
    steps = []
    for k in range(rounds):
        steps.append(f"m{k} AS (SELECT *, sqrt(lo * hi) AS t FROM s{k}), c{k} AS MATERIALIZED (SELECT *, {fold.count('w', 't')} AS c FROM m{k}), s{k + 1} AS MATERIALIZED (SELECT key, v, w, wanted, CASE WHEN c > wanted THEN t ELSE lo END AS lo, CASE WHEN c > wanted THEN hi ELSE t END AS hi FROM c{k})")
    return f"""
WITH n AS MATERIALIZED (SELECT key, ts, seq, lc, is_train, CAST({column} AS DOUBLE) AS v, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i FROM {rows} WHERE {column} IS NOT NULL),
{surprise}
l AS MATERIALIZED (SELECT key, list({{'v': v, 'i': i}} ORDER BY i) AS v, list({{'v': v, 'i': i}} ORDER BY i) FILTER (is_train) AS w FROM i GROUP BY key),
s0 AS MATERIALIZED (SELECT key, v, w, {wanted} AS wanted, {low} AS lo, {high} AS hi FROM l WHERE len(w) > 0),
{', '.join(steps)},
h AS (SELECT key, unnest({fold.hits('v', 't')}) AS i FROM (SELECT key, v, sqrt(lo * hi) AS t FROM s{rounds}))
{FINAL} (SELECT i.* FROM i JOIN h USING (key, i))"""


def _variance_ratio(rows: str, per_bar: int) -> str:
    return f"""
WITH RECURSIVE n AS MATERIALIZED (SELECT key, ts, seq, lc, is_train, x * x AS a, q * q AS b, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i FROM {rows} WHERE x IS NOT NULL),
e AS (
  SELECT key, i, a AS short, b AS long FROM n WHERE i = 1
  UNION ALL SELECT n.key, n.i, e.short + 0.02 * (n.a - e.short), e.long + 0.02 * (n.b - e.long) FROM e JOIN n ON n.key = e.key AND n.i = e.i + 1
),
o AS MATERIALIZED (SELECT key, i, is_train, abs(long / (20 * short) - 1) AS v FROM e JOIN n USING (key, i) WHERE short > 1e-18),
l AS (SELECT key, list({{'v': v, 'i': i}} ORDER BY i) AS v, avg(v) FILTER (is_train) * {per_bar} AS t FROM o GROUP BY key HAVING count(*) FILTER (is_train) > 0),
h AS (SELECT key, unnest({RESET.hits('v', 't')}) AS i FROM l)
{FINAL} (SELECT n.* FROM n JOIN h USING (key, i))"""


def _fractional(rows: str, per_bar: int, bound: int = 2_000, least: float = 1e-4) -> str:
    """Every order's filter as a weighted list, its unit-root statistic over TRAIN, the first order that is stationary."""
    parts, picks = [], []
    for d in range(1, 10):
        w = [1.0]
        while len(w) < bound and abs(nxt := -w[-1] * (d / 10 - len(w) + 1) / len(w)) >= least:
            w.append(nxt)
        n, weights = len(w), "[" + ", ".join(map(repr, reversed(w))) + "]::DOUBLE[]"
        span = f"(PARTITION BY key ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"d{d} AS MATERIALIZED (SELECT key, i, is_train, list_inner_product(xs, {weights}) AS fd FROM (SELECT key, i, is_train, list(lc) OVER {span} AS xs FROM n) WHERE len(xs) = {n})")
        pairs = f"SELECT key, fd AS past, lead(fd) OVER (PARTITION BY key ORDER BY i) - fd AS step FROM d{d} WHERE is_train"
        sums = f"SELECT key, count(step) AS n, var_pop(past) * count(step) AS sxx, covar_pop(step, past) * count(step) AS sxy, var_pop(step) * count(step) AS syy FROM ({pairs}) WHERE step IS NOT NULL GROUP BY key"
        picks.append(f"SELECT key, {d} AS d, CASE WHEN n < 99 OR sxx <= 0 THEN 0.0 ELSE sxy / sxx / sqrt((syy - sxy * sxy / sxx) / greatest(1, n - 2) / sxx) END AS t FROM ({sums}) JOIN sizes USING (key) WHERE {n} >= 2 AND {n} < train // 2")
    moves = " UNION ALL ".join(f"SELECT key, {d} AS d, i, is_train, abs(fd - lag(fd) OVER (PARTITION BY key ORDER BY i)) AS v FROM d{d}" for d in range(1, 10))
    return f"""
WITH n AS MATERIALIZED (SELECT key, ts, seq, lc, is_train, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i FROM {rows}),
sizes AS (SELECT key, count(*) FILTER (is_train) AS train FROM n GROUP BY key),
{', '.join(parts)},
t AS MATERIALIZED ({' UNION ALL '.join(picks)}),
best AS (SELECT key, d FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN t <= -2.9 THEN d ELSE 100 END, t, d) = 1),
o AS MATERIALIZED (SELECT * FROM ({moves}) JOIN best USING (key, d) WHERE v IS NOT NULL),
l AS (SELECT key, list({{'v': v, 'i': i}} ORDER BY i) AS v, avg(v) FILTER (is_train) * {per_bar} AS t FROM o GROUP BY key HAVING count(*) FILTER (is_train) > 0),
h AS (SELECT key, unnest({RESET.hits('v', 't')}) AS i FROM l)
{FINAL} (SELECT n.* FROM n JOIN h USING (key, i))"""


def _slope(rows: str, per_bar: int) -> str:
    """Noises by likelihood over a grid, gains where the filter settles, the threshold nearest the bar rate."""
    total, miss = "(s.p00 + s.p01 + s.p10 + s.p11 + q.ql + q.noise)", "(x.v - s.at - s.trend)"
    a00, a01, a10, a11 = "(s.p00 + s.p01 + s.p10 + s.p11 + q.ql)", "(s.p01 + s.p11)", "(s.p10 + s.p11)", "(s.p11 + q.qs)"
    walk = {
        "v": "x.v", "at": f"s.at + s.trend + {a00} / {total} * {miss}", "trend": f"s.trend + {a10} / {total} * {miss}",
        "p00": f"{a00} - {a00} / {total} * {a00}", "p01": f"{a01} - {a00} / {total} * {a01}", "p10": f"{a10} - {a10} / {total} * {a00}", "p11": f"{a11} - {a10} / {total} * {a01}",
        "fit": f"s.fit - 0.5 * (ln(2 * pi()) + ln({total}) + {miss} * {miss} / {total})",
    }
    step = ", ".join(f"'{k}': {v}" for k, v in walk.items()).replace("q.", "")
    wide = ", ".join(f"'{k}': {v}" for k, v in {"v": "e", "at": "0.0::DOUBLE", "trend": "0.0::DOUBLE", "p00": "0.0::DOUBLE", "p01": "0.0::DOUBLE", "p10": "0.0::DOUBLE", "p11": "0.0::DOUBLE", "fit": "0.0::DOUBLE"}.items())
    begin = "'v': 0.0::DOUBLE, 'at': w[1], 'trend': 0.0::DOUBLE, 'p00': noise, 'p01': 0.0::DOUBLE, 'p10': 0.0::DOUBLE, 'p11': noise, 'fit': 0.0::DOUBLE"
    return f"""
WITH RECURSIVE n AS MATERIALIZED (SELECT key, ts, seq, lc, is_train, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i FROM {rows}),
r AS (SELECT key, i, lc, lc - lag(lc) OVER (PARTITION BY key ORDER BY i) AS m FROM n WHERE is_train),
w AS (SELECT key, var_pop(m) AS noise, list(CAST(lc AS DOUBLE) ORDER BY i) AS w FROM r GROUP BY key),
g AS (SELECT *, noise * l AS ql, noise * k AS qs FROM w, (VALUES (1e-1, 1), (1e-2, 2), (1e-3, 3), (1e-4, 4)) a(l, ln), (VALUES (1e-5, 1), (1e-7, 2), (1e-9, 3), (1e-11, 4)) b(k, kn)),
f AS MATERIALIZED (SELECT *, list_reduce(list_transform(w[2:], lambda e: {{{wide}}}), lambda s, x: {{{step}}}, {{{begin}}}).fit AS fit FROM g),
best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY fit DESC, kn, ln) = 1),
p AS (
  SELECT key, 0 AS k, noise, ql, qs, noise AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p10, noise AS p11, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS turn, noise AS spread, FALSE AS done FROM best
  UNION ALL
  SELECT key, k + 1, noise, ql, qs, a00 - a00 / t * a00, a01 - a00 / t * a01, a10 - a10 / t * a00, a11 - a10 / t * a01, a00 / t, a10 / t, a11, abs(a00 / t - gain) < 1e-13 AND abs(a10 / t - turn) < 1e-13
  FROM (SELECT *, a00 + noise AS t FROM (SELECT *, p00 + p01 + p10 + p11 + ql AS a00, p01 + p11 AS a01, p10 + p11 AS a10, p11 + qs AS a11 FROM p WHERE NOT done AND k < 3000))
),
z AS (SELECT key, gain, turn, sqrt(spread) AS sd FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1),
a AS (
  SELECT n.key, n.i, n.lc AS level, 0.0::DOUBLE AS slope, NULL::DOUBLE AS strength FROM n JOIN z USING (key) WHERE n.i = 1
  UNION ALL SELECT n.key, n.i, a.level + a.slope + z.gain * (n.lc - a.level - a.slope), a.slope + z.turn * (n.lc - a.level - a.slope), abs((a.slope + z.turn * (n.lc - a.level - a.slope)) / z.sd) FROM a JOIN n ON n.key = a.key AND n.i = a.i + 1 JOIN z ON z.key = a.key
),
l AS MATERIALIZED (SELECT key, list({{'v': strength, 'i': i}} ORDER BY i) AS v, list({{'v': strength, 'i': i}} ORDER BY i) FILTER (is_train) AS w FROM a JOIN n USING (key, i) WHERE strength IS NOT NULL GROUP BY key),
c AS MATERIALIZED (SELECT *, {RISES.count('w', 't')} AS c FROM (SELECT *, exp(ln(0.05) + k * (ln(30.0) - ln(0.05)) / 49) AS t FROM l, range(50) u(k))),
b AS (SELECT key, v, t FROM c WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(c - greatest(1.0, (len(w) + 1) / {per_bar}.0)), k DESC) = 1),
h AS (SELECT key, unnest({RISES.hits('v', 't')}) AS i FROM b)
{FINAL} (SELECT n.* FROM n JOIN h USING (key, i))"""


def _novelty(rows: str, per_bar: int, size: int = 24, depth: int = 4, seed: int = 20260606) -> str:
    """Distance of a slow and a fast average of random Fourier features of recent returns; the threshold nearest the bar rate."""
    import numpy as np

    lines = "[" + ", ".join("[" + ", ".join(map(repr, w)) + "]" for w in np.random.default_rng(seed).standard_normal((size, depth)).tolist()) + "]::DOUBLE[][]"
    span = max(2.0, per_bar)
    fast = 2 / (span + 1)
    low, high = 1e-9, 1 / (span + 1)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if middle * (1 - middle) ** span < fast * (1 - fast) ** span else (low, middle)
    slow = (low + high) / 2
    far = "sqrt(list_sum(list_transform(list_zip(a.xs, b.xs), lambda e: (e[1] - e[2]) * (e[1] - e[2]))))"
    near = lambda m, k: f"list_transform(list_zip(e.{m}, f.feature), lambda z: z[1] + {k!r} * (z[2] - z[1]))"
    return f"""
WITH RECURSIVE n AS MATERIALIZED (SELECT key, ts, seq, lc, is_train, x, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i FROM {rows} WHERE x IS NOT NULL),
v AS MATERIALIZED (SELECT key, i, is_train, xs FROM (SELECT key, i, is_train, list(CAST(x AS DOUBLE)) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN {depth - 1} PRECEDING AND CURRENT ROW) AS xs FROM n) WHERE len(xs) = {depth}),
c AS (SELECT key, count(*) AS c, least(300, count(*)) AS m FROM v WHERE is_train GROUP BY key),
p AS MATERIALIZED (SELECT v.key, k, xs FROM (SELECT key, m, c, unnest(range(m)) AS k FROM c) u JOIN v ON v.key = u.key AND v.i = {depth} + CAST(floor(k * ((c - 1) / (m - 1))) AS BIGINT)),
w AS (SELECT a.key, median({far}) AS width FROM p a JOIN p b ON a.key = b.key AND a.k < b.k WHERE {far} > 0 GROUP BY a.key),
f AS MATERIALIZED (SELECT key, i, is_train, list_transform(list_concat(list_transform(angles, lambda t: cos(t)), list_transform(angles, lambda t: sin(t))), lambda t: t / sqrt({size}.0)) AS feature FROM (SELECT v.*, list_transform({lines}, lambda l: list_inner_product(l, xs) / width) AS angles FROM v JOIN w USING (key))),
e AS (
  SELECT key, i, feature AS a, feature AS b FROM f WHERE i = {depth}
  UNION ALL SELECT f.key, f.i, {near('a', slow)}, {near('b', fast)} FROM e JOIN f ON f.key = e.key AND f.i = e.i + 1
),
z AS MATERIALIZED (SELECT key, i, is_train, list_distance(a, b) AS z FROM e JOIN n USING (key, i) WHERE i > {depth}),
g AS (SELECT key, min(z) AS low, max(z) AS high, count(*) + {depth} AS train FROM z WHERE is_train GROUP BY key),
t AS (SELECT key, train, k, low + k * ((high - low) / 79) AS t FROM g, range(80) u(k)),
r AS (SELECT t.key, t.k, any_value(t) AS t, any_value(train) AS train, count(*) FILTER (z >= t AND before < t) AS c FROM t JOIN (SELECT *, lag(z, 1, 0.0) OVER (PARTITION BY key ORDER BY i) AS before FROM z) s ON s.key = t.key AND s.is_train GROUP BY t.key, t.k),
b AS (SELECT key, t FROM r WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(c - greatest(1.0, train / {per_bar}.0)), k DESC) = 1)
{FINAL} (SELECT n.* FROM n JOIN (SELECT *, lag(z, 1, 0.0) OVER (PARTITION BY key ORDER BY i) AS before FROM z) s USING (key, i) JOIN b USING (key) WHERE z >= t AND before < t)"""


#: ``r``: whether it rose there, ``a``: whether it may rise again.
RISES = Fold({"a": "TRUE", "r": "FALSE"}, {"a": "x.v < {t} / 2 OR (s.a AND x.v < {t})", "r": "s.a AND x.v >= {t}"}, "s.r")
_OTHERS = {"vratio": _variance_ratio, "fracdiff": _fractional, "kalman": _slope, "newma": _novelty}
