"""SQL of feature kernels for the checking engine: values on a grid of bars, carried forward, zero before."""

from __future__ import annotations

from statistics import NormalDist

#: A window's points: key, bar_ix (the bar it ends at), i (place from 1), x.
_PRICES = "SELECT g.key, g.bar_ix, row_number() OVER (PARTITION BY g.key, g.bar_ix ORDER BY c.bar_ix) AS i, c.lc AS x FROM grid{w} g JOIN bars c ON c.key = g.key AND c.bar_ix BETWEEN g.bar_ix - {w} + 1 AND g.bar_ix"
_MOVES = "SELECT g.key, g.bar_ix, row_number() OVER (PARTITION BY g.key, g.bar_ix ORDER BY c.bar_ix) AS i, c.lr AS x FROM grid{w} g JOIN bars c ON c.key = g.key AND c.bar_ix BETWEEN greatest(1, g.bar_ix - {w} + 1) AND g.bar_ix"
_BY = "(PARTITION BY key, bar_ix ORDER BY i)"


def _sample_entropy(points: str, tolerance: float) -> str:
    """Runs of two that match, and those of them that match one value on."""
    runs = f"SELECT key, bar_ix, i, x, lead(x) OVER {_BY} AS y, lead(x, 2) OVER {_BY} AS z, {tolerance} * (stddev_pop(x) OVER (PARTITION BY key, bar_ix) + 1e-12) AS tol FROM ({points})"
    pairs = f"SELECT a.key, a.bar_ix, count(*) FILTER (abs(a.x - b.x) <= a.tol AND abs(a.y - b.y) <= a.tol) AS two, count(*) FILTER (abs(a.x - b.x) <= a.tol AND abs(a.y - b.y) <= a.tol AND abs(a.z - b.z) <= a.tol) AS three FROM runs a JOIN runs b ON a.key = b.key AND a.bar_ix = b.bar_ix AND a.i < b.i WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY a.key, a.bar_ix"
    return f"WITH runs AS MATERIALIZED ({runs}) SELECT key, bar_ix, CASE WHEN two > 0 AND three > 0 THEN -ln(three / two) END AS v FROM ({pairs})"


def _dispersion(w: int, classes: int = 6) -> str:
    cuts = ", ".join(repr(NormalDist().inv_cdf(k / classes)) for k in range(1, classes))
    z = f"SELECT key, bar_ix, i, (x - avg(x) OVER (PARTITION BY key, bar_ix)) / (stddev_pop(x) OVER (PARTITION BY key, bar_ix) + 1e-12) AS z FROM ({_MOVES.format(w=w)})"
    classed = f"SELECT key, bar_ix, c, lead(c) OVER {_BY} AS d FROM (SELECT key, bar_ix, i, len(list_filter([{cuts}], lambda t: t <= z)) AS c FROM ({z}))"
    shares = f"SELECT key, bar_ix, count(*) / sum(count(*)) OVER (PARTITION BY key, bar_ix) AS p FROM ({classed}) WHERE d IS NOT NULL GROUP BY key, bar_ix, c, d"
    return f"SELECT key, bar_ix, -sum(p * ln(p)) / ln({classes**2}.0) AS v FROM ({shares}) GROUP BY key, bar_ix"


def _signature(w: int, column: str) -> str:
    path = f"SELECT key, bar_ix, i, x - first_value(x) OVER {_BY} AS x, coalesce(sum(d) OVER {_BY}, 0.0) AS y FROM (SELECT *, abs(x - lag(x) OVER {_BY}) AS d FROM ({_PRICES.format(w=w)}))"
    steps = f"SELECT *, lag(x) OVER {_BY} AS px, lag(y) OVER {_BY} AS py, (stddev_pop(x) OVER (PARTITION BY key, bar_ix) * stddev_pop(y) OVER (PARTITION BY key, bar_ix) + 1e-12) * count(*) OVER (PARTITION BY key, bar_ix) AS scale FROM ({path})"
    sums = f"SELECT key, bar_ix, sum(0.5 * (x + px) * (y - py)) / any_value(scale) AS xy, sum(0.5 * (y + py) * (x - px)) / any_value(scale) AS yx FROM ({steps}) GROUP BY key, bar_ix"
    return f"SELECT key, bar_ix, {column} AS v FROM ({sums})"


def _tail(w: int) -> str:
    sizes = f"SELECT key, bar_ix, abs(x) AS a, i FROM ({_MOVES.format(w=w)})"
    cut = f"SELECT key, bar_ix, quantile_cont(a, 0.9) AS u, arg_max(a, i) AS last FROM ({sizes}) GROUP BY key, bar_ix"
    over = f"SELECT s.key, s.bar_ix, any_value(last - u) AS last, count(*) FILTER (a > u) AS n, avg(a - u) FILTER (a > u) AS m, var_pop(a - u) FILTER (a > u) AS va FROM ({sizes}) s JOIN ({cut}) c ON c.key = s.key AND c.bar_ix = s.bar_ix GROUP BY s.key, s.bar_ix"
    shape = f"SELECT *, 0.5 * (1 - m * m / va) AS shape FROM ({over})"
    tail = f"SELECT *, 1 + shape * last / (m * (1 - shape)) AS inside FROM ({shape})"
    p = "0.1 * CASE WHEN abs(shape) > 1e-9 AND inside > 0 THEN power(inside, -1 / shape) ELSE exp(-last / (m * (1 - shape))) END"
    return f"SELECT key, bar_ix, CASE WHEN last <= 0 OR n < 5 OR coalesce(va, 0) <= 0 THEN 0.0 ELSE -ln(greatest({p}, 0.0) + 1e-9) END AS v FROM ({tail})"


#: Columns of each kernel: window, query of key, bar_ix and v.
CHECKS: dict[str, dict[str, tuple[int, str]]] = {
    "sample_entropy": {f"sampen_{w}_{int(10 * t)}": (w, _sample_entropy(_PRICES.format(w=w), t)) for w in (50, 100, 200) for t in (0.1, 0.2)} | {f"sampen_move_{w}": (w, _sample_entropy(_MOVES.format(w=w).replace("c.lr AS x", "abs(c.lr) AS x"), 0.2)) for w in (50, 100)},
    "dispersion": {f"disp_{w}": (w, _dispersion(w)) for w in (50, 100, 200)},
    "signature": {f"sig_{w}_{k}": (w, _signature(w, c)) for w in (60, 200) for k, c in enumerate(("xy", "yx", "(xy - yx) / 2"))},
    "evt": {f"evt_{w}": (w, _tail(w)) for w in (100, 200)},
}


def check(source: str, name: str) -> str:
    parts = CHECKS[name]
    grids = ", ".join(f"grid{w} AS MATERIALIZED (SELECT key, bar_ix FROM bars WHERE bar_ix % {max(1, w // 5)} = 0 AND bar_ix >= {w - 1})" for w in sorted({w for w, _ in parts.values()}))
    tables = ", ".join(f"v_{c} AS MATERIALIZED ({query})" for c, (_, query) in parts.items())
    carried = ", ".join(f"round(coalesce(last_value(v_{c}.v IGNORE NULLS) OVER (PARTITION BY b.key ORDER BY b.bar_ix), 0.0), 6) + 0.0 AS {c}" for c in parts)
    joins = " ".join(f"LEFT JOIN v_{c} ON v_{c}.key = b.key AND v_{c}.bar_ix = b.bar_ix" for c in parts)
    return f"WITH bars AS MATERIALIZED (SELECT * FROM {source}), {grids}, {tables} SELECT b.key, b.bar_ix, {carried} FROM bars b {joins}"
