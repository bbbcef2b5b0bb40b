"""SQL of iterative labels for the checking engine, written from their definitions.

It shares no text with ``label_kernels``: paths ahead are joins, running extremes are
windows, machines are recursive queries.  A check is a list of tries, each a query of
key, bar_ix and y (null: no label), behind the common tables it needs; ``chosen`` applies
the gates and takes the best.
"""

from __future__ import annotations

from eventclock.operators.axis_checks import Fold

#: A try: the query of its labels, and the text of its score over b, bt and bv, the shares of ones
#: judged, on TRAIN and on VAL; or a query of key and s that gives the score.
Try = tuple[str, str]
BALANCE = "least(b, 1 - b)"


def chosen(source: str, tables: str, tries: list[Try], least: tuple[int, int] = (100, 20), share: tuple[float, float] = (0.2, 0.8), judged: str = "train") -> str:
    """key, bar_ix, y: the labels of the best try that passes the gates, -1 where there is none."""
    every = " UNION ALL ".join(f"SELECT {k} AS k, key, bar_ix, y FROM ({query})" for k, (query, _) in enumerate(tries))
    queried = [(k, text) for k, (_, text) in enumerate(tries) if text.startswith("SELECT")]
    scores = " UNION ALL ".join(f"SELECT {k} AS k, key, s FROM ({text})" for k, text in queried) or "SELECT -1 AS k, '' AS key, 0.0 AS s"
    score = "CASE k " + " ".join(f"WHEN {k} THEN {'s' if text.startswith('SELECT') else text}" for k, (_, text) in enumerate(tries)) + " END"
    return f"""
WITH RECURSIVE bars AS MATERIALIZED (SELECT * FROM {source}),
sizes AS (SELECT key, count(*) AS n, count(*) FILTER (split = 'train') AS train, stddev_pop(lr) FILTER (split = 'train') AS sigma FROM bars GROUP BY key),
{tables}
tries AS MATERIALIZED ({every}),
judged AS (
  SELECT k, key, count(*) FILTER (split = 'train') AS nt, count(*) FILTER (split = 'val') AS nv, avg(y) FILTER (split = '{judged}') AS b, avg(y) FILTER (split = 'train') AS bt, avg(y) FILTER (split = 'val') AS bv
  FROM tries JOIN bars USING (key, bar_ix) WHERE y IS NOT NULL GROUP BY ALL
),
scores AS MATERIALIZED ({scores}),
best AS (SELECT key, k FROM judged LEFT JOIN scores USING (key, k) WHERE {score} IS NOT NULL AND nt >= {least[0]} AND nv >= {least[1]} AND b > {share[0]} AND b < {share[1]} QUALIFY row_number() OVER (PARTITION BY key ORDER BY {score} DESC, k) = 1)
SELECT bars.key, bars.bar_ix, coalesce(t.y, -1) AS y
FROM bars LEFT JOIN best USING (key) LEFT JOIN tries t ON t.key = bars.key AND t.bar_ix = bars.bar_ix AND t.k = best.k"""


def path(h: int, first: int = 0) -> str:
    """Each bar with the bars from ``first`` to ``h`` ahead, where all are there: key, bar_ix, split, i, x, r, x0."""
    return f"(SELECT a.key, a.bar_ix, a.split, c.bar_ix - a.bar_ix AS i, c.lc AS x, c.lr AS r, a.lc AS x0 FROM bars a JOIN sizes s ON s.key = a.key JOIN bars c ON c.key = a.key AND c.bar_ix BETWEEN a.bar_ix + {first} AND a.bar_ix + {h} WHERE a.bar_ix + {h} < s.n)"


def forward(h: int) -> str:
    return f"(SELECT a.key, a.bar_ix, a.split, c.lc - a.lc AS f FROM bars a JOIN bars c ON c.key = a.key AND c.bar_ix = a.bar_ix + {h})"


W = "(PARTITION BY key, bar_ix ORDER BY i)"
ALL = "(PARTITION BY key, bar_ix)"


def by_strength(strengths: dict[str, str], quantiles: tuple[float, ...]) -> tuple[str, list[Try]]:
    """Direction of bars whose strength is at least a TRAIN quantile; strengths: by name, queries of key, bar_ix, split, st, di."""
    tables, tries = "", []
    for name, query in strengths.items():
        tables += f"{name} AS MATERIALIZED ({query}),\n"
        for q in quantiles:
            cut = f"(SELECT key, quantile_cont(st, {q}) AS cut FROM {name} WHERE split = 'train' AND st IS NOT NULL GROUP BY key HAVING count(*) >= 100)"
            tries.append((f"SELECT key, bar_ix, CASE WHEN di IS NOT NULL AND st >= cut THEN CASE WHEN di > 0 THEN 1 ELSE 0 END END AS y FROM {name} JOIN {cut} USING (key)", BALANCE))
    return tables, tries


# --- first touches ---

SIGMA = """moves AS (SELECT *, CASE WHEN count(lr) OVER w = 50 THEN stddev_samp(lr) OVER w END AS s FROM bars WINDOW w AS (PARTITION BY key ORDER BY bar_ix ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
sigmas AS MATERIALIZED (
  SELECT key, bar_ix, CASE WHEN s > 0 THEN s WHEN floor > 0 THEN floor ELSE 1e-6 END AS sd
  FROM moves LEFT JOIN (SELECT key, median(s) AS floor FROM moves WHERE split = 'train' AND s IS NOT NULL GROUP BY key) USING (key)
),
"""


def barriers(width: float) -> tuple[str, list[Try]]:
    tries = []
    for h in (50, 100, 200):
        touch = f"SELECT key, bar_ix, arg_min(x - x0, CASE WHEN abs(x - x0) >= {width} * sd THEN i ELSE {h} + 1 - i / 1000.0 END) AS move FROM {path(h, 1)} JOIN sigmas USING (key, bar_ix) GROUP BY key, bar_ix"
        tries.append((f"SELECT key, bar_ix, CASE WHEN move > 0 THEN 1 ELSE 0 END AS y FROM ({touch})", BALANCE))
    return SIGMA, tries


def _rise(width: float = 2.0, h: int = 200) -> str:
    return f"SELECT key, bar_ix, min(i) FILTER (x - x0 >= {width} * sd) AS hit FROM {path(h, 1)} JOIN sigmas USING (key, bar_ix) GROUP BY key, bar_ix"


def survival() -> tuple[str, list[Try]]:
    return SIGMA, [(f"SELECT key, bar_ix, CASE WHEN hit IS NULL THEN 0 ELSE 1 END AS y FROM ({_rise()})", BALANCE)]


def survival_bounds(source: str) -> str:
    return f"""
WITH bars AS MATERIALIZED (SELECT * FROM {source}), sizes AS (SELECT key, count(*) AS n FROM bars GROUP BY key),
{SIGMA.rstrip().rstrip(",")}
SELECT key, bar_ix, coalesce(hit, 200) * 1e0 AS lower, CASE WHEN hit IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE hit * 1e0 END AS upper, hit IS NULL AS censored FROM ({_rise()})"""


def legs(horizons: tuple[int, ...]) -> tuple[str, list[Try]]:
    tables, tries = "", []
    for h in horizons:
        for k in (2.0, 3.5):
            run = f"SELECT *, max(x) OVER {W} AS top, min(x) OVER {W} AS low FROM {path(h)}"
            ends = f"SELECT r.*, sigma, top - x >= {k} * sigma * sqrt(i) AND top > x0 AS fell, x - low >= {k} * sigma * sqrt(i) AND low < x0 AS rose FROM ({run}) r JOIN sizes USING (key) WHERE sigma > 0"
            net = f"SELECT key, bar_ix, any_value(split) AS split, arg_min(CASE WHEN fell THEN top WHEN rose THEN low ELSE x END - x0, CASE WHEN fell OR rose THEN i WHEN i = {h} THEN {h} + 1 ELSE {h} + 2 END) AS di FROM ({ends}) GROUP BY key, bar_ix"
            t, made = by_strength({f"leg{h}_{int(10 * k)}": f"SELECT *, abs(di) AS st FROM ({net})"}, (0.4, 0.5, 0.6))
            tables, tries = tables + t, tries + made
    return tables, tries


# --- statistics of the bars ahead ---


def calmar(h: int) -> str:
    run = f"SELECT *, max(x) OVER {W} - x AS fall, x - min(x) OVER {W} AS rise FROM {path(h)}"
    return f"SELECT key, bar_ix, any_value(split) AS split, max_by(x - x0, i) AS di, abs(max_by(x - x0, i)) / (CASE WHEN max_by(x - x0, i) > 0 THEN max(fall) ELSE max(rise) END + 1e-6) AS st FROM ({run}) GROUP BY key, bar_ix"


def mean_shift(h: int) -> str:
    run = f"SELECT key, bar_ix, split, i, sum(r) OVER {W} AS part, sum(r) OVER {ALL} AS total, stddev_pop(r) OVER {ALL} AS sd FROM {path(h, 1)}"
    cut = f"SELECT key, bar_ix, split, i, (total - part) / ({h} - i) AS di, abs((total - part) / ({h} - i) - part / i) * sqrt(i * ({h} - i) / {h}.0) / greatest(sd, 1e-9) AS st FROM ({run}) WHERE i BETWEEN 3 AND {h} - 3"
    return f"SELECT key, bar_ix, split, st, di FROM ({cut}) QUALIFY row_number() OVER (PARTITION BY key, bar_ix ORDER BY st DESC, i) = 1"


def variance_break(h: int) -> str:
    run = f"SELECT key, bar_ix, split, i, sum(r * r) OVER {W} AS part, sum(r * r) OVER {ALL} AS total FROM {path(h, 1)}"
    cut = f"SELECT key, bar_ix, split, i, part / i - (total - part) / ({h} - i) AS di, sqrt({h} / 2.0) * abs(part / total - i / {h}.0) AS st FROM ({run}) WHERE i < {h} AND total > 1e-18"
    return f"SELECT key, bar_ix, split, st, di FROM ({cut}) QUALIFY row_number() OVER (PARTITION BY key, bar_ix ORDER BY st DESC, i) = 1"


def recursive_break(h: int) -> str:
    """One-step errors of a line through all earlier points; u is the place of a point, from 0."""
    before = "(PARTITION BY key, bar_ix ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    fit = f"SELECT key, bar_ix, split, i - 1 AS u, x, x0, avg(i - 1) OVER {before} AS mu, avg(x) OVER {before} AS mx, covar_pop(x, i - 1) OVER {before} * (i - 1) AS sxy, var_pop(i - 1) OVER {before} * (i - 1) AS sxx FROM {path(h, 1)}"
    least = max(4, h // 10)
    error = f"SELECT *, (x - mx - sxy / sxx * (u - mu)) / sqrt(1 + 1.0 / u + (u - mu) * (u - mu) / sxx) AS e FROM ({fit}) WHERE u >= {least}"
    walk = f"SELECT *, sum(e) OVER (PARTITION BY key, bar_ix ORDER BY u) / sqrt(greatest(avg(e * e) OVER {ALL}, 1e-24)) AS c FROM ({error})"
    return f"SELECT key, bar_ix, any_value(split) AS split, max(abs(c)) / sqrt({h - least}.0) AS st, max_by(x - x0, u) AS di FROM ({walk}) GROUP BY key, bar_ix"


def explosive(h: int) -> str:
    least = max(10, h // 4)
    starts = ", ".join(f"({s})" for s in range(0, h - least + 1, max(1, (h - least) // 4)))
    steps = f"SELECT *, lead(x) OVER {W} - x AS d FROM {path(h)}"
    sums = f"SELECT key, bar_ix, any_value(split) AS split, first, count(d) AS n, var_pop(x) * count(d) AS sxx, covar_pop(d, x) * count(d) AS sxy, var_pop(d) * count(d) AS syy FROM ({steps}) JOIN (VALUES {starts}) v(first) ON i >= first AND d IS NOT NULL GROUP BY key, bar_ix, first"
    fits = f"SELECT key, bar_ix, split, CASE WHEN sxx >= 1e-12 AND sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) > 1e-12 THEN sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) ELSE -1e9 END AS t FROM ({sums})"
    return f"SELECT key, bar_ix, any_value(e.split) AS split, max(t) AS st, any_value(f) AS di FROM ({fits}) e JOIN {forward(h)} USING (key, bar_ix) GROUP BY key, bar_ix"


def persistence(h: int) -> str:
    """Slope of the log of detrended fluctuations against the log of their scale."""
    scales = [max(4, h // 8), max(5, h // 4), max(6, h // 2)]
    walk = f"SELECT key, bar_ix, split, i - 1 AS u, sum(x - m) OVER {W} AS z FROM (SELECT *, avg(x) OVER {ALL} AS m FROM {path(h, 1)})"
    parts = f"SELECT key, bar_ix, any_value(split) AS split, s, u // s AS part, sqrt(greatest(0.0, var_pop(z) - covar_pop(z, u) * covar_pop(z, u) / var_pop(u))) AS f FROM ({walk}), (VALUES {', '.join(f'({s})' for s in scales)}) v(s) WHERE u < {h} // s * s GROUP BY key, bar_ix, s, u // s"
    sizes = f"SELECT key, bar_ix, any_value(split) AS split, s, ln(avg(f) + 1e-12) AS f FROM ({parts}) GROUP BY key, bar_ix, s"
    return f"SELECT key, bar_ix, any_value(e.split) AS split, regr_slope(f, ln(s)) AS st, any_value(g.f) AS di FROM ({sizes}) e JOIN {forward(h)} g USING (key, bar_ix) GROUP BY key, bar_ix".replace("regr_slope(f,", "regr_slope(e.f,")


def sign_memory(h: int) -> str:
    lags = ", ".join(f"lead(s, {k}) OVER (PARTITION BY key ORDER BY bar_ix) AS s{k}" for k in range(1, 6))
    corr = []
    for k in range(1, 6):
        w = f"(PARTITION BY key ORDER BY bar_ix ROWS BETWEEN CURRENT ROW AND {h - 1 - k} FOLLOWING)"
        size = f"sqrt(var_pop(s) OVER {w} * var_pop(s{k}) OVER {w})"
        corr.append(f"CASE WHEN {size} > 1e-12 THEN covar_pop(s, s{k}) OVER {w} / {size} END AS c{k}")
    total = " + ".join(f"coalesce(c{k}, 0)" for k in range(1, 6))
    known = " + ".join(f"CASE WHEN c{k} IS NULL THEN 0 ELSE 1 END" for k in range(1, 6))
    rows = f"SELECT key, bar_ix, split, {', '.join(corr)} FROM (SELECT *, {lags} FROM (SELECT *, CAST(sign(lr) AS DOUBLE) AS s FROM bars))"
    return f"SELECT key, bar_ix, e.split, round(({total}) / nullif({known}, 0), 12) AS st, f AS di FROM ({rows}) e JOIN {forward(h)} USING (key, bar_ix)"


def visibility(h: int) -> str:
    """By the next higher and the last not lower bar of each bar of the series."""
    links = "links"
    inside = f"SELECT a.key, a.bar_ix, a.split, count(*) FILTER (l.next <= a.bar_ix + {h} + 1) + count(*) FILTER (l.back > a.bar_ix AND l.same) AS up, count(*) FILTER (l.back > a.bar_ix AND NOT l.same) AS down FROM bars a JOIN sizes s ON s.key = a.key JOIN {links} l ON l.key = a.key AND l.bar_ix BETWEEN a.bar_ix + 1 AND a.bar_ix + {h} + 1 WHERE a.bar_ix + {h} + 1 < s.n GROUP BY ALL"
    return f"SELECT key, bar_ix, split, abs((up - down) / greatest(1, up + down)) AS st, (up - down) / greatest(1, up + down) AS di FROM ({inside})"


LINKS = """links AS MATERIALIZED (
  SELECT a.key, a.bar_ix, min(c.bar_ix) FILTER (c.bar_ix > a.bar_ix AND c.lc > a.lc) AS next, max(c.bar_ix) FILTER (c.bar_ix < a.bar_ix AND c.lc >= a.lc) AS back,
    arg_max(c.lc = a.lc, c.bar_ix) FILTER (c.bar_ix < a.bar_ix AND c.lc >= a.lc) AS same
  FROM bars a JOIN bars c ON c.key = a.key AND c.bar_ix BETWEEN a.bar_ix - 161 AND a.bar_ix + 161 GROUP BY a.key, a.bar_ix
),
"""


def information_flow(h: int) -> str:
    """What the symbol before (b) adds about the next (c) beyond the one two back (a), in bits."""
    cuts = f"SELECT key, quantile_cont(r, 1 / 3.0) AS low, quantile_cont(r, 2 / 3.0) AS high FROM {path(h, 1)} WHERE split = 'train' GROUP BY key HAVING count(DISTINCT bar_ix) >= 50 AND quantile_cont(r, 1 / 3.0) < quantile_cont(r, 2 / 3.0)"
    marks = f"SELECT key, bar_ix, CASE WHEN lr > high THEN 2 WHEN lr > low THEN 1 ELSE 0 END AS s FROM bars JOIN ({cuts}) USING (key)"
    triples = f"SELECT key, bar_ix, s AS c, lag(s) OVER o AS b, lag(s, 2) OVER o AS a FROM ({marks}) WINDOW o AS (PARTITION BY key ORDER BY bar_ix)"
    inside = f"SELECT p.key, p.bar_ix, p.split, a, b, c, count(*) AS k FROM bars p JOIN sizes z ON z.key = p.key JOIN ({triples}) t ON t.key = p.key AND t.bar_ix BETWEEN p.bar_ix + 3 AND p.bar_ix + {h} WHERE p.bar_ix + {h} < z.n GROUP BY ALL"
    sums = f"SELECT *, k / {h - 2}.0 AS p, sum(k) OVER (PARTITION BY key, bar_ix, a, c) / {h - 2}.0 AS pac, sum(k) OVER (PARTITION BY key, bar_ix, a, b) / {h - 2}.0 AS pab, sum(k) OVER (PARTITION BY key, bar_ix, a) / {h - 2}.0 AS pa FROM ({inside})"
    return f"SELECT key, bar_ix, any_value(e.split) AS split, round(greatest(0.0, sum(p * ln(p * pa / (pab * pac))) / ln(2.0)), 12) AS st, any_value(f) AS di FROM ({sums}) e JOIN {forward(h)} USING (key, bar_ix) GROUP BY key, bar_ix"


def excursion() -> tuple[str, list[Try]]:
    tables, tries = "", []
    for h in (40, 80):
        past = f"SELECT key, bar_ix, CASE WHEN count(lr) OVER w = {h} THEN stddev_pop(lr) OVER w END AS past FROM bars WINDOW w AS (PARTITION BY key ORDER BY bar_ix ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING)"
        run = f"SELECT *, max(x) OVER {W} - x AS fall FROM {path(h)}"
        tables += f"ex{h} AS MATERIALIZED (SELECT key, bar_ix, any_value(split) AS split, any_value(x0) AS x0, any_value(past) AS past, sqrt(avg(fall * fall) FILTER (i > 0)) AS ulcer, max(x) FILTER (i > 0) AS top FROM ({run}) JOIN ({past}) USING (key, bar_ix) WHERE past > 0 GROUP BY key, bar_ix),\n"
        for k in (0.5, 1.0):
            tables += f"ex{h}_{int(10 * k)} AS MATERIALIZED (SELECT *, top >= x0 + {k} * past * sqrt({h}.0) AS reach FROM ex{h}),\n"
            for q in (0.5, 0.7):
                cut = f"SELECT key, quantile_cont(ulcer, {q}) AS cut FROM ex{h}_{int(10 * k)} WHERE reach AND split = 'train' GROUP BY key HAVING count(*) >= 60"
                tries.append((f"SELECT key, bar_ix, CASE WHEN reach AND ulcer <= cut THEN 1 ELSE 0 END AS y FROM ex{h}_{int(10 * k)} JOIN ({cut}) USING (key)", BALANCE))
    return tables, tries


def best_action(cost: float = 0.0005) -> tuple[str, list[Try]]:
    """Values of short, flat and long, back from the last move."""
    tables, tries = "", []
    for h in (50, 100, 200):
        step = "SELECT v.key, v.bar_ix, v.j - 1 AS j, -m.lr + greatest(s, f - {c}, l - 2 * {c}) AS s, greatest(s - {c}, f, l - {c}) AS f, m.lr + greatest(s - 2 * {c}, f - {c}, l) AS l".format(c=cost)
        tables += f"dp{h} AS (SELECT a.key, a.bar_ix, {h} AS j, -m.lr AS s, 0.0 * m.lr AS f, m.lr AS l FROM bars a JOIN bars m ON m.key = a.key AND m.bar_ix = a.bar_ix + {h} UNION ALL {step} FROM dp{h} v JOIN bars m ON m.key = v.key AND m.bar_ix = v.bar_ix + v.j - 1 WHERE v.j > 1),\n"
        tries.append((f"SELECT key, bar_ix, CASE WHEN l - {cost} > f AND l > s THEN 1 ELSE 0 END AS y FROM dp{h} WHERE j = 1", "-abs(bt - 0.5)"))
    return tables, tries


# --- turning points of the path so far ---


def _turns(name: str, k: float) -> str:
    """The trend after each bar, and whether it turned there."""
    return f"""{name} AS (
  SELECT b.key, b.bar_ix, 1 AS trend, b.lc AS extreme, FALSE AS turned, {k} * sigma AS back FROM bars b JOIN sizes USING (key) WHERE b.bar_ix = 0 AND train >= 50 AND sigma > 0
  UNION ALL
  SELECT b.key, b.bar_ix, CASE WHEN (t.extreme - b.lc) * t.trend >= t.back THEN -t.trend ELSE t.trend END, CASE WHEN (b.lc - t.extreme) * t.trend > 0 OR (t.extreme - b.lc) * t.trend >= t.back THEN b.lc ELSE t.extreme END, (t.extreme - b.lc) * t.trend >= t.back, t.back
  FROM {name} t JOIN bars b ON b.key = t.key AND b.bar_ix = t.bar_ix + 1
),
"""


def _next_event(events: str, value: str) -> str:
    """Value of the first event behind each bar within 200 bars; keys with 20 events or more."""
    enough = f"(SELECT key FROM {events} GROUP BY key HAVING count(*) >= 20)"
    return f"SELECT b.key, b.bar_ix, CASE WHEN e.bar_ix - b.bar_ix <= 200 THEN e.{value} END AS y FROM bars b JOIN {enough} USING (key) ASOF LEFT JOIN {events} e ON e.key = b.key AND e.bar_ix > b.bar_ix"


def trend_now() -> tuple[str, list[Try]]:
    ks = (3.0, 5.0, 8.0, 12.0)
    return "".join(_turns(f"turn{int(k)}", k) for k in ks), [(f"SELECT key, bar_ix, CASE WHEN trend > 0 THEN 1 ELSE 0 END AS y FROM turn{int(k)}", f"-{k}") for k in ks]


def reversal_ahead() -> tuple[str, list[Try]]:
    ks = (3.0, 5.0, 8.0)
    tables = "".join(_turns(f"turn{int(k)}", k) + f"event{int(k)} AS MATERIALIZED (SELECT key, bar_ix, CASE WHEN trend > 0 THEN 1 ELSE 0 END AS up FROM turn{int(k)} WHERE turned),\n" for k in ks)
    return tables, [(_next_event(f"event{int(k)}", "up"), f"-{k}") for k in ks]


def line_break() -> tuple[str, list[Try]]:
    """The last three lines are l1 (latest), l2 and l3."""
    tables, tries = "", []
    for k in (0.5, 1.0, 1.5, 2.0, 3.0):
        name = f"line{int(10 * k)}"
        going = f"SELECT t.*, b.bar_ix AS pos, b.lc AS x, (t.trend >= 0 AND b.lc >= t.l1 + t.gap) AS rises, (t.trend <= 0 AND b.lc <= t.l1 - t.gap) AS falls, (t.trend > 0 AND b.lc <= least(t.l1, t.l2, t.l3)) OR (t.trend < 0 AND b.lc >= greatest(t.l1, t.l2, t.l3)) AS turns FROM {name} t JOIN bars b ON b.key = t.key AND b.bar_ix = t.bar_ix + 1"
        tables += f"""{name} AS (
  SELECT b.key, CAST(-1 AS BIGINT) AS bar_ix, b.lc AS l1, CAST(NULL AS DOUBLE) AS l2, CAST(NULL AS DOUBLE) AS l3, 0 AS trend, CAST(NULL AS INTEGER) AS turned, {k} * sigma AS gap FROM bars b JOIN sizes USING (key) WHERE b.bar_ix = 0 AND train >= 50 AND sigma > 0
  UNION ALL
  SELECT key, pos, CASE WHEN rises OR falls OR turns THEN x ELSE l1 END, CASE WHEN rises OR falls OR turns THEN l1 ELSE l2 END, CASE WHEN rises OR falls OR turns THEN l2 ELSE l3 END,
    CASE WHEN rises THEN 1 WHEN falls THEN -1 WHEN turns THEN -trend ELSE trend END, CASE WHEN rises OR falls THEN 0 WHEN turns THEN 1 END, gap FROM ({going})
),
event{name} AS MATERIALIZED (SELECT key, bar_ix, turned FROM {name} WHERE turned IS NOT NULL),
"""
        tries.append((_next_event(f"event{name}", "turned"), "-abs(bt - 0.5)"))
    return tables, tries


# --- models of the path ---


def _hits(labels: str, h: int, price: str, least: int = 0) -> str:
    """Share of VAL labels that the next h bars bear out, less a price."""
    return f"SELECT key, avg(CASE WHEN (l.y = 1) = (g.f > 0) THEN 1.0 ELSE 0.0 END) - {price} AS s FROM {labels} l JOIN {forward(h)} g USING (key, bar_ix) WHERE g.split = 'val' AND l.y IS NOT NULL GROUP BY key HAVING count(*) >= {least}"


def threshold_model() -> tuple[str, list[Try]]:
    """Two autoregressions, by the sign of a lagged return beyond a threshold."""
    back = lambda k: f"coalesce(lag(lr, {k}) OVER (PARTITION BY key ORDER BY bar_ix), 0.0)"
    tables = f"lags AS MATERIALIZED (SELECT key, bar_ix, split, lr, {back(1)} AS z1, {back(2)} AS z2, {back(3)} AS z3 FROM bars),\n"
    grid = "[" + ", ".join(repr(0.15 + k * 0.7 / 16) for k in range(17)) + "]"
    tries = []
    for d in (1, 2, 3):
        for p in (1, 2):
            name, x2 = f"ar{d}{p}", "z2" if p == 2 else "0.0"
            det = "(s11 * s22 - s12 * s12)" if p == 2 else "s11"
            b1 = f"(s1y * s22 - s2y * s12) / {det}" if p == 2 else "s1y / s11"
            b2 = f"(s2y * s11 - s1y * s12) / {det}" if p == 2 else "0.0"
            tables += f"""{name}_fit AS MATERIALIZED (SELECT * FROM lags JOIN sizes USING (key) WHERE split = 'train' AND bar_ix >= {max(d, p)} AND train >= 200),
{name}_cut AS MATERIALIZED (SELECT key, generate_subscripts(c, 1) AS i, unnest(c) AS c FROM (SELECT key, quantile_cont(z{d}, {grid}) AS c FROM {name}_fit GROUP BY key)),
{name}_sum AS (SELECT key, i, any_value(c) AS c, z{d} > c AS high, count(*) AS n, avg(lr) AS my, avg(z1) AS m1, avg({x2}) AS m2, var_pop(lr) * count(*) AS syy, var_pop(z1) * count(*) AS s11, var_pop({x2}) * count(*) AS s22, covar_pop(z1, {x2}) * count(*) AS s12, covar_pop(z1, lr) * count(*) AS s1y, covar_pop({x2}, lr) * count(*) AS s2y FROM {name}_fit JOIN {name}_cut USING (key) GROUP BY key, i, z{d} > c),
{name}_law AS MATERIALIZED (SELECT *, syy - b1 * s1y - b2 * s2y AS loss, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *, {b1} AS b1, {b2} AS b2 FROM {name}_sum)),
{name}_best AS (SELECT key, i FROM {name}_law GROUP BY key, i HAVING count(*) = 2 AND min(n) >= {p + 2} QUALIFY row_number() OVER (PARTITION BY key ORDER BY sum(loss), i) = 1),
{name} AS MATERIALIZED (SELECT l.key, l.bar_ix, l.split, CASE WHEN l.bar_ix >= {max(d, p)} THEN CASE WHEN w.b0 + w.b1 * z1 + w.b2 * {x2} > 0 THEN 1 ELSE 0 END END AS y FROM lags l JOIN {name}_best USING (key) JOIN {name}_law w ON w.key = l.key AND w.i = {name}_best.i AND w.high = (l.z{d} > w.c)),
"""
            tries += [(f"SELECT key, bar_ix, y FROM {name}", _hits(name, h, repr(0.02 * p), 20)) for h in (50, 100, 200)]
    return tables, tries


def smoothed_trend() -> tuple[str, list[Try]]:
    """Slope of a local linear trend, smoothed apart before TEST and from it."""
    ahead = "x0 + x1 AS a0, x1 AS a1, p00 + p01 + p10 + p11 + ql AS a00, p01 + p11 AS a01, p10 + p11 AS a10, p11 + qs AS a11"
    step = "a0 + a00 / (a00 + noise) * (lc - a0) AS x0, a1 + a10 / (a00 + noise) * (lc - a0) AS x1, a00 - a00 / (a00 + noise) * a00 AS p00, a01 - a00 / (a00 + noise) * a01 AS p01, a10 - a10 / (a00 + noise) * a00 AS p10, a11 - a10 / (a00 + noise) * a01 AS p11"
    tables = f"""noises AS (SELECT key, var_pop(lr) AS noise FROM bars WHERE split = 'train' GROUP BY key HAVING count(*) >= 300 AND var_pop(lr) > 0),
grid AS (SELECT key, noise, noise * a AS ql, noise * c AS qs, 3 * i + j AS g FROM noises, (VALUES (0.01, 0), (1.0, 1), (100.0, 2)) u(a, i), (VALUES (1e-6, 0), (1e-4, 1), (1e-2, 2)) v(c, j)),
walk AS (
  SELECT key, g, noise, ql, qs, 0::BIGINT AS bar_ix, lc AS x0, 0.0::DOUBLE AS x1, 1e4::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p10, 1e4::DOUBLE AS p11, 0.0::DOUBLE AS fit FROM grid JOIN bars USING (key) WHERE bar_ix = 0
  UNION ALL
  SELECT key, g, noise, ql, qs, ix, {step}, fit - 0.5 * (ln(2 * pi() * (a00 + noise)) + (lc - a0) * (lc - a0) / (a00 + noise))
  FROM (SELECT w.key, w.g, w.noise, w.ql, w.qs, w.fit, b.bar_ix AS ix, b.lc, {ahead} FROM walk w JOIN bars b ON b.key = w.key AND b.bar_ix = w.bar_ix + 1 AND b.split = 'train')
),
chosen_noise AS MATERIALIZED (SELECT key, noise, ql, qs FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY bar_ix DESC, fit DESC, g) = 1),
runs AS MATERIALIZED (SELECT key, bar_ix, split, lc, split = 'test' AS late, row_number() OVER (PARTITION BY key, split = 'test' ORDER BY bar_ix) AS i, count(*) OVER (PARTITION BY key, split = 'test') AS n FROM bars),
filtered AS (
  SELECT r.key, r.late, r.i, r.n, c.noise, c.ql, c.qs, r.lc AS x0, 0.0::DOUBLE AS x1, 1e4::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p10, 1e4::DOUBLE AS p11, NULL::DOUBLE AS a0, NULL::DOUBLE AS a1, NULL::DOUBLE AS a00, NULL::DOUBLE AS a01, NULL::DOUBLE AS a10, NULL::DOUBLE AS a11 FROM runs r JOIN chosen_noise c USING (key) WHERE r.i = 1 AND r.n > 1
  UNION ALL
  SELECT key, late, nx, n, noise, ql, qs, {step}, a0, a1, a00, a01, a10, a11
  FROM (SELECT f.key, f.late, f.n, f.noise, f.ql, f.qs, r.i AS nx, r.lc, {ahead} FROM filtered f JOIN runs r ON r.key = f.key AND r.late = f.late AND r.i = f.i + 1)
),
states AS MATERIALIZED (SELECT f.*, lead(a0) OVER w AS n0, lead(a1) OVER w AS n1, lead(a00) OVER w AS n00, lead(a01) OVER w AS n01, lead(a10) OVER w AS n10, lead(a11) OVER w AS n11 FROM filtered f WINDOW w AS (PARTITION BY key, late ORDER BY i)),
smooth AS (
  SELECT key, late, i, x0 AS s0, x1 AS s1 FROM states WHERE i = n
  UNION ALL
  SELECT key, late, i, x0 + (p00 + p01) * d0 + p01 * d1, x1 + (p10 + p11) * d0 + p11 * d1
  FROM (SELECT *, (n11 * e0 - n01 * e1) / (n00 * n11 - n01 * n10) AS d0, (n00 * e1 - n10 * e0) / (n00 * n11 - n01 * n10) AS d1 FROM (SELECT t.*, s0 - n0 AS e0, s1 - n1 AS e1 FROM smooth s JOIN states t ON t.key = s.key AND t.late = s.late AND t.i = s.i - 1))
),
slopes AS MATERIALIZED (SELECT r.key, r.bar_ix, r.split, s1 FROM smooth JOIN runs r USING (key, late, i)),
"""
    return tables, [(f"SELECT key, bar_ix, CASE WHEN s1 >= cut THEN 1 ELSE 0 END AS y FROM slopes JOIN (SELECT key, quantile_cont(s1, {q}) AS cut FROM slopes WHERE split = 'train' GROUP BY key) USING (key)", BALANCE) for q in _Q]


def segments() -> tuple[str, list[Try]]:
    """Sign of a slow mean that restarts behind change points; their limit leaves so many segments on TRAIN."""
    changes = Fold(
        {"u": "0.0::DOUBLE", "d": "0.0::DOUBLE"},
        {"u": "greatest(0.0, CASE WHEN {ended} THEN 0.0 ELSE s.u END + x.v - slack)", "d": "least(0.0, CASE WHEN {ended} THEN 0.0 ELSE s.d END + x.v + slack)"},
        "(s.u >= {t} OR -s.d >= {t})",
    )
    tables = """zs AS (SELECT key, bar_ix, split, lr, (lr - m) / sd AS z FROM bars JOIN (SELECT key, avg(lr) AS m, stddev_pop(lr) AS sd FROM bars WHERE split = 'train' GROUP BY key HAVING count(*) >= 200 AND stddev_pop(lr) > 0) USING (key)),
zl AS MATERIALIZED (SELECT key, list({'v': z, 'i': bar_ix} ORDER BY bar_ix) AS v, list({'v': z, 'i': bar_ix} ORDER BY bar_ix) FILTER (split = 'train') AS w, 0.1 * avg(abs(z)) FILTER (split = 'train') AS slack FROM zs GROUP BY key),
cs0 AS MATERIALIZED (SELECT zl.*, wanted, 0.5::DOUBLE AS lo, 5000.0::DOUBLE AS hi FROM zl, (VALUES (10), (20), (40)) u(wanted)),
"""
    for k in range(40):
        tables += f"cm{k} AS (SELECT *, (lo + hi) / 2 AS t FROM cs{k}), cc{k} AS MATERIALIZED (SELECT *, {changes.count('w', 't')} AS c FROM cm{k}), cs{k + 1} AS MATERIALIZED (SELECT key, v, w, slack, wanted, CASE WHEN c + 1 > wanted THEN t ELSE lo END AS lo, CASE WHEN c + 1 > wanted THEN hi ELSE t END AS hi FROM cc{k}),\n"
    tables += f"""ch AS MATERIALIZED (SELECT key, wanted, {changes.hits('v', 't')} AS turned FROM (SELECT *, (lo + hi) / 2 AS t FROM cs40)),
slow AS (
  SELECT b.key, wanted, b.bar_ix, b.lr AS mean FROM bars b JOIN ch USING (key) WHERE b.bar_ix = 0
  UNION ALL SELECT b.key, s.wanted, b.bar_ix, CASE WHEN list_contains(c.turned, s.bar_ix) THEN b.lr ELSE 0.05 * b.lr + 0.95 * s.mean END FROM slow s JOIN ch c ON c.key = s.key AND c.wanted = s.wanted JOIN bars b ON b.key = s.key AND b.bar_ix = s.bar_ix + 1
),
"""
    tries = []
    for wanted in (10, 20, 40):
        for h in (50, 100, 200):
            name = f"seg{wanted}_{h}"
            tables += f"{name} AS MATERIALIZED (SELECT s.key, s.bar_ix, CASE WHEN mean > 0 THEN 1 ELSE 0 END AS y FROM slow s JOIN {forward(h)} USING (key, bar_ix) WHERE wanted = {wanted}),\n"
            score = _hits(name, h, "0.0008 * (any_value(len(turned)) + 1)").replace(f"FROM {name} l JOIN", f"FROM {name} l JOIN (SELECT key, turned FROM ch WHERE wanted = {wanted}) USING (key) JOIN")
            tries.append((f"SELECT key, bar_ix, y FROM {name}", score))
    return tables, tries


def break_ahead(most: int = 300) -> tuple[str, list[Try]]:
    """Chance that a regime begins within the next bars, by lists over how long the present one has run."""
    scale = "greatest(e.beta * (e.k + 1) / (e.a * e.k), 1e-300)"
    fit = f"e.logp + lgamma(e.a + 0.5) - lgamma(e.a) - 0.5 * ln(2 * e.a * pi() * {scale}) - (e.a + 0.5) * ln(1 + (v - e.mu) * (v - e.mu) / (2 * e.a * {scale}))"
    grown = "{'mu': (e.k * e.mu + v) / (e.k + 1), 'k': e.k + 1, 'a': e.a + 0.5, 'beta': e.beta + e.k * (v - e.mu) * (v - e.mu) / (2 * (e.k + 1)), 'logp': e.joint + ln(1 - hazard)}"
    tables = f"""priors AS (SELECT key, avg(lr) AS m, var_pop(lr) AS va, count(*) AS n FROM bars WHERE split = 'train' GROUP BY key HAVING count(*) >= 300 AND stddev_pop(lr) > 0),
beliefs AS (
  SELECT key, wanted, m, va, wanted / n AS hazard, CAST(-1 AS BIGINT) AS bar_ix, [{{'mu': m, 'k': 1.0::DOUBLE, 'a': 1.0::DOUBLE, 'beta': va, 'logp': 0.0::DOUBLE}}] AS runs, 0.0::DOUBLE AS p FROM priors, (VALUES (10.0::DOUBLE), (20.0), (40.0)) u(wanted)
  UNION ALL
  SELECT key, wanted, m, va, hazard, ix, list_transform(grown, lambda e: {{'mu': e.mu, 'k': e.k, 'a': e.a, 'beta': e.beta, 'logp': e.logp - total}}), exp(grown[1].logp - total)
  FROM (SELECT *, top2 + ln(list_sum(list_transform(grown, lambda e: exp(e.logp - top2)))) AS total FROM (SELECT *, list_max(list_transform(grown, lambda e: e.logp)) AS top2 FROM (
    SELECT *, list_concat([{{'mu': m, 'k': 1.0::DOUBLE, 'a': 1.0::DOUBLE, 'beta': va, 'logp': top + ln(list_sum(list_transform(seen, lambda e: exp(e.joint - top))) * hazard)}}], list_transform(seen, lambda e: {grown}))[1:{most}] AS grown FROM (
      SELECT *, list_max(list_transform(seen, lambda e: e.joint)) AS top FROM (
        SELECT b.key, s.wanted, s.m, s.va, s.hazard, x.bar_ix AS ix, x.lr AS v, list_transform(s.runs, lambda e: {{'mu': e.mu, 'k': e.k, 'a': e.a, 'beta': e.beta, 'joint': {fit.replace('v -', 'x.lr -')}}}) AS seen
        FROM beliefs s JOIN priors b ON b.key = s.key JOIN bars x ON x.key = s.key AND x.bar_ix = s.bar_ix + 1)))))
),
breaks AS MATERIALIZED (SELECT key, CAST(wanted AS INTEGER) AS wanted, bar_ix, split, p FROM beliefs JOIN bars USING (key, bar_ix)),
"""
    tries = []
    for wanted in (10, 20, 40):
        for h in (50, 100, 200):
            name = f"top{wanted}_{h}"
            w = f"(PARTITION BY key ORDER BY bar_ix ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
            tables += f"{name} AS MATERIALIZED (SELECT key, bar_ix, split, p, CASE WHEN count(p) OVER {w} = {h} THEN max(p) OVER {w} END AS top FROM breaks WHERE wanted = {wanted}),\n"
            for q in (0.5, 0.6, 0.7):
                tries.append((f"SELECT key, bar_ix, CASE WHEN top IS NOT NULL THEN CASE WHEN top >= cut THEN 1 ELSE 0 END END AS y FROM {name} JOIN (SELECT key, quantile_cont(p, {q}) AS cut FROM {name} WHERE split = 'train' GROUP BY key) USING (key)", BALANCE))
    return tables, tries


def return_shapes() -> tuple[str, list[Try]]:
    """k-medians of the sorted returns ahead; TRAIN windows of up to 2,500 bars are all fitted."""
    tables, tries = "", []
    for h in (60, 120):
        tables += f"""sw{h} AS MATERIALIZED (SELECT key, bar_ix, split, row_number() OVER (PARTITION BY key, bar_ix ORDER BY r) AS pos, r FROM {path(h, 1)} JOIN sizes USING (key) WHERE bar_ix + {h} + 1 < n),
so{h} AS (SELECT key, bar_ix, row_number() OVER (PARTITION BY key ORDER BY avg(r), bar_ix) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM sw{h} WHERE split = 'train' GROUP BY key, bar_ix),
"""
        for k in (2, 3):
            name = f"sk{h}_{k}"
            tables += f"{name}_c0 AS MATERIALIZED (SELECT w.key, c, w.pos, w.r AS m FROM so{h} o, range({k}) u(c), sw{h} w WHERE o.n >= 200 AND o.place = CAST(floor((c + 0.5) / {k} * (o.n - 1)) AS BIGINT) AND w.key = o.key AND w.bar_ix = o.bar_ix),\n"
            near = f"SELECT key, bar_ix, any_value(split) AS split, c, avg(abs(r - m)) AS d FROM sw{h} JOIN {{c}} USING (key, pos) {{where}} GROUP BY key, bar_ix, c"
            own = "SELECT key, bar_ix, split, c FROM ({near}) QUALIFY row_number() OVER (PARTITION BY key, bar_ix ORDER BY d, c) = 1"
            for r in range(8):
                tables += f"{name}_c{r + 1} AS MATERIALIZED (SELECT key, c, pos, coalesce(n.m, o.m) AS m FROM {name}_c{r} o LEFT JOIN (SELECT w.key, a.c, w.pos, median(w.r) AS m FROM ({own.format(near=near.format(c=f'{name}_c{r}', where=chr(87) + 'HERE split = ' + chr(39) + 'train' + chr(39)))}) a JOIN sw{h} w USING (key, bar_ix) GROUP BY w.key, a.c, w.pos) n USING (key, c, pos)),\n"
            tables += f"{name} AS MATERIALIZED ({own.format(near=near.format(c=f'{name}_c8', where=''))}),\n"
            up = f"SELECT s.key, c, CASE WHEN count(*) >= 20 AND avg(f) > 0 THEN 1 ELSE 0 END AS up FROM {name} s JOIN {forward(h)} USING (key, bar_ix) WHERE s.split = 'train' GROUP BY s.key, c"
            tries.append((f"SELECT s.key, s.bar_ix, coalesce(up, 0) AS y FROM {name} s JOIN {forward(h)} USING (key, bar_ix) LEFT JOIN ({up}) USING (key, c)", BALANCE))
    return tables, tries


def _by(horizons: tuple[int, ...], statistic, quantiles: tuple[float, ...]) -> tuple[str, list[Try]]:
    return by_strength({f"st{h}": statistic(h) for h in horizons}, quantiles)


_Q = (0.4, 0.5, 0.6)


def _visible() -> tuple[str, list[Try]]:
    tables, tries = _by((40, 80, 160), visibility, _Q)
    return LINKS + tables, tries


#: Tables and tries of each labeler, and its gates.
CHECKS = {
    "triple_barrier": (lambda: barriers(2.0), {}),
    "triple_barrier_tight": (lambda: barriers(1.5), {}),
    "triple_barrier_meta": (lambda: barriers(2.0), {}),
    "triple_barrier_tight_meta": (lambda: barriers(1.5), {}),
    "triple_barrier_ae": (lambda: barriers(2.0), {}),
    "survival_aft": (survival, {"least": (0, 0), "share": (-1, 2)}),
    "dp_oracle": (best_action, {"least": (200, 0), "share": (-1, 2)}),
    "dc_reversal": (reversal_ahead, {"least": (0, 0), "share": (0.25, 0.75)}),
    "dc_trend": (trend_now, {"least": (0, 0), "share": (0.25, 0.75)}),
    "trend_leg": (lambda: legs((40, 80)), {}),
    "tleg_fast": (lambda: legs((20,)), {}),
    "tleg_mid": (lambda: legs((60,)), {}),
    "tleg_slow": (lambda: legs((150,)), {}),
    "ofsc": (lambda: _by((50, 100, 200), sign_memory, _Q), {}),
    "bde_cusum": (lambda: _by((100, 200), recursive_break, (0.5, 0.6, 0.7)), {}),
    "changepoint": (lambda: _by((40, 80, 150), mean_shift, (0.5, 0.6, 0.7)), {}),
    "calmar_scan": (lambda: _by((40, 80), calmar, (0.4, 0.5, 0.6, 0.7)), {}),
    "dd_excursion": (excursion, {}),
    "sadf_explosive": (lambda: _by((100, 200), explosive, (0.5, 0.7, 0.85)), {}),
    "hurst_persist": (lambda: _by((80, 160), persistence, _Q), {}),
    "transfer_entropy_dir": (lambda: _by((50, 100, 200), information_flow, _Q), {}),
    "visgraph": (_visible, {}),
    "icss_var": (lambda: _by((60, 120, 200), variance_break, (0.5, 0.6, 0.7)), {}),
    "setar": (threshold_model, {"least": (100, 0)}),
    "kllt": (smoothed_trend, {"share": (0.1, 0.9)}),
    "cusum_regime": (segments, {"least": (200, 20)}),
    "bocpd_label": (break_ahead, {}),
    "sliced_wasserstein": (return_shapes, {}),
    "tlb_reversal": (line_break, {"least": (100, 0), "share": (0.15, 0.85)}),
}


def check(source: str, name: str) -> str:
    made, gates = CHECKS[name]
    tables, tries = made()
    return chosen(source, tables, tries, **gates)
