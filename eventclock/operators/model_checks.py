"""SQL of reducers and calibrations for the checking engine.

Features are a long table (key, bar_ix, j, x, fits, y); a reducer is a table of columns
picked or of weights.  Principal directions come from squaring the matrix again and again,
which leaves the strongest one.
"""

from __future__ import annotations


def _moments(source: str, columns: list[str], ranked: bool) -> str:
    """rows, f (long), m (mean, scale), c (correlation of each two columns), wy (with the label)."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    long = " UNION ALL ".join(f"SELECT key, bar_ix, {j} AS j, CAST({c} AS DOUBLE) AS x, fits, y FROM rows" for j, c in enumerate(columns))
    v = "rank() OVER (PARTITION BY j ORDER BY x) + (count(*) OVER (PARTITION BY j, x) - 1) / 2.0" if ranked else "x"
    return f"""
known AS (SELECT * FROM {source} WHERE {known}),
firsts AS (SELECT key, min(bar_ix) FILTER (split = 'val') AS first_val FROM known GROUP BY key),
rows AS MATERIALIZED (SELECT known.*, coalesce(split = 'train' AND y >= 0 AND bar_ix < first_val, false) AS fits FROM known JOIN firsts USING (key)),
f AS MATERIALIZED ({long}),
m AS MATERIALIZED (SELECT j, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1.0 END AS scale FROM f WHERE fits GROUP BY j),
v AS MATERIALIZED (SELECT key, bar_ix, j, CAST({v} AS DOUBLE) AS v, y FROM f WHERE fits),
c AS MATERIALIZED (SELECT a.j AS i, b.j, CASE WHEN a.j = b.j THEN 1.0 WHEN isnan(corr(a.v, b.v)) THEN 0.0 ELSE coalesce(corr(a.v, b.v), 0.0) END AS r FROM v a JOIN v b USING (key, bar_ix) GROUP BY a.j, b.j),
wy AS MATERIALIZED (SELECT j, coalesce(corr(v, y), 0.0) AS r FROM v GROUP BY j)"""


_PRUNED = """,
o AS (SELECT j, scale, row_number() OVER (ORDER BY scale DESC, j) AS k FROM m),
against AS (SELECT o.j, o.k, o.scale, coalesce(list(c.j) FILTER (abs(c.r) > 0.9 AND c.i <> c.j), []) AS foes FROM o JOIN c ON c.i = o.j GROUP BY ALL),
kept AS (SELECT 0::BIGINT AS k, []::INTEGER[] AS js UNION ALL SELECT a.k, CASE WHEN a.scale * a.scale > 1e-6 AND NOT list_has_any(js, foes) THEN list_append(js, a.j) ELSE js END FROM kept JOIN against a ON a.k = kept.k + 1),
pruned AS MATERIALIZED (SELECT js FROM kept ORDER BY k DESC LIMIT 1)"""

_INFORMATION = """,
bins AS (SELECT j, y, ntile(10) OVER (PARTITION BY j ORDER BY x, key || '/' || bar_ix) AS bin FROM f WHERE fits),
cells AS (SELECT j, bin, y, CAST(count(*) AS DOUBLE) AS n FROM bins GROUP BY ALL),
shares AS (SELECT j, n, sum(n) OVER (PARTITION BY j) AS t, sum(n) OVER (PARTITION BY j, bin) AS nb, sum(n) OVER (PARTITION BY j, y) AS ny FROM cells),
mi AS MATERIALIZED (SELECT j, round(sum(n / t * ln(n * t / (nb * ny))), 6) AS mi FROM shares GROUP BY j)"""

_PICKED = "SELECT f.key, f.bar_ix, CAST(p.part AS INT) AS part, round((f.x - mean) / scale, 6) + 0.0 AS z FROM f JOIN m USING (j) JOIN picked p USING (j)"
_MIXED = "SELECT f.key, f.bar_ix, CAST(w.part AS INT) AS part, round(sum((f.x - mean) / scale * w.w), 6) + 0.0 AS z FROM f JOIN m USING (j) JOIN w USING (j) GROUP BY f.key, f.bar_ix, w.part"


def _eigen(n: int, d: int, which: str) -> str:
    """Directions one after the other, each taken out of the matrix before the next."""
    first = f"SELECT i, j, CASE WHEN i = j THEN {d}.0 ELSE 0.0 END - r AS r FROM c" if which == "minor" else "SELECT i, j, r FROM c"
    text, square = f",\na0 AS MATERIALIZED ({first})", "SELECT i, j, r / sum(r) FILTER (i = j) OVER () AS r FROM (SELECT p.i, q.j, sum(p.r * q.r) AS r FROM {p} p JOIN {p} q ON p.j = q.i GROUP BY p.i, q.j)"
    for k in range(n):
        name = f"a{k}"
        for s in range(30):
            text += f",\np{k}_{s} AS MATERIALIZED ({square.format(p=name)})"
            name = f"p{k}_{s}"
        text += f""",
t{k} AS (SELECT i AS top, r AS size FROM {name} WHERE i = j ORDER BY r DESC, i LIMIT 1),
e{k} AS MATERIALIZED (SELECT i AS j, r / sqrt(size) AS w FROM {name} JOIN t{k} ON j = top),
l{k} AS MATERIALIZED (SELECT sum(a.r * x.w * y.w) AS l FROM a{k} a JOIN e{k} x ON x.j = a.i JOIN e{k} y ON y.j = a.j),
a{k + 1} AS MATERIALIZED (SELECT a.i, a.j, a.r - l * x.w * y.w AS r FROM a{k} a JOIN e{k} x ON x.j = a.i JOIN e{k} y ON y.j = a.j, l{k})"""
    scaled = "w / sqrt(greatest(l, 1e-9))" if which == "whiten" else "w"
    return text + ",\nw AS (" + " UNION ALL ".join(f"SELECT {k} AS part, j, {scaled} AS w FROM e{k}, l{k}" for k in range(n)) + ")"


def _partial_least_squares(n: int) -> str:
    text = ",\nc0 AS MATERIALIZED (SELECT j, r FROM wy)"
    for k in range(n):
        text += f""",
u{k} AS MATERIALIZED (SELECT j, r / sqrt(sum(r * r) OVER ()) AS w FROM c{k} QUALIFY sqrt(sum(r * r) OVER ()) >= 1e-9),
g{k} AS MATERIALIZED (SELECT c.i AS j, sum(c.r * u.w) AS g FROM c JOIN u{k} u ON u.j = c.j GROUP BY c.i),
q{k} AS (SELECT sum(u.w * r) / greatest(sum(u.w * g), 1e-12) AS q FROM u{k} u JOIN g{k} USING (j) JOIN c{k} USING (j)),
c{k + 1} AS MATERIALIZED (SELECT j, r - g * q AS r FROM c{k} JOIN g{k} USING (j), q{k})"""
    return text + ",\nw AS (" + " UNION ALL ".join(f"SELECT {k} AS part, j, w FROM u{k}" for k in range(n)) + ")"


def reduce_check(source: str, columns: list[str], method: str, n: int) -> str | None:
    """key, bar_ix, part, z of a reducer over rows with key, bar_ix, split, y and the columns; None for encoders."""
    begin, numbered = f"WITH RECURSIVE {_moments(source, columns, method == 'spearman')}", "row_number() OVER (ORDER BY j) - 1 AS part"
    if method == "variance":
        return f"{begin},\nt AS (SELECT j FROM m WHERE scale * scale > 0.01 ORDER BY scale DESC, j LIMIT {n}),\nany_of AS (SELECT j FROM t UNION ALL SELECT 0 WHERE NOT EXISTS (SELECT 1 FROM t)),\npicked AS (SELECT j, {numbered} FROM any_of) {_PICKED}"
    if method in ("correlation", "spearman"):
        return f"{begin}{_PRUNED},\npicked AS (SELECT j, {numbered} FROM (SELECT unnest(js[1:{n}]) AS j FROM pruned)) {_PICKED}"
    if method in ("infogain", "mrmr"):
        text, taken = f"{begin}{_PRUNED}{_INFORMATION},\nk0 AS (SELECT []::INTEGER[] AS js)", "0.0"
        for k in range(n):
            if method == "mrmr":
                taken = f"coalesce((SELECT avg(abs(c.r)) FROM c WHERE c.i = mi.j AND list_contains((SELECT js FROM k{k}), c.j)), 0.0)"
            text += f",\nb{k} AS MATERIALIZED (SELECT mi.j FROM mi, pruned WHERE list_contains(pruned.js, mi.j) AND NOT list_contains((SELECT js FROM k{k}), mi.j) ORDER BY mi - {taken} DESC, mi.j LIMIT 1),\nk{k + 1} AS MATERIALIZED (SELECT CASE WHEN (SELECT j FROM b{k}) IS NULL THEN js ELSE list_append(js, (SELECT j FROM b{k})) END AS js FROM k{k})"
        return f"{text},\npicked AS (SELECT j, {numbered} FROM (SELECT unnest(js) AS j FROM k{n})) {_PICKED}"
    if method in ("pca", "whiten", "minor_pca"):
        # directions that carry nothing are known to fewer places
        return f"{begin}{_eigen(n, len(columns), method.removesuffix('_pca'))} {_MIXED.replace(', 6)', ', 4)') if method == 'minor_pca' else _MIXED}"
    if method == "spca":
        near = f",\nnear AS MATERIALIZED (SELECT j FROM wy ORDER BY abs(r) DESC, j LIMIT {2 * n})"
        own = _eigen(n, len(columns), "major").replace("SELECT i, j, r FROM c)", "SELECT i, c.j, r FROM c JOIN near a ON a.j = c.i JOIN near b ON b.j = c.j)", 1)
        return f"{begin}{near}{own} {_MIXED}"
    if method == "pls":
        return f"{begin}{_partial_least_squares(n)} {_MIXED}"
    return None


def scaler_check(source: str, columns: list[str]) -> str:
    return f"WITH {_moments(source, columns, False).lstrip()} SELECT j AS feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM m"


def isotonic_check(source: str, places: int | None = 6) -> str:
    """key, bar_ix, p: the highest of the lowest means, between fitted scores a straight line; input key, bar_ix, score, y, judges."""
    return f"""
WITH rows AS MATERIALIZED (SELECT * FROM {source}),
s AS MATERIALIZED (SELECT score, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS t FROM rows WHERE judges GROUP BY score),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score) AS k, sum(n) OVER (ORDER BY score) AS cn, sum(t) OVER (ORDER BY score) AS ct FROM s),
a AS (SELECT i.k AS first, j.k AS last, (j.ct - i.ct + i.t) / (j.cn - i.cn + i.n) AS mean FROM o i JOIN o j ON j.k >= i.k),
b AS (SELECT first, last AS k, min(mean) OVER (PARTITION BY first ORDER BY last DESC) AS low FROM a),
fit AS MATERIALIZED (SELECT k, score, max(low) AS p FROM b JOIN o USING (k) GROUP BY k, score),
near AS (SELECT r.key, r.bar_ix, r.score, l.score AS s0, l.p AS p0, h.score AS s1, h.p AS p1 FROM rows r ASOF LEFT JOIN fit l ON r.score >= l.score ASOF LEFT JOIN fit h ON r.score <= h.score)
SELECT key, bar_ix, {_placed("CASE WHEN s0 IS NULL THEN p1 WHEN s1 IS NULL OR s1 = s0 THEN p0 ELSE p0 + (p1 - p0) * (score - s0) / (s1 - s0) END", places)} AS p FROM near"""


def venn_abers_check(source: str) -> str:
    """The two fits in which a score has either label, each by the highest of the lowest means around it."""
    mean = "(coalesce(t, 0) + {label}) / (coalesce(n, 0) + 1.0)"
    return f"""
WITH rows AS MATERIALIZED (SELECT * FROM {source}),
v AS MATERIALIZED (SELECT score, count(*) AS n, sum(y) AS t FROM rows WHERE judges GROUP BY score),
s AS MATERIALIZED (SELECT DISTINCT score FROM rows),
l AS (SELECT s.score, v.score AS a FROM s JOIN v ON v.score <= s.score UNION SELECT score, score FROM s),
h AS (SELECT s.score, v.score AS b FROM s JOIN v ON v.score >= s.score UNION SELECT score, score FROM s),
p AS (SELECT l.score, a, b, sum(v.n) AS n, sum(v.t) AS t FROM l JOIN h USING (score) LEFT JOIN v ON v.score BETWEEN a AND b GROUP BY l.score, a, b),
m AS (SELECT score, a, min({mean.format(label=0)}) AS m0, min({mean.format(label=1)}) AS m1 FROM p GROUP BY score, a),
f AS (SELECT score, max(m0) AS p0, max(m1) AS p1 FROM m GROUP BY score)
SELECT key, bar_ix, round(CASE WHEN 1 - p0 + p1 > 1e-9 THEN p1 / (1 - p0 + p1) ELSE p1 END, 6) AS p FROM rows JOIN f USING (score)"""


def overfit_check(returns: str, splits: int = 16, most: int = 1_000) -> str:
    """pbo and combinations over strategy, t, ret on times that all strategies have, in halves of equal parts."""
    half = splits // 2
    return f"""
WITH r AS (SELECT strategy, t, ret FROM {returns}), k AS (SELECT count(DISTINCT strategy) AS k FROM r),
g AS MATERIALIZED (SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY t) - 1 AS i, ret, count(*) OVER (PARTITION BY strategy) // {splits} AS size FROM r WHERE t IN (SELECT t FROM r GROUP BY t HAVING count(DISTINCT strategy) = (SELECT k FROM k))),
p AS MATERIALIZED (SELECT strategy, i // size AS part, any_value(size) AS size, sum(ret) AS one, sum(ret * ret) AS two FROM g WHERE i < size * {splits} GROUP BY strategy, i // size),
c AS (SELECT mask, row_number() OVER (ORDER BY mask DESC) - 1 AS n, count(*) OVER () AS total FROM range({1 << splits}) u(mask) WHERE bit_count(mask) = {half}),
u AS MATERIALIZED (SELECT n AS id, mask FROM c WHERE n % greatest(1, total // {most}) = 0 AND n // greatest(1, total // {most}) < {most}),
s AS (SELECT id, strategy, (mask >> ({splits - 1} - part)) & 1 AS inside, sum(one) AS one, sum(two) AS two, {half} * any_value(size) AS n FROM u, p GROUP BY ALL),
q AS (SELECT *, sqrt(greatest(0.0, (two - one * one / n) / (n - 1))) AS sd FROM s),
z AS MATERIALIZED (SELECT id, strategy, inside, CASE WHEN sd > 1e-12 THEN one / n / sd ELSE 0.0 END AS ratio FROM q),
best AS (SELECT id, strategy FROM z WHERE inside = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ratio DESC, strategy) = 1),
own AS (SELECT z.id, z.ratio FROM z JOIN best USING (id, strategy) WHERE inside = 0),
rank AS (SELECT z.id, 1 + count(*) FILTER (z.ratio < own.ratio) AS rank FROM z JOIN own ON own.id = z.id AND z.inside = 0 GROUP BY z.id)
SELECT avg(CASE WHEN rank / ((SELECT k FROM k) + 1) <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo, count(*) AS combinations FROM rank"""


def _newton(d: int, rounds: int, ridge: str) -> str:
    """Weights b of a logistic loss over long rows g (id, j, x, with j = d always one) and rows t (id, y, w), by Newton's rule.

    A round builds the matrix of curvatures with the slopes beside it and clears it column by column.
    """
    text = f",\nb0 AS MATERIALIZED (SELECT CAST(range AS INTEGER) AS j, 0.0::DOUBLE AS b FROM range({d + 1}))"
    for k in range(rounds):
        text += f""",
p{k} AS MATERIALIZED (SELECT id, any_value(y) AS y, any_value(w) AS w, 1 / (1 + exp(-greatest(-500.0, least(500.0, sum(x * b))))) AS p FROM g JOIN t USING (id) JOIN b{k} USING (j) GROUP BY id),
h{k}_0 AS MATERIALIZED (
  SELECT l.j AS i, r.j, sum(l.x * r.x * w * p * (1 - p)) + CASE WHEN l.j = r.j AND l.j < {d} THEN {ridge} ELSE 0.0 END AS v FROM p{k} JOIN g l USING (id) JOIN g r USING (id) GROUP BY l.j, r.j
  UNION ALL SELECT j, {d + 1}, sum(x * w * (p - y)) + CASE WHEN j < {d} THEN {ridge} * any_value(b) ELSE 0.0 END FROM p{k} JOIN g USING (id) JOIN b{k} USING (j) GROUP BY j
)"""
        for c in range(d + 1):
            text += f""",
h{k}_{c + 1} AS MATERIALIZED (
  SELECT a.i, a.j, CASE WHEN a.i = {c} THEN a.v / piv.v ELSE a.v - col.v * row.v / piv.v END AS v
  FROM h{k}_{c} a JOIN h{k}_{c} col ON col.i = a.i AND col.j = {c} JOIN h{k}_{c} row ON row.i = {c} AND row.j = a.j, (SELECT v FROM h{k}_{c} WHERE i = {c} AND j = {c}) piv
  WHERE a.j > {c}
)"""
        text += f",\nb{k + 1} AS MATERIALIZED (SELECT b.j, b - v AS b FROM b{k} b JOIN h{k}_{d + 1} h ON h.i = b.j AND h.j = {d + 1})"
    return text + f",\nb AS MATERIALIZED (SELECT * FROM b{rounds})"


def logit_check(source: str, columns: list[str], n: int = 20, rounds: int = 12, places: int | None = 6) -> str:
    """key, bar_ix, score of the logistic model on the first n columns that do not correlate."""
    return f"""
WITH RECURSIVE {_moments(source, columns, False).lstrip()}{_PRUNED},
picked AS (SELECT j, row_number() OVER (ORDER BY j) - 1 AS part FROM (SELECT unnest(js[1:{n}]) AS j FROM pruned)),
z AS MATERIALIZED (SELECT key, bar_ix, f.fits, CAST(part AS INTEGER) AS j, (x - mean) / scale AS x FROM f JOIN m USING (j) JOIN picked USING (j) UNION ALL SELECT key, bar_ix, fits, {n}, 1.0 FROM rows),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS ones FROM rows WHERE fits),
t AS MATERIALIZED (SELECT key || '/' || bar_ix AS id, y, CASE WHEN y = 1 THEN n / (2 * ones) ELSE n / (2 * (n - ones)) END AS w FROM rows, n WHERE fits),
g AS MATERIALIZED (SELECT key || '/' || bar_ix AS id, j, x FROM z WHERE fits){_newton(n, rounds, "1.0")}
SELECT key, bar_ix, {_placed("1 / (1 + exp(-sum(x * b)))", places)} AS score FROM z JOIN b USING (j) GROUP BY key, bar_ix"""


def _placed(text: str, places: int | None) -> str:
    return text if places is None else f"round({text}, {places})"


def beta_check(source: str, rounds: int = 12) -> str:
    """key, bar_ix, p by a logistic model on the logarithms of the score and of the rest."""
    q = "least(greatest(score, 1e-6), 1 - 1e-6)"
    return f"""
WITH rows AS MATERIALIZED (SELECT *, key || '/' || bar_ix AS id FROM {source}),
z AS MATERIALIZED (SELECT key, bar_ix, id, judges, 0 AS j, ln({q}) AS x FROM rows UNION ALL SELECT key, bar_ix, id, judges, 1, -ln(1 - {q}) FROM rows UNION ALL SELECT key, bar_ix, id, judges, 2, 1.0 FROM rows),
t AS MATERIALIZED (SELECT id, y, 1.0 AS w FROM rows WHERE judges),
g AS MATERIALIZED (SELECT id, j, x FROM z WHERE judges){_newton(2, rounds, "(SELECT 1e-6 * count(*) FROM t)")}
SELECT key, bar_ix, round(1 / (1 + exp(-sum(x * b))), 6) AS p FROM z JOIN b USING (j) GROUP BY key, bar_ix"""
