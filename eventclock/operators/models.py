"""Fitting on TRAIN: masks, scaling, reducers, classifiers, calibration, judging.

Input of all: key, bar_ix, split, y and a vector column of features.  Linear reducers
need the features' covariance only, which Spark aggregates; what they give is a small
projection matrix applied to every row in Arrow batches.  Encoders and classifiers are
numpy models (``learners``) that one task each fits on the TRAIN bars of a cell; a bag's
members are fitted side by side, and rows are scored in Arrow batches.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventclock.functions.dialect import steps, steps_sql
from eventclock.operators import learners

KEY = "(PARTITION BY key)"

#: Rows a fit may use: labels of TRAIN bars do not reach into what is judged.
MASKS = (
    {"first_val": f"min(CASE WHEN split = 'val' THEN bar_ix END) OVER {KEY}", "first_test": f"min(CASE WHEN split = 'test' THEN bar_ix END) OVER {KEY}"},
    {"fits": "split = 'train' AND y >= 0 AND bar_ix < first_val - {purge}", "judges": "split = 'val' AND y >= 0 AND bar_ix < coalesce(first_test, 9e18) - {embargo}"},
)


def embargo(horizons: tuple[int, ...], reach: int | None) -> int:
    return max(200, *horizons, reach or 0)


def _masks(reach: int, purge: bool) -> tuple[dict[str, str], ...]:
    return tuple({k: v.replace("{embargo}", str(reach)).replace("{purge}", str(reach if purge else 0)) for k, v in s.items()} for s in MASKS)


def masks(labelled: DataFrame, reach: int, purge: bool = False) -> DataFrame:
    """Adds fits and judges."""
    return steps(labelled, *_masks(reach, purge)).drop("first_val", "first_test")


def masks_check(source: str, reach: int, purge: bool = False) -> str:
    return f"SELECT * EXCLUDE (first_val, first_test) FROM {steps_sql(source, *_masks(reach, purge))}"


def folds(labelled: DataFrame, count: int = 3, gap: int = 200) -> DataFrame:
    """Adds fold of TRAIN rows in order, and for each fold f a column train_f without rows within the gap of it."""
    train = labelled.where("split = 'train' AND y >= 0")
    rows = train.withColumn("fold", F.ntile(count).over(W.partitionBy("key").orderBy("bar_ix")) - 1)
    for f in range(count):
        lo, hi = (g(F.when(F.col("fold") == f, F.col("bar_ix"))).over(W.partitionBy("key")) for g in (F.min, F.max))
        rows = rows.withColumn(f"train_{f}", (F.col("bar_ix") < lo - gap) | (F.col("bar_ix") > hi + gap))
    return rows


def permuted(labelled: DataFrame, seed: int = 1234) -> DataFrame:
    """Labels of TRAIN rows dealt anew within their key; a control that must find nothing."""
    train = labelled.where("split = 'train' AND y >= 0")
    slot = train.withColumn("slot", F.row_number().over(W.partitionBy("key").orderBy("bar_ix"))).drop("y")
    dealt = train.select("key", "y", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "bar_ix"), "bar_ix")).alias("slot"))
    return slot.join(dealt, ["key", "slot"]).drop("slot")


#: Area under the ROC curve by ranks; ties have their mean rank.
AUC = (
    {"rk": "rank() OVER (PARTITION BY key ORDER BY score)", "same": "count(score) OVER (PARTITION BY key, score)"},
    {"mid": "rk + (same - 1) / 2e0"},
)
_auc = "CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2e0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) ELSE 0.5 END"


def auc(scored: DataFrame) -> DataFrame:
    """key, auc; input key, y (0 or 1), score."""
    return steps(scored, *AUC).groupBy("key").agg(F.round(F.expr(_auc).cast("double"), 6).alias("auc"))


def auc_check(source: str) -> str:
    return f"SELECT key, round(CAST({_auc} AS DOUBLE), 6) AS auc FROM {steps_sql(source, *AUC)} GROUP BY key"


def binned_information(values: DataFrame, bins: int = 10) -> DataFrame:
    """feature, mi: mutual information of the label with equal-count bins; input feature, x, y, id."""
    rows = values.withColumn("bin", F.ntile(bins).over(W.partitionBy("feature").orderBy("x", "id")))
    cells = rows.groupBy("feature", "bin", "y").count()
    by = lambda *c: F.sum("count").over(W.partitionBy("feature", *c)).cast("double")
    cells = cells.withColumns({"n": by(), "nb": by("bin"), "ny": by("y")})
    return cells.groupBy("feature").agg(F.round(F.sum(F.col("count") / F.col("n") * F.log(F.col("count") * F.col("n") / (F.col("nb") * F.col("ny")))), 6).alias("mi"))


def binned_information_check(source: str, bins: int = 10) -> str:
    return f"""
WITH r AS (SELECT *, ntile({bins}) OVER (PARTITION BY feature ORDER BY x, id) AS bin FROM {source}),
c AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS k FROM r GROUP BY 1, 2, 3),
m AS (SELECT *, sum(k) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature, bin) AS nb, sum(k) OVER (PARTITION BY feature, y) AS ny FROM c)
SELECT feature, round(sum(k / n * ln(k * n / (nb * ny))), 6) AS mi FROM m GROUP BY feature"""


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all features are known, with vector ``x``."""
    return VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="skip").transform(rows)


@dataclass
class Projection:
    """(x - mean) / scale times matrix."""

    mean: np.ndarray
    scale: np.ndarray
    matrix: np.ndarray

    def apply(self, rows: DataFrame, column: str = "x") -> DataFrame:
        mean, scale, matrix = self.mean, self.scale, self.matrix

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(((np.array(x.tolist(), float) - mean) / scale) @ matrix))

        return rows.withColumn(column, array_to_vector(project(vector_to_array(column))))


@dataclass
class Moments:
    """What linear reducers need of TRAIN: covariance of scaled features, variances, covariance with the label."""

    mean: np.ndarray
    scale: np.ndarray
    corr: np.ndarray
    with_y: np.ndarray

    @classmethod
    def of(cls, train: DataFrame, method: str = "pearson") -> Moments:
        d = train.agg(Summarizer.mean(F.col("x")).alias("m"), Summarizer.std(F.col("x")).alias("s"), F.count(F.lit(1)).alias("n")).first()
        mean, scale = d.m.toArray(), d.s.toArray() * math.sqrt((d.n - 1) / max(1, d.n))
        both = VectorAssembler(inputCols=["x", "y"], outputCol="xy").transform(train.select("x", F.col("y").cast("double").alias("y")))
        full = np.nan_to_num(Correlation.corr(both, "xy", method).first()[0].toArray())
        np.fill_diagonal(full, 1.0)
        return cls(mean, np.where(scale > 1e-12, scale, 1.0), full[:-1, :-1], full[:-1, -1])

    def pick(self, columns: list[int]) -> Projection:
        return Projection(self.mean, self.scale, np.eye(len(self.mean))[:, columns])


def scaler(train: DataFrame) -> DataFrame:
    """feature (its place), mean, scale of TRAIN; a feature without spread keeps its scale."""
    rows = train.select(F.posexplode(vector_to_array("x")).alias("feature", "v")).groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return rows.select("feature", "mean", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0).alias("scale"))


def _pruned(m: Moments, limit: float = 0.9) -> list[int]:
    """Columns of which no two correlate beyond the limit; of two the one with less variance goes, of equals the later."""
    keep: list[int] = []
    for c in sorted(range(len(m.mean)), key=lambda c: (-m.scale[c], c)):
        if m.scale[c] ** 2 > 1e-6 and all(abs(m.corr[c, k]) <= limit for k in keep):
            keep.append(c)
    return keep


def _top(m: Moments, n: int) -> Projection:
    return m.pick(sorted(_pruned(m)[:n]))


def _eigen(m: Moments, n: int, which: str) -> Projection:
    values, vectors = np.linalg.eigh(m.corr)
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)
    at = np.argsort(-values, kind="stable")
    at = at[::-1][:n] if which == "minor" else at[:n]
    matrix = vectors[:, at] / (np.sqrt(np.maximum(values[at], 1e-9)) if which == "whiten" else 1)
    return Projection(m.mean, m.scale, matrix)


def _partial_least_squares(m: Moments, n: int) -> Projection:
    """Directions of highest covariance with the label, each apart from those before (from moments alone)."""
    cov, out = m.corr.copy(), []
    c = m.with_y.copy()
    for _ in range(min(n, len(c))):
        if np.linalg.norm(c) < 1e-9:
            break
        w = c / np.linalg.norm(c)
        load = m.corr @ w
        c = c - load * (w @ c) / max(w @ load, 1e-12)
        out.append(w)
    return Projection(m.mean, m.scale, np.array(out).T if out else np.eye(len(cov))[:, :1])


def _supervised(m: Moments, n: int) -> Projection:
    """Principal components of the features that correlate most with the label."""
    pick = np.argsort(-np.abs(m.with_y), kind="stable")[: 2 * n]
    values, vectors = np.linalg.eigh(m.corr[np.ix_(pick, pick)])
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)
    matrix = np.zeros((len(m.mean), min(n, len(pick))))
    matrix[pick] = vectors[:, ::-1][:, :n]
    return Projection(m.mean, m.scale, matrix)


def information(train: DataFrame, d: int) -> np.ndarray:
    """Binned mutual information of each feature with the label."""
    long = train.select("y", F.concat_ws("/", "key", F.col("bar_ix").cast("string")).alias("id"), F.posexplode(vector_to_array("x")).alias("feature", "x"))
    out = np.zeros(d)
    for r in binned_information(long).collect():  # one row per feature
        out[r.feature] = r.mi
    return out


def _relevant(m: Moments, mi: np.ndarray, n: int, spread: bool) -> Projection:
    """Most informative columns; spread: less the mean correlation with those taken."""
    left, taken = set(_pruned(m)), []
    while left and len(taken) < n:
        own = lambda c: mi[c] - (np.abs(m.corr[c, taken]).mean() if spread and taken else 0)
        best = max(sorted(left), key=own)
        taken.append(best)
        left.remove(best)
    return m.pick(sorted(taken))


def in_tasks(rows: DataFrame, x: Column, columns: list[str], fit: Callable[[pd.DataFrame, int], bytes], tasks: range = range(1)) -> list[bytes]:
    """What fit(rows by key and bar, number) gives, in one Spark task for each number; x: an array of features."""
    sent = rows.select("key", "bar_ix", x.alias("x"), *columns, F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))

    def run(batches):
        held: dict[int, list[pd.DataFrame]] = {}
        for part in batches:
            for t, own in part.groupby("task"):
                held.setdefault(t, []).append(own)
        for t, parts in held.items():
            yield pd.DataFrame({"task": [t], "model": [fit(pd.concat(parts).sort_values(["key", "bar_ix"]), t)]})

    found = sent.repartition(len(tasks), "task").mapInPandas(run, "task int, model binary").collect()  # a row a task
    return [bytes(r.model) for r in sorted(found)]


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), float)


def fitted_encoder(train: DataFrame, m: Moments, method: str, n: int) -> learners.Encoder:
    mean, scale, d = m.mean, m.scale, len(m.mean)

    def fit(part: pd.DataFrame, _: int) -> bytes:
        x = (_matrix(part["x"]) - mean) / scale
        if method == "autoencoder":
            found = learners.autoencoder(x, max(4, min(n, d // 3)), 32)
        elif method == "ae_np":
            found = learners.autoencoder(x, n, max(2 * n, min(64, d // 2)))
        else:
            found = learners.variational(x, n, part["y"].to_numpy(float) if method == "vae_rl" else None)
        return pickle.dumps(found)

    return pickle.loads(in_tasks(train, vector_to_array("x"), ["y"], fit)[0])


def _encoded(train: DataFrame, rows: DataFrame, m: Moments, method: str, n: int) -> DataFrame:
    found = fitted_encoder(train, m, method, n)
    mean, scale = m.mean, m.scale

    @F.pandas_udf("array<double>")
    def encode(x: pd.Series) -> pd.Series:
        return pd.Series(list(found.encode((_matrix(x) - mean) / scale)))

    return rows.withColumn("x", array_to_vector(encode(vector_to_array("x"))))


REDUCERS = ("correlation", "spearman", "variance", "infogain", "mrmr", "autoencoder", "ae_np", "pca", "whiten", "minor_pca", "pls", "spca", "vae", "vae_rl")


def projection(train: DataFrame, method: str = "correlation", n: int = 20) -> Projection:
    """A linear reducer, fitted."""
    m = Moments.of(train, "spearman" if method == "spearman" else "pearson")
    d = len(m.mean)
    if method in ("infogain", "mrmr"):
        return _relevant(m, information(train, d), n, method == "mrmr")
    made: dict[str, Callable[[], Projection]] = {
        "correlation": lambda: _top(m, n),
        "spearman": lambda: _top(m, n),
        "variance": lambda: m.pick(sorted(sorted((c for c in range(d) if m.scale[c] ** 2 > 0.01), key=lambda c: (-m.scale[c], c))[:n]) or [0]),
        "pca": lambda: _eigen(m, n, "major"),
        "whiten": lambda: _eigen(m, n, "whiten"),
        "minor_pca": lambda: _eigen(m, n, "minor"),
        "pls": lambda: _partial_least_squares(m, n),
        "spca": lambda: _supervised(m, n),
    }
    if method not in made:
        raise ValueError(f"no linear reducer {method!r}")
    return made[method]()


def reduce(rows: DataFrame, method: str = "correlation", n: int = 20) -> DataFrame:
    """Rows with ``x`` reduced; fitted on rows that ``fits`` only."""
    if method not in REDUCERS:
        raise ValueError(f"unknown reducer {method!r}")
    train = rows.where("fits")
    if method in ("autoencoder", "ae_np", "vae", "vae_rl"):
        return _encoded(train, rows, Moments.of(train), method, n)
    return projection(train, method, n).apply(rows)


MODELS = (*learners.FAMILIES, "logit")


def _classes(train: DataFrame) -> tuple[float, int]:
    """Ones and rows."""
    r = train.agg(F.sum(F.col("y").cast("double")), F.count(F.lit(1))).first()
    return r[0] or 0.0, r[1]


def fit(rows: DataFrame, model: str = "xgb", depth: int = 3, rounds: int = 200, rate: float = 0.03):
    """The fitted model; None where TRAIN has one kind of label.  Ones weigh as much as the rest."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    ones, n = _classes(rows.where("fits"))
    if not n or ones in (0.0, float(n)):
        return None
    weight = (n - ones) / ones

    def run(part: pd.DataFrame, number: int) -> bytes:
        x, y, train = _matrix(part["x"]), part["y"].to_numpy(float), part["fits"].to_numpy(bool)
        w = np.where(y[train] == 1, weight, 1.0)
        if model == "logit":
            found = learners.logistic(x[train], y[train], w * len(w) / w.sum(), 1.0)
        else:
            rules = replace(learners.FAMILIES[model], depth=depth, rounds=rounds, rate=rate)
            found = learners.classify(x[train], y[train], w, (x[~train], y[~train]), rules, 42 + number)
        return learners.to_json(found).encode()

    made = in_tasks(rows.where("fits OR judges"), vector_to_array("x"), ["y", "fits"], run, range(5 if model.endswith("_bag") else 1))
    members = [learners.from_json(m.decode()) for m in made]
    return members[0] if len(members) == 1 else learners.Bag(members)


def scored(rows: DataFrame, model, column: str = "score") -> DataFrame:
    """Rows with the model's score; one for all without a model."""
    if model is None:
        return rows.withColumn(column, F.lit(1.0))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(x)))

    return rows.withColumn(column, score(vector_to_array("x")))


def fit_scores(rows: DataFrame, model: str = "xgb", depth: int = 3, rounds: int = 200, rate: float = 0.03) -> DataFrame:
    """Rows with ``score``, the probability of one; a TRAIN with one kind of label gives a constant."""
    return scored(rows, fit(rows, model, depth, rounds, rate))


def survival_scores(rows: DataFrame, bounds: DataFrame, depth: int = 3, rounds: int = 200, rate: float = 0.03) -> DataFrame:
    """Rows with ``score`` by the time until the upper barrier: high where it is short; bounds: key, bar_ix, lower, upper."""
    ones, n = _classes(rows.where("fits"))
    if not n or ones in (0.0, float(n)):
        return scored(rows, None)

    def run(part: pd.DataFrame, _: int) -> bytes:
        rules = learners.Rules(rounds, rate, depth, 0.0, 1.0, 1.0, 1.0)
        return learners.to_json(learners.survive(_matrix(part["x"]), part["lower"].to_numpy(), part["upper"].to_numpy(), rules)).encode()

    train = rows.where("fits").join(bounds.select("key", "bar_ix", "lower", "upper"), ["key", "bar_ix"])
    return scored(rows, learners.from_json(in_tasks(train, vector_to_array("x"), ["lower", "upper"], run)[0].decode()))


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: sorted distinct x and their fitted values."""
    at, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse, w).astype(float)
    value = np.bincount(inverse, y if w is None else y * w) / weight
    blocks: list[list[float]] = []
    for v, k in zip(value, weight, strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return at, np.concatenate([np.full(int(c), v) for v, _, c in blocks])


class VennAbers:
    """Probabilities from the two isotonic fits in which a score has either label.

    Pools of all scores up to each one, and from each one on, are found once; the fit at a
    score then joins the pools beside it that are out of order, which takes few steps.
    """

    def __init__(self, x: np.ndarray, n: np.ndarray, ones: np.ndarray):
        """x: distinct scores in order; n and ones: rows and ones of each."""
        self.x, self.n, self.ones = x, np.concatenate([[0.0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(ones)])
        self.first, self.last = list(range(len(x))), list(range(len(x)))
        for i in range(len(x)):  # first[i]: where the last pool of scores up to i begins
            while self.first[i] > 0 and self._mean(self.first[self.first[i] - 1], self.first[i] - 1) >= self._mean(self.first[i], i):
                self.first[i] = self.first[self.first[i] - 1]
        for i in reversed(range(len(x))):
            while self.last[i] < len(x) - 1 and self._mean(self.last[i] + 1, self.last[self.last[i] + 1]) <= self._mean(i, self.last[i]):
                self.last[i] = self.last[self.last[i] + 1]

    def _mean(self, a: int, b: int) -> float:
        return (self.ones[b + 1] - self.ones[a]) / (self.n[b + 1] - self.n[a])

    def _fit(self, score: float, label: float) -> float:
        left = int(np.searchsorted(self.x, score)) - 1
        right = left + 1 + (left + 1 < len(self.x) and self.x[left + 1] == score)
        while True:
            mean = (self.ones[right] - self.ones[left + 1] + label) / (self.n[right] - self.n[left + 1] + 1)
            if left >= 0 and self._mean(self.first[left], left) >= mean:
                left = self.first[left] - 1
            elif right < len(self.x) and self._mean(right, self.last[right]) <= mean:
                right = self.last[right] + 1
            else:
                return mean

    def probability(self, score: float) -> float:
        p0, p1 = self._fit(score, 0.0), self._fit(score, 1.0)
        return p1 / (1 - p0 + p1) if 1 - p0 + p1 > 1e-9 else p1


CALIBRATIONS = ("isotonic", "beta", "venn_abers")


def calibrate(rows: DataFrame, kind: str = "isotonic") -> DataFrame:
    """Rows with ``p``, calibrated on rows that ``judges``; without such rows the score itself."""
    if kind not in CALIBRATIONS:
        raise ValueError(f"unknown calibration {kind!r}")
    seen = rows.where("judges").withColumn("y", F.col("y").cast("double"))
    if seen.select("y").distinct().count() < 2:
        return rows.withColumn("p", F.col("score"))
    if kind == "isotonic":
        model = IsotonicRegression(featuresCol="score", labelCol="y").fit(seen)
        return model.transform(rows).withColumnRenamed("prediction", "p")
    if kind == "beta":
        q = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
        logs = F.array(F.log(q), -F.log(1 - q))

        def run(part: pd.DataFrame, _: int) -> bytes:
            y = part["y"].to_numpy(float)
            return learners.to_json(learners.logistic(_matrix(part["x"]), y, np.ones(len(y)), 1e-6 * len(y))).encode()

        model = learners.from_json(in_tasks(seen, logs, ["y"], run)[0].decode())

        @F.pandas_udf("double")
        def beta(x: pd.Series) -> pd.Series:
            return pd.Series(model.score(_matrix(x)))

        return rows.withColumn("p", beta(logs))
    # a row for each different score of VAL
    held = seen.groupBy("score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("ones")).orderBy("score").toPandas()
    pools = VennAbers(*(held[c].to_numpy() for c in ("score", "n", "ones")))

    @F.pandas_udf("double")
    def abers(score: pd.Series) -> pd.Series:
        return score.map({s: pools.probability(s) for s in score.unique()})

    return rows.withColumn("p", abers("score"))


def meta(rows: DataFrame, long_short: bool = False, gap: int = 200) -> DataFrame:
    """Rows with ``p`` closed where a second model does not trust it.

    The second model learns, out of fold, when the first is right on TRAIN; both are trees
    without early stopping.  With 200 such rows or fewer, or one kind, ``p`` stays.
    """
    held, none = folds(rows.where("fits"), 3, gap), F.lit(False)
    parts = []
    for f in range(3):
        part = held.withColumns({"fits": F.col(f"train_{f}"), "judges": none}).where(f"train_{f} OR fold = {f}").drop("score", "p")
        parts.append(fit_scores(part, "xgb_fixed").where(f"fold = {f}").select("key", "bar_ix", "x", ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("int").alias("y")))
    right = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumns({"fits": F.lit(True), "judges": none})
    ones, n = _classes(right)
    if n <= 200 or ones in (0.0, float(n)):
        return rows
    trusted = scored(rows, fit(right, "xgb_fixed"), "trust")
    return trusted.withColumn("p", F.when(F.col("trust") < 0.5, 0.5 if long_short else 0.0).otherwise(F.col("p"))).drop("trust")


def best_cell(cells: DataFrame) -> DataFrame:
    """The cell of each key with the least VAL drawdown area; large gaps of TRAIN and VAL AUC go last."""
    penalty = F.when(F.abs(F.col("train_auc") - F.col("val_auc")) >= 0.05, 1e6).otherwise(0.0)
    order = W.partitionBy("key").orderBy(F.col("drawdown_area") + penalty, "cell")
    return cells.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")

