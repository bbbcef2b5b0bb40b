"""Hand-computed values and properties."""

import inspect
import itertools
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventclock import catalog
from eventclock.operators import axes, clocks, label_kernels, learners, models, performance, stats
from eventclock.plans import bundle, cell, config
from eventclock.plans.config import CellConfig
from eventclock.sources import tables

DATA = "/root/testdata/sf0.001"


def test_clocks():
    assert [clocks.Reset(3).step(x) for x in (1, 5)] == [False, True]
    carry = clocks.Carry(3)
    assert [carry.step(x) for x in (2, 2, 2)] == [False, True, True]
    turn = clocks.Reversal(2)
    assert [turn.step(x) for x in (0, 3, 1.5, 1, 0, 2)] == [False, False, False, True, False, True]
    run = clocks.Run(3)
    assert [run.step(x) for x in (2, -2, -1, 1)] == [False, False, True, False]


@pytest.mark.parametrize("name", ["dollar", "imbalance", "jump", "entropy", "kalman", "pecusum", "gapflow"])
def test_later_rows_leave_earlier_bars(spark, name):
    ticks = tables.ticks(spark, DATA)
    cut = tables.TICK_CUTS[0]
    changed = ticks.withColumn("close", F.when(F.col("ts") >= F.lit(cut).cast("timestamp_ntz"), F.col("close") * 3 + 1).otherwise(F.col("close")))
    early = [axes.build(t, name, cut).where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")).orderBy("key", "bar_ix").collect() for t in (ticks, changed)]
    assert early[0] == early[1] and early[0]


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        axes.build(tables.ticks(spark, DATA), "nothing", tables.TICK_CUTS[0])


@pytest.mark.parametrize(("equity", "want"), [([100, 101, 103, 106, 110], (0, 0, 0, 0, math.inf)), ([100, 90, 100], (0.1, 0.1 / 3, math.sqrt(0.01 / 3), 1, 0)), ([100, 90, 90, 90, 100], (0.1, 0.06, math.sqrt(0.03 / 5), 3, 0))])
def test_drawdown(spark, equity, want):
    rows = spark.createDataFrame([("s", i, float(e)) for i, e in enumerate(equity)], "strategy string, t long, equity double")
    r = performance.metric(rows, "drawdown").first()
    assert (r.max_drawdown, r.pain_index, r.ulcer_index, r.max_dd_duration, r.martin_ratio) == pytest.approx(want, abs=1e-6)


def test_multiple_testing(spark):
    def run(name, ps):
        rows = spark.createDataFrame([("f", i, 100, 0.1, 0.0, 3.0, p) for i, p in enumerate(ps)], "family string, trial long, n long, sr double, skew double, kurt double, p double")
        return [bool(r[2]) for r in stats.procedure(rows, name).orderBy("trial").collect()]

    assert run("holm", [0.01, 0.04, 0.03, 0.005]) == [True, False, False, True]
    assert run("bh", [0.001, 0.008, 0.039, 0.041, 0.9, 0.95]) == [True, True, True, True, False, False]


def test_kaplan_meier(spark):
    rows = spark.createDataFrame([("f", t, e) for t, e in zip([2, 3, 4, 5, 5], [1, 1, 0, 1, 1], strict=True)], "family string, t long, event int")
    found = {r.t: r.survival for r in stats.kaplan_meier(rows).collect()}
    assert found == {2: 0.8, 3: 0.6, 4: 0.6, 5: 0.0}


def test_effective_trials(spark):
    def n_eff(matrix):
        n = len(matrix)
        pairs = [(i, j, float(matrix[i][j])) for i in range(n) for j in range(i + 1, n)]
        return stats.effective_trials(spark.createDataFrame(pairs, "a int, b int, r double"), n).first()[0]

    assert n_eff(np.eye(5)) == 5
    assert n_eff(np.ones((5, 5))) == 1
    assert n_eff(np.kron(np.eye(2), np.ones((3, 3)))) == 2


def test_overfitting():
    rows = range(256)
    genuine = np.array([[0.02 + 0.001 * ((r * 7 + 1) % 5 - 2)] + [0.001 * (r * (s + 3) % 7 - 3) for s in range(1, 8)] for r in rows])
    overfit = np.array([[0.001 * ((r + 1) * (s + 2) % 11 - 5) for s in range(8)] for r in rows])
    assert stats.pbo(genuine, 8)[0] < 0.3 < 0.7 < stats.pbo(overfit, 8)[0]


def test_superior_ability(spark):
    g = np.random.default_rng(11)
    noise = g.normal(0, 0.01, (300, 20))
    real = noise.copy()
    real[:, 7] += 0.004

    def p_value(x):
        rows = [(f"s{j:02}", t, float(x[t, j])) for t in range(len(x)) for j in range(x.shape[1])]
        return stats.spa(spark.createDataFrame(rows, "strategy string, t long, ret double"), 200, 15).first().p_value

    assert p_value(noise) > 0.1 > 0.05 > p_value(real)


def test_keys_differ():
    kinds = itertools.product(["correlation", "infogain", "pca"], ["base", "rich", "termstruct", "iv"], ["isotonic", "venn_abers", "beta"], ["xgb", "logit"], [20, 15], [None, (2, 5)], [False, True])
    keys = [CellConfig("X", "dollar", "ker", 0.5, "binary", reduce=r, features=f, calibration=c, model=m, n_components=n, horizons=h, permute_labels=p).key() for r, f, c, m, n, h, p in kinds]
    assert len(set(keys)) == len(keys)


@pytest.mark.parametrize("wrong", [{"thresh": 1.0}, {"axis": "x"}, {"labeler": "ker+x"}, {"horizons": (1,)}, {"rebal_band": 0.3}, {"max_depth": 9}])
def test_config_is_checked(wrong):
    with pytest.raises(ValueError):
        CellConfig(**{"ticker": "X", "axis": "dollar", "labeler": "ker", "thresh": 0.5, "sizing": "binary"} | wrong)


def _bars(n=2500):
    g = np.random.default_rng(0)
    lr = g.normal(0, 0.01, n)
    lr[0] = 0
    split = np.where(np.arange(n) < 1500, "train", np.where(np.arange(n) < 2000, "val", "test"))
    return pd.DataFrame({"lc": np.cumsum(lr) + 4, "lr": lr, "split": split})


def test_first_touch_by_brute_force():
    b = label_kernels.Bars(_bars(400))
    y = next(label_kernels.barriers(2.0)(b))[0]
    sigma = b.sigma()
    for t in range(0, 340, 7):
        move, want = 0.0, None
        for j in range(t + 1, t + 51):
            move = b.lc[j] - b.lc[t]
            if abs(move) >= 2 * sigma[t]:
                want = int(move > 0)
                break
        assert y[t] == (int(move > 0) if want is None else want)


@pytest.mark.parametrize("name", ["sticky_hmm", "jump_model", "kllt", "regime_gmm"])
def test_test_rows_leave_earlier_labels(name):
    part = _bars()
    tries, gates, reach = label_kernels.KERNELS[name]
    changed = part.copy()
    at = changed["split"] == "test"
    changed.loc[at, "lr"] = np.random.default_rng(1).normal(0, 0.03, at.sum())
    changed["lc"] = np.cumsum(changed["lr"]) + 4
    with np.errstate(all="ignore"):
        found = [label_kernels.choose(b, tries(b), **gates) for b in (label_kernels.Bars(part), label_kernels.Bars(changed))]
    assert (found[0][: 2000 - 200] == found[1][: 2000 - 200]).all()


def test_isotonic_and_venn_abers():
    _, value = models.pool_adjacent(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert value.tolist() == [0, 0.5, 0.5, 1]
    g = np.random.default_rng(0)
    x, y = np.round(g.random(200), 2), (g.random(200) < 0.5).astype(float)
    at = np.unique(x)
    pools = models.VennAbers(at, np.array([(x == a).sum() for a in at], float), np.array([y[x == a].sum() for a in at]))
    for s in [*at, 0.005, 0.333, -1.0, 2.0]:
        p0, p1 = (float(np.interp(s, *models.pool_adjacent(np.append(x, s), np.append(y, label)))) for label in (0.0, 1.0))
        assert pools.probability(s) == pytest.approx(p1 / (1 - p0 + p1))


def test_reducers(spark):
    from pyspark.ml.linalg import Vectors

    g = np.random.default_rng(0)
    x = g.normal(size=(400, 6))
    x[:, 5] = x[:, 0] + 0.01 * x[:, 5]
    y = (x[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([("k", i, int(y[i]), True, Vectors.dense(x[i])) for i in range(400)], ["key", "bar_ix", "y", "fits", "x"])
    m = models.Moments.of(rows)
    assert len(models._pruned(m)) == 5
    for method in models.REDUCERS:
        out = models.reduce(rows, method, 3)
        assert out.count() == 400 and 1 <= len(out.first()["x"]) <= 4


def _classes(n=900, d=6, seed=0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, d))
    return x, (x[:, 0] + x[:, 1] * x[:, 2] + 0.7 * g.normal(size=n) > 0).astype(float)


@pytest.mark.parametrize("name", list(learners.FAMILIES))
def test_boosted_families(name):
    x, y = _classes()
    xv, yv = _classes(400, seed=1)
    rules = replace(learners.FAMILIES[name], rounds=60)
    model = learners.classify(x, y, np.ones(len(x)), (xv, yv), rules, 42)
    assert learners.auc(yv, model.score(xv)) > 0.7
    assert np.array_equal(learners.from_json(learners.to_json(model)).score(xv), model.score(xv))
    if rules.patience is None:
        assert len(model.trees) == 60
    else:  # what stays ends at the best round
        margins = [learners.Boosted(model.base, model.trees[:k]).margin(xv) for k in range(1, len(model.trees) + 1)]
        assert learners.auc(yv, margins[-1]) == max(learners.auc(yv, m) for m in margins)


def test_a_tree_by_brute_force():
    """The first split of boosted trees is the best of all cuts between TRAIN values."""
    x, y = _classes(200, 3)
    rules = learners.Rules(rounds=1, depth=1, rows=1.0, columns=1.0, least_weight=0.0)
    tree = learners.classify(x, y, np.ones(len(x)), (x[:0], y[:0]), rules, 0).trees[0]
    g, h = 0.5 - y, np.full(len(y), 0.25)
    worth = lambda s: max(abs(g[s].sum()) - 1, 0) ** 2 / (h[s].sum() + 2)
    best = max(((worth(x[:, f] <= t) + worth(x[:, f] > t), f, t) for f in range(3) for t in x[:, f]), key=lambda c: c[0])
    got = x[:, tree.feature[0]] <= tree.threshold[0]
    assert worth(got) + worth(~got) == pytest.approx(best[0])


def test_area_under_the_curve():
    g = np.random.default_rng(1)
    score, y = np.round(g.random(60), 1), (g.random(60) < 0.4).astype(float)
    pos, neg = score[y == 1], score[y == 0]
    assert learners.auc(y, score) == pytest.approx(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())
    assert learners.auc(np.ones(3), np.arange(3.0)) == 0.5


def test_logistic_is_where_its_slope_is_zero():
    x, y = _classes(300, 4)
    w = np.where(y == 1, 2.0, 1.0)
    m = learners.logistic(x, y, w, 0.7)
    off = w * (m.score(x) - y)
    assert np.abs(x.T @ off + 0.7 * m.weights).max() < 1e-8 and abs(off.sum()) < 1e-8


def test_survival_falls_with_time():
    g = np.random.default_rng(2)
    x = g.normal(size=(800, 3))
    time = np.exp(2 + x[:, 0] + 0.2 * g.normal(size=800))
    closed = time > 20
    m = learners.survive(x, np.minimum(time, 20), np.where(closed, np.inf, time), learners.Rules(l1=0.0, l2=1.0, rows=1.0, columns=1.0))
    assert np.corrcoef(m.score(x), -x[:, 0])[0, 1] > 0.9 and ((m.score(x) > 0) & (m.score(x) < 1)).all()
    assert np.array_equal(learners.from_json(learners.to_json(m)).score(x), m.score(x))


@pytest.mark.parametrize("made", ["autoencoder", "variational"])
def test_encoders_learn(made):
    """The code of data of two dimensions tells the rows apart."""
    g = np.random.default_rng(0)
    z = g.normal(size=(600, 2))
    x = np.column_stack([z, z[:, 0] + z[:, 1], z[:, 0] - z[:, 1]])
    encoder = learners.autoencoder(x, 2, 16, 3e-3) if made == "autoencoder" else learners.variational(x, 2, (z[:, 0] > 0).astype(float))
    code = encoder.encode(x)
    wide = np.column_stack([code[:, :2], np.ones(len(x))])
    rest = x - wide @ np.linalg.lstsq(wide, x, rcond=None)[0]
    assert (rest**2).mean() < 0.3 * (x**2).mean()
    if made == "variational":
        assert code.shape == (600, 3) and np.corrcoef(code[:, 2], z[:, 0])[0, 1] > 0.5


def test_slopes_of_a_net():
    g = np.random.default_rng(3)
    net, x, goal = learners.Net([3, 4, 2], (1,), g), g.normal(size=(5, 3)), g.normal(size=(5, 2))
    loss = lambda: float(((net.forward(x)[-1] - goal) ** 2).sum())
    slopes, _ = net.backward(net.forward(x), 2 * (net.forward(x)[-1] - goal))
    for p, d in zip((*net.w, *net.b), slopes, strict=True):
        at = (0,) * p.ndim
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert d[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_fits_and_scores(spark):
    from pyspark.ml.linalg import Vectors

    x, y = _classes(600, 4)
    rows = spark.createDataFrame([("k", i, int(y[i]), i < 400, i >= 400, Vectors.dense(x[i])) for i in range(600)], ["key", "bar_ix", "y", "fits", "judges", "x"])
    assert inspect.signature(models.fit_scores).parameters["rounds"].default == 200
    for name in ("xgb", "lgbm_bag", "logit"):
        found = models.fit_scores(rows.repartition(3), name, rounds=30).where("judges").orderBy("bar_ix").collect()
        assert learners.auc(y[400:], np.array([r.score for r in found])) > 0.65
        again = models.fit_scores(rows, name, rounds=30).where("judges").orderBy("bar_ix").collect()
        assert [r.score for r in found] == [r.score for r in again]  # however rows are dealt
    one = models.fit_scores(rows.withColumn("y", F.lit(1)), "xgb")
    assert {r.score for r in one.select("score").distinct().collect()} == {1.0}
    with pytest.raises(ValueError):
        models.fit_scores(rows, "forest")


def test_resampling_covers_every_curve(spark):
    found = catalog.queries()["stat_bootstrap"](spark, DATA).groupBy("strategy").count().collect()
    assert {r.strategy: r["count"] for r in found} == {"A": 2000, "N": 2000, "R": 2000}
    for name in ("stat_deflated_calmar", "stat_deflated_calmar_spectrum"):
        rows = catalog.queries()[name](spark, DATA).collect()
        assert sorted(r.strategy for r in rows) == ["A", "N", "R"]
        assert all(r.p_value * 400 == pytest.approx(round(r.p_value * 400)) and r.passed == (r.real > r.p95) for r in rows)


def test_replicates_are_those_of_the_curve(spark):
    x = np.random.default_rng(3).normal(0, 0.01, 120)
    rows = spark.createDataFrame([(s, t, float(x[t] * k)) for s, k in (("a", 1), ("b", 2)) for t in reversed(range(120))], "strategy string, t long, ret double")
    want = [stats.sharpe(x[stats.stationary_index(120, 20, np.random.default_rng([42, i]))]) for i in range(40)]
    found = stats.bootstrap(rows, 40).orderBy("strategy", "replicate").collect()
    assert [r.value for r in found] == pytest.approx(want * 2)
    assert inspect.signature(stats.spa).parameters["count"].default == 2000


def test_ward_merges_all_rows():
    r = np.random.default_rng(0).normal(size=700)
    x = np.stack([r, np.abs(r)], axis=1)
    centres, sizes = x.copy(), np.ones(len(x))
    found = label_kernels.ward(x, (2, 3, 4))
    while len(centres) > 2:  # greedy, over all pairs
        cost = sizes[:, None] * sizes / (sizes[:, None] + sizes) * ((centres[:, None] - centres) ** 2).sum(axis=2)
        np.fill_diagonal(cost, np.inf)
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        centres[i] = (sizes[i] * centres[i] + sizes[j] * centres[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        centres, sizes = np.delete(centres, j, axis=0), np.delete(sizes, j)
        if len(centres) in found:
            assert np.allclose(sorted(map(tuple, centres)), sorted(map(tuple, found[len(centres)])))


def test_windows_go_only_where_they_do_not_fit(spark):
    bars = tables.bars(spark, DATA)
    most = bars.groupBy("key").count().agg(F.max("count")).first()[0]
    short = bars.where("key <> 'A' OR bar_ix < 300")
    x, names = cell.featured(short, "base")
    assert {"sampen_50_1", "sampen_move_100", "std_200", "kurt_lr_200", "above_200"} <= set(names)
    assert ("std_800" in names) == (most >= 800)
    row = x.where("key = 'A' AND bar_ix = 299").first()
    assert row.std_200 is not None and row.std_400 == 0 and row.mean_800 == 0
    assert x.where("key = 'N' AND bar_ix < 399 AND std_400 IS NOT NULL").count() == 0


def test_driven_sets_are_built_or_raise(spark):
    with pytest.raises(ValueError):
        cell.featured(tables.bars(spark, DATA), "termstruct")
    x, names = cell.featured(tables.driven_bars(spark, DATA), "oilbasis")
    assert {"ob_roll20", "ob_z252"} <= set(names)


@pytest.mark.parametrize("kind", ["ffd", "riccati"])
def test_filters_are_whole(kind):
    if kind == "ffd":
        assert len(axes.ffd_weights(0.1)) > 400 and abs(axes.ffd_weights(0.3)[-1]) >= 1e-4
    else:
        assert axes._fixed_point(1e-4, 1e-5, 1e-9) == axes._fixed_point(1e-4, 1e-5, 1e-9, 6_000) != axes._fixed_point(1e-4, 1e-5, 1e-9, 300)


def test_bars_follow_the_ticks_asked_for(spark):
    ticks = tables.ticks(spark, DATA)
    few, many = (axes.build(ticks, "dollar", tables.TICK_CUTS[0], n).count() for n in (50, 5))
    assert many > 5 * few > 0


def test_clocks_read_a_batch_at_a_time(spark):
    """Bars don't depend on how many ticks a batch holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = sorted(map(tuple, axes.build(tables.ticks(spark, DATA), "run", tables.TICK_CUTS[0]).collect()))
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert sorted(map(tuple, axes.build(tables.ticks(spark, DATA), "run", tables.TICK_CUTS[0]).collect())) == want
    finally:
        spark.conf.set(key, before)


def test_horizons_of_a_cell(spark):
    bars = tables.bars(spark, DATA)
    same = cell.labelled(bars, "ker", (20, 40, 80)).exceptAll(cell.labelled(bars, "ker"))
    assert same.count() == 0 and cell.reach_of("ker", (5, 10)) == 10 and cell.reach_of("triple_barrier", (5, 10)) == 11
    short = cell.labelled(bars, "triple_barrier", (5,)).groupBy("key").agg(F.max("bar_ix").alias("last"), F.max(F.when(F.col("y") >= 0, F.col("bar_ix"))).alias("labelled")).collect()
    assert any(r.labelled == r.last - 5 for r in short)  # a bar with five behind it has a label
    for name in ("always_long", "dc_trend"):
        with pytest.raises(ValueError, match="no horizons"):
            cell.labelled(bars, name, (5, 10))
    assert sum(map(label_kernels.sweeps, label_kernels.KERNELS)) >= 30
    assert [config.default_threshold(t) for t in ("XLE", "QQQ", "HYG", "TLT", "GLD", "SPY")] == [0.1, 0.15, 0.55, 0.55, 0.35, 0.45]


def test_a_bundle_scores_what_it_was_fitted_on(spark):
    x, y = _classes(700, 5)
    rows = spark.createDataFrame([("k", i, "train" if i < 450 else "val", int(y[i]), i < 450, i >= 450, *map(float, x[i])) for i in range(700)], "key string, bar_ix long, split string, y int, fits boolean, judges boolean, a double, b double, c double, d double, e double")
    made = bundle.fit(rows, ["a", "b", "c", "d", "e"], n=5)
    again = bundle.Bundle.from_json(made.to_json())
    found = again.predict(rows).orderBy("bar_ix").collect()
    assert [r.p for r in found] == pytest.approx(made.probability(x).tolist())
    assert learners.auc(y[450:], np.array([r.p for r in found[450:]])) > 0.7
    odd = rows.limit(2).withColumn("a", F.when(F.col("bar_ix") == 0, F.lit(None)).otherwise(F.lit(float("nan"))))
    assert [r.p for r in again.predict(odd).collect()] == [None, None]


def test_bayesian_mixture_lets_needless_components_go():
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(0, 0.3, (300, 2)), g.normal(4, 0.3, (300, 2))])
    part = label_kernels.bayesian_mixture(x, 5)
    share = part(x)
    assert share.argmax(axis=1)[0] != share.argmax(axis=1)[-1] and (np.bincount(share.argmax(axis=1), minlength=5) > 5).sum() <= 3
    assert label_kernels.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890])


def test_full_covariances_of_a_hidden_chain():
    """Two states with the same mean and variances but opposite correlation are told apart."""
    g = np.random.default_rng(1)
    state = np.repeat(np.arange(12) % 2, 60)
    z = g.normal(size=(720, 2))
    x = np.stack([z[:, 0], np.where(state == 0, 0.95, -0.95) * z[:, 0] + 0.3 * z[:, 1]], axis=1)
    chain = label_kernels.GaussianChain(x, 2, rounds=100, full=True)
    found = chain.shares(x).argmax(axis=1)
    assert max((found == state).mean(), (found != state).mean()) > 0.9
