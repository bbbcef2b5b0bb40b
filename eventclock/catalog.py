"""Queries over the supplied tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventclock.operators import axes, book, feature_checks, features, joins, label_checks, label_kernels, labels, model_checks, models, performance, sizing, stats
from eventclock.plans import cell, config
from eventclock.sources import store, tables

Query = Callable[[SparkSession, str], DataFrame]


def _axes() -> tuple[dict[str, Query], dict[str, str]]:
    found, sql = {}, {}
    for name in axes.AXES:
        found[f"axis_{name}"] = lambda spark, sf_dir, name=name: axes.build(tables.ticks(spark, sf_dir), name, tables.TICK_CUTS[0])
        if text := axes.bars_check(tables.ticks_sql(), name, tables.TICK_CUTS[0]):
            sql[f"axis_{name}"] = text
    return found, sql


def _features() -> tuple[dict[str, Query], dict[str, str]]:
    found, sql = {}, {}
    for name in features.BLOCKS:
        found[f"feat_{name}"] = lambda spark, sf_dir, name=name: features.build(tables.bars(spark, sf_dir), name)
        sql[f"feat_{name}"] = features.check(tables.bars_sql(), name)
    for name in features.DRIVEN:
        found[f"feat_{name}"] = lambda spark, sf_dir, name=name: features.build(tables.driven_bars(spark, sf_dir), name)
        sql[f"feat_{name}"] = features.check(tables.driven_bars_sql(), name)
    for name in features.KERNELS:
        found[f"feat_{name}"] = lambda spark, sf_dir, name=name: features.build_kernel(tables.bars(spark, sf_dir), name)
        if name in feature_checks.CHECKS:
            sql[f"feat_{name}"] = feature_checks.check(tables.bars_sql(), name)
    sql["feat_regime"] = features.regime_check(tables.bars_sql())
    return found, sql


def _labels() -> tuple[dict[str, Query], dict[str, str]]:
    found, sql = {}, {}
    for name in labels.LABELERS:
        found[f"label_{name}"] = lambda spark, sf_dir, name=name: labels.build(tables.bars(spark, sf_dir), name)
        sql[f"label_{name}"] = labels.check(tables.bars_sql(), name)
    for name in label_kernels.KERNELS:
        found[f"label_{name}"] = lambda spark, sf_dir, name=name: label_kernels.build(tables.bars(spark, sf_dir), name)
        if name in label_checks.CHECKS:
            sql[f"label_{name}"] = label_checks.check(tables.bars_sql(), name)
    found["label_survival_bounds"] = lambda spark, sf_dir: label_kernels.survival_bounds(tables.bars(spark, sf_dir))
    sql["label_survival_bounds"] = label_checks.survival_bounds(tables.bars_sql())
    return found, sql


THRESH = 0.55


def _sizing() -> tuple[dict[str, Query], dict[str, str]]:
    found, sql = {}, {}
    for mode in [*sizing.modes(THRESH), "cond_es", *sizing.AIMS]:
        found[f"size_{mode}"] = lambda spark, sf_dir, mode=mode: sizing.size(tables.preds(spark, sf_dir), mode, THRESH)
        sql[f"size_{mode}"] = sizing.size_check(tables.preds_sql(), mode, THRESH)
    found["size_executed"] = lambda spark, sf_dir: sizing.executed(sizing.size(tables.preds(spark, sf_dir), "cdf_overlay", THRESH))
    sql["size_executed"] = sizing.executed_check(sizing.size_check(tables.preds_sql(), "cdf_overlay", THRESH))
    return found, sql


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = tables.preds(spark, sf_dir)
    return sizing.size(preds, "cdf_plain", THRESH).join(preds.select("key", "bar_ix", "lr"), ["key", "bar_ix"])


def _sized_sql() -> str:
    return f"SELECT s.*, b.lr FROM ({sizing.size_check(tables.preds_sql(), 'cdf_plain', THRESH)}) s JOIN {tables.bars_sql()} b USING (key, bar_ix)"


def _performance() -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {
        "perf_score": lambda spark, sf_dir: performance.score(_sized(spark, sf_dir)),
        "perf_cost_stress": lambda spark, sf_dir: performance.cost_stress(_sized(spark, sf_dir)),
        "perf_underwater": lambda spark, sf_dir: performance.underwater(tables.curves(spark, sf_dir)),
    }
    sql = {"perf_score": performance.score_check(_sized_sql()), "perf_cost_stress": performance.cost_stress_check(_sized_sql()), "perf_underwater": performance.underwater_check(tables.curves_sql())}
    for name in performance.AGGREGATES:
        found[f"perf_{name}"] = lambda spark, sf_dir, name=name: performance.metric(tables.curves(spark, sf_dir), name)
        sql[f"perf_{name}"] = performance.metric_check(tables.curves_sql(), name)
    return found, sql


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.curves(spark, sf_dir).select("strategy", "t", "ret")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger of trials."""
    o = tables.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderstatus").alias("axis"), (F.col("o_custkey") % 4).cast("string").alias("labeler"), F.lit(0.5).alias("thresh"), F.lit("ramp").alias("sizing"), F.round(F.col("o_totalprice") % 97 / 10, 3).alias("calmar"), F.col("o_orderkey").cast("string").alias("timestamp"))


_LEDGER_SQL = "(SELECT o_orderkey AS id, o_orderpriority AS ticker, o_orderstatus AS axis, CAST(o_custkey % 4 AS VARCHAR) AS labeler, 0.5 AS thresh, 'ramp' AS sizing, round(o_totalprice % 97 / 10, 3) AS calmar, CAST(o_orderkey AS VARCHAR) AS timestamp FROM orders)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells with their label-permuted control."""
    s = tables.screen(spark, sf_dir)
    return s.select("id", F.col("method_calmar").alias("real"), F.col("hold_calmar").alias("hold"), F.round(F.col("method_calmar") * (F.col("id") % 10) / 10, 6).alias("permuted"), (F.col("id") % 7).cast("long").alias("permuted_trades"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as judged cells of a ticker."""
    c = tables.read(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("cell"), F.col("c_acctbal").alias("drawdown_area"), F.lit(0.6).alias("train_auc"), F.round(0.5 + F.col("c_custkey") % 20 / 100, 2).alias("val_auc"))


def _statistics() -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in stats.PROCEDURES:
        found[f"stat_{name}"] = lambda spark, sf_dir, name=name: stats.procedure(tables.trials(spark, sf_dir), name)
        sql[f"stat_{name}"] = stats.procedure_check(tables.trials_sql(), name)
    found |= {
        "stat_lond": lambda spark, sf_dir: stats.lond(tables.trials(spark, sf_dir)),
        "stat_lo_factor": lambda spark, sf_dir: stats.lo_factor(_returns(spark, sf_dir)),
        "stat_kaplan_meier": lambda spark, sf_dir: stats.kaplan_meier(tables.durations(spark, sf_dir)),
        "stat_pair_correlations": lambda spark, sf_dir: stats.pair_correlations(_returns(spark, sf_dir)),
        "stat_affinity": lambda spark, sf_dir: stats.affinity(tables.configs(spark, sf_dir)),
        "stat_effective_trials": lambda spark, sf_dir: stats.effective_configs(tables.configs(spark, sf_dir)),
        "stat_screen_verdicts": lambda spark, sf_dir: stats.screen_verdicts(tables.screen(spark, sf_dir)).select("id", "edge", "verdict"),
        "stat_bootstrap": lambda spark, sf_dir: stats.bootstrap(_returns(spark, sf_dir)),
        "stat_spa": lambda spark, sf_dir: stats.spa(_returns(spark, sf_dir)),
        "stat_pbo": lambda spark, sf_dir: stats.overfit(_returns(spark, sf_dir)),
        "stat_distinct_trials": lambda spark, sf_dir: stats.distinct_trials(_ledger(spark, sf_dir)).groupBy("axis").agg(F.count(F.lit(1)).alias("trials"), F.max("calmar3").alias("best")),
        "stat_champions": lambda spark, sf_dir: stats.champions(_ledger(spark, sf_dir)).select("ticker", "id", "calmar"),
        "stat_total_trials": lambda spark, sf_dir: stats.total_trials(_ledger(spark, sf_dir)),
        "stat_permute_gate": lambda spark, sf_dir: stats.permute_gate(_runs(spark, sf_dir)).select("id", "passed"),
        "stat_screen_rollup": lambda spark, sf_dir: stats.screen_rollup(tables.screen(spark, sf_dir).withColumn("asset_class", F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))),
        "stat_deflated_calmar": lambda spark, sf_dir: stats.deflated_calmar(_returns(spark, sf_dir), 8),
        "stat_deflated_calmar_spectrum": lambda spark, sf_dir: stats.deflated_calmar(_returns(spark, sf_dir), 4, spectrum=True),
    }
    affinity = stats.affinity_check(tables.CONFIGS_SQL)
    verdict = "CASE WHEN hold_trades < 80 THEN 'NO-BASELINE' WHEN method_calmar >= 8 OR abs(hold_calmar) < 0.05 AND method_calmar > 0.5 THEN 'ARTIFACT(cash)' WHEN method_calmar - hold_calmar > 0 AND val_auc > 0.55 AND trades > 80 THEN CASE WHEN method_calmar > 1 AND method_calmar - hold_calmar > 0.3 THEN 'STRONG' ELSE 'marginal' END ELSE 'NO-FIT' END"
    sql |= {
        "stat_lond": stats.lond_check(tables.trials_sql()),
        "stat_lo_factor": stats.lo_factor_check(tables.curves_sql()),
        "stat_kaplan_meier": stats.kaplan_meier_check(tables.DURATIONS_SQL),
        "stat_pair_correlations": stats.pair_correlations_check(tables.curves_sql()),
        "stat_affinity": affinity,
        "stat_effective_trials": f"SELECT round(least(n, greatest(1.0, n * n / (n + 2 * s))), 6) AS n_eff FROM (SELECT coalesce(sum(r * r), 0.0) AS s FROM ({affinity})), (SELECT CAST(count(*) AS DOUBLE) AS n FROM {tables.CONFIGS_SQL})",
        "stat_pbo": model_checks.overfit_check(tables.curves_sql()),
        "stat_distinct_trials": f"SELECT axis, count(*) AS trials, max(calmar) AS best FROM (SELECT DISTINCT axis, labeler, thresh, sizing, calmar FROM {_LEDGER_SQL}) GROUP BY axis",
        "stat_champions": f"SELECT ticker, id, calmar FROM {_LEDGER_SQL} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY calmar DESC, timestamp DESC) = 1",
        "stat_total_trials": f"SELECT count(*) AS global_trials FROM {_LEDGER_SQL}",
        "stat_permute_gate": f"WITH r AS (SELECT id, method_calmar AS real, hold_calmar AS hold, round(method_calmar * (id % 10) / 10, 6) AS permuted, id % 7 AS trades FROM {tables.SCREEN_SQL}) SELECT id, trades >= 3 AND CASE WHEN real - hold > 0.15 THEN permuted - hold < 0.4 * (real - hold) ELSE permuted < 0.6 * real END AS passed FROM r",
        "stat_screen_rollup": f"WITH v AS (SELECT 'c' || (id % 5) AS asset_class, method_calmar - hold_calmar AS edge, {verdict} AS verdict FROM {tables.SCREEN_SQL}) SELECT asset_class, verdict, count(*) AS n, round(avg(edge), 6) AS mean_edge FROM v GROUP BY GROUPING SETS ((asset_class, verdict), (verdict), ())",
        "stat_screen_verdicts": f"SELECT id, round(method_calmar - hold_calmar, 6) AS edge, {verdict} AS verdict FROM {tables.SCREEN_SQL}",
    }
    return found, sql


def _joins() -> tuple[dict[str, Query], dict[str, str]]:
    """Ticks of each event type against those of clicks, and trial tables against each other."""

    def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables.ticks(spark, sf_dir)
        keys = sorted(r.key for r in t.where("key <> 'click'").select("key").distinct().collect())  # kinds of events
        return t.where("key = 'click'").select(F.explode(F.array(*map(F.lit, keys)).cast("array<string>")).alias("key"), "ts", F.col("close").alias("sec"))

    def others(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.ticks(spark, sf_dir).where("key <> 'click'").select("key", "ts", "seq", "close")

    ticks = tables.ticks_sql()
    left, right = f"(SELECT key, ts, seq, close FROM {ticks} WHERE key <> 'click')", f"(SELECT ts, close AS sec FROM {ticks} WHERE key = 'click')"
    found: dict[str, Query] = {
        "join_asof": lambda spark, sf_dir: joins.asof(others(spark, sf_dir), clicks(spark, sf_dir), "sec"),
        "join_asof_strict": lambda spark, sf_dir: joins.asof(others(spark, sf_dir), clicks(spark, sf_dir), "sec", strict=True),
        "join_asof_lag": lambda spark, sf_dir: joins.asof(others(spark, sf_dir), clicks(spark, sf_dir), "sec", lag="7 DAYS"),
        "join_asof_filled": lambda spark, sf_dir: joins.fill_leading(joins.asof(others(spark, sf_dir), clicks(spark, sf_dir), "sec"), "sec", "close"),
        "join_enough": lambda spark, sf_dir: joins.enough(joins.asof(others(spark, sf_dir), clicks(spark, sf_dir), "sec"), "sec").groupBy("key").agg(F.count("sec").alias("n")),
        "join_common_grid": lambda spark, sf_dir: joins.common_grid(_returns(spark, sf_dir), 3),
        "join_semi": lambda spark, sf_dir: joins.when_listed(tables.read(spark, sf_dir, "customer"), tables.read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey"),
        "join_anti": lambda spark, sf_dir: joins.not_listed(tables.read(spark, sf_dir, "customer"), tables.read(spark, sf_dir, "orders").where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey"),
        "join_pending": lambda spark, sf_dir: joins.or_pending(tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), stats.screen_verdicts(tables.screen(spark, sf_dir)).where("trades > 100").select("id", "verdict"), "id"),
        "join_ingest": lambda spark, sf_dir: joins.ingest(tables.ticks(spark, sf_dir).where("key <> 'click'"), clicks(spark, sf_dir), "sec"),
        "join_matched": lambda spark, sf_dir: joins.matched(tables.preds(spark, sf_dir).select("key", "ts", F.col("p").alias("pred")), tables.preds(spark, sf_dir).where("split <> 'test'").select("key", "ts", (F.col("p") + 1e-3).alias("pred"))).select(F.round("max_diff", 9).alias("max_diff"), "unmatched"),
        "join_ensemble": lambda spark, sf_dir: joins.ensemble(_members(spark, sf_dir)).select("key", "ts", F.round("pred", 9).alias("pred")),
    }
    verdicts = _statistics()[1]["stat_screen_verdicts"]
    sql = {
        "join_asof": f"SELECT l.*, r.sec FROM {left} l ASOF LEFT JOIN {right} r ON l.ts >= r.ts",
        "join_asof_strict": f"SELECT l.*, r.sec FROM {left} l ASOF LEFT JOIN {right} r ON l.ts > r.ts",
        "join_asof_lag": f"SELECT l.*, r.sec FROM {left} l ASOF LEFT JOIN (SELECT ts + INTERVAL 7 DAY AS ts, sec FROM {right}) r ON l.ts >= r.ts",
        "join_asof_filled": f"SELECT l.*, coalesce(CASE WHEN r.sec > 0 THEN r.sec END, l.close) AS sec FROM {left} l ASOF LEFT JOIN {right} r ON l.ts >= r.ts",
        "join_enough": f"SELECT key, count(sec) AS n FROM (SELECT l.*, r.sec FROM {left} l ASOF LEFT JOIN {right} r ON l.ts >= r.ts) GROUP BY key HAVING count(sec) >= greatest(300, count(*) / 2)",
        "join_common_grid": f"SELECT strategy, t, ret FROM {tables.curves_sql()} WHERE t IN (SELECT t FROM {tables.curves_sql()} GROUP BY t HAVING count(DISTINCT strategy) = 3)",
        "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
        "join_pending": f"SELECT p.id, coalesce(v.verdict, 'PENDING') AS verdict FROM (SELECT p_partkey AS id FROM part) p LEFT JOIN (SELECT id, verdict FROM ({verdicts}) WHERE id % 200 > 100) v USING (id)",
        "join_ingest": f"SELECT l.key, l.ts, l.close, l.volume, coalesce(r.sec, 0.0) AS sec FROM (SELECT * FROM {ticks} WHERE key <> 'click') l ASOF LEFT JOIN {right} r ON l.ts >= r.ts",
        "join_matched": f"SELECT round(max(abs(a.p - (b.p + 1e-3))), 9) AS max_diff, count(*) FILTER (a.p IS NULL OR b.p IS NULL) AS unmatched FROM {tables.preds_sql()} a FULL JOIN (SELECT * FROM {tables.preds_sql()} WHERE split <> 'test') b ON a.key = b.key AND a.ts = b.ts",
        "join_ensemble": f"SELECT key, ts, round((p + (1 - p) / 2) / 2, 9) AS pred FROM {tables.preds_sql()} WHERE split <> 'val'",
    }
    return found, sql


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = tables.preds(spark, sf_dir)
    first = preds.select("key", "ts", F.lit("a").alias("member"), F.col("p").alias("pred"))
    return first.unionByName(preds.where("split <> 'val'").select("key", "ts", F.lit("b").alias("member"), ((1 - F.col("p")) / 2).alias("pred")))


_kept: dict[tuple[str, str], DataFrame] = {}


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with all features of the base and a label, ready to fit; cached for all queries over them."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _kept:
        for old in _kept.values():
            if old.sparkSession.sparkContext.applicationId == at[0]:
                old.unpersist()
        _kept.clear()
        bars, held = tables.bars(spark, sf_dir), []
        x, names = cell.featured(bars, "base", held)
        rows = x.join(labels.build(bars, "ker_fast"), ["key", "bar_ix"]).join(bars.select("key", "bar_ix", "split"), ["key", "bar_ix"])
        _kept[at] = models.masks(models.assembled(rows, names).select("key", "bar_ix", "split", "y", "x"), 20).persist()
        _kept[at].count()
        for part in held:
            part.unpersist()
    return _kept[at]


def _model_columns() -> list[str]:
    return [*(c for b in config.BASE_BLOCKS for c in features.BLOCKS[b].columns), *(c for k in config.BASE_KERNELS for c in features.KERNELS[k][0])]


def _model_rows_sql() -> str:
    bars = tables.bars_sql()
    parts = [features.check(bars, b) for b in config.BASE_BLOCKS] + [feature_checks.check(bars, k) for k in config.BASE_KERNELS]
    joins_ = " ".join(f"JOIN ({p}) f{i} USING (key, bar_ix)" for i, p in enumerate(parts))
    return f"(SELECT b.split, l.y, b.key, b.bar_ix, {', '.join(_model_columns())} FROM {bars} b JOIN ({labels.check(bars, 'ker_fast')}) l USING (key, bar_ix) {joins_})"


def _cell_sql(key: str) -> str:
    """A logistic cell by hand: fitted scores, isotonic steps, sizes and their score on VAL."""
    bars = tables.bars_sql()
    scored = model_checks.logit_check(_model_rows_sql(), _model_columns(), places=None)
    known = f"SELECT s.key, s.bar_ix, s.score, l.y, b.split, min(CASE WHEN b.split = 'test' THEN s.bar_ix END) OVER (PARTITION BY s.key) AS first_test FROM ({scored}) s JOIN {bars} b USING (key, bar_ix) JOIN ({labels.check(bars, 'ker_fast')}) l USING (key, bar_ix)"
    judged = f"(SELECT key, bar_ix, score, y, split = 'val' AND y >= 0 AND bar_ix < coalesce(first_test, 9e18) - 200 AS judges FROM ({known}))"
    preds = f"(SELECT b.*, c.p FROM {bars} b JOIN ({model_checks.isotonic_check(judged, None)}) c USING (key, bar_ix) WHERE b.split = 'val')"
    sized = f"SELECT s.*, b.lr FROM ({sizing.size_check(preds, 'cdf_plain', 0.5)}) s JOIN {bars} b USING (key, bar_ix)"
    return f"SELECT *, '{key}' AS cell FROM ({performance.score_check(sized)})"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in probabilities as scores to calibrate on VAL."""
    preds = tables.preds(spark, sf_dir)
    return preds.select("key", "bar_ix", F.round("p", 2).alias("score"), F.when(F.col("lr") > 0, 1).otherwise(0).alias("y"), (F.col("split") == "val").alias("judges"))


def _models() -> tuple[dict[str, Query], dict[str, str]]:
    def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
        preds = tables.preds(spark, sf_dir)
        return preds.select("key", F.when(F.col("lr") > 0, 1).otherwise(0).alias("y"), F.round("p", 2).alias("score"))

    def longs(spark: SparkSession, sf_dir: str) -> DataFrame:
        mom = features.build(tables.bars(spark, sf_dir), "panel").join(tables.bars(spark, sf_dir).select("key", "bar_ix", "lr"), ["key", "bar_ix"])
        parts = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in ("p_mom20", "p_abs5")]))
        rows = mom.select("key", "bar_ix", F.when(F.col("lr") > 0, 1).otherwise(0).alias("y"), parts.alias("f"))
        return rows.select("f.feature", "f.x", "y", F.concat_ws("/", "key", F.col("bar_ix").cast("string")).alias("id")).where("x IS NOT NULL")

    panel = features.check(tables.bars_sql(), "panel")
    long_sql = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, CASE WHEN lr > 0 THEN 1 ELSE 0 END AS y, key || '/' || bar_ix AS id FROM ({panel}) JOIN {tables.bars_sql()} USING (key, bar_ix) WHERE {c} IS NOT NULL" for c in ("p_mom20", "p_abs5"))
    label = f"(SELECT key, bar_ix, y, split FROM ({labels.check(tables.bars_sql(), 'ker_fast')}) JOIN {tables.bars_sql()} USING (key, bar_ix))"

    def with_split(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = tables.bars(spark, sf_dir)
        return labels.build(bars, "ker_fast").join(bars.select("key", "bar_ix", "split"), ["key", "bar_ix"])

    plain = config.CellConfig("ALL", "tick", "ker_fast", 0.5, "cdf_plain", model="logit")
    found: dict[str, Query] = {
        "model_auc": lambda spark, sf_dir: models.auc(scored(spark, sf_dir)),
        "model_information": lambda spark, sf_dir: models.binned_information(longs(spark, sf_dir)),
        "model_masks": lambda spark, sf_dir: models.masks(with_split(spark, sf_dir), 200),
        "model_masks_purged": lambda spark, sf_dir: models.masks(with_split(spark, sf_dir), 200, True),
        "model_permuted": lambda spark, sf_dir: models.permuted(with_split(spark, sf_dir)).groupBy("key").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")),
        "model_folds": lambda spark, sf_dir: models.folds(with_split(spark, sf_dir)).groupBy("key", "fold").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(f"train_{f}"), 1)).alias(f"n{f}") for f in range(3)]),
        "cell": lambda spark, sf_dir: cell.run(tables.bars(spark, sf_dir), plain),
        "cell_survival": lambda spark, sf_dir: cell.run(tables.bars(spark, sf_dir), config.CellConfig("ALL", "tick", "survival_aft", 0.5, "cdf_plain")),
        "cell_meta": lambda spark, sf_dir: _meta(spark, sf_dir),
    }
    sql = {
        "model_auc": models.auc_check(f"(SELECT key, CASE WHEN lr > 0 THEN 1 ELSE 0 END AS y, round(p, 2) AS score FROM {tables.preds_sql()})"),
        "model_information": models.binned_information_check(f"({long_sql})"),
        "model_masks": models.masks_check(label, 200),
        "model_masks_purged": models.masks_check(label, 200, True),
        "model_permuted": f"SELECT key, sum(y) AS ones, count(*) AS n FROM {label} WHERE split = 'train' AND y >= 0 GROUP BY key",
        "model_folds": f"""
WITH r AS (SELECT *, ntile(3) OVER (PARTITION BY key ORDER BY bar_ix) - 1 AS fold FROM {label} WHERE split = 'train' AND y >= 0),
b AS (SELECT key, fold, min(bar_ix) AS lo, max(bar_ix) AS hi FROM r GROUP BY 1, 2)
SELECT r.key, r.fold, count(DISTINCT r.bar_ix) AS n, {', '.join(f"count(CASE WHEN b.fold = {f} AND (r.bar_ix < b.lo - 200 OR r.bar_ix > b.hi + 200) THEN 1 END) AS n{f}" for f in range(3))} FROM r JOIN b USING (key) GROUP BY 1, 2""",
    }
    for method in models.REDUCERS:
        found[f"reduce_{method}"] = lambda spark, sf_dir, m=method: _shown(models.reduce(_model_rows(spark, sf_dir), m, 20), 4 if m == "minor_pca" else 6)
        if text := model_checks.reduce_check(_model_rows_sql(), _model_columns(), method, 20):
            sql[f"reduce_{method}"] = text
    for name in models.MODELS:
        found[f"fit_{name}"] = lambda spark, sf_dir, m=name: models.fit_scores(models.reduce(_model_rows(spark, sf_dir)), m).select("key", "bar_ix", F.round("score", 6).alias("score"))
    for kind in models.CALIBRATIONS:
        found[f"calibrate_{kind}"] = lambda spark, sf_dir, k=kind: models.calibrate(_judged(spark, sf_dir), k).select("key", "bar_ix", F.round("p", 6).alias("p"))
    judged = f"(SELECT key, bar_ix, round(p, 2) AS score, CASE WHEN lr > 0 THEN 1 ELSE 0 END AS y, split = 'val' AS judges FROM {tables.preds_sql()})"
    sql |= {"cell": _cell_sql(plain.key()), "fit_logit": model_checks.logit_check(_model_rows_sql(), _model_columns()), "calibrate_beta": model_checks.beta_check(judged)}
    sql |= {"calibrate_isotonic": model_checks.isotonic_check(judged), "calibrate_venn_abers": model_checks.venn_abers_check(judged)}
    found["model_best_cell"] = lambda spark, sf_dir: models.best_cell(_cells(spark, sf_dir)).select("key", "cell")
    sql["model_best_cell"] = "SELECT c_mktsegment AS key, c_name AS cell FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal + CASE WHEN abs(0.6 - round(0.5 + c_custkey % 20 / 100, 2)) >= 0.05 THEN 1e6 ELSE 0 END, c_name) = 1"
    found["model_scaler"] = lambda spark, sf_dir: models.scaler(_model_rows(spark, sf_dir).where("fits")).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))
    sql["model_scaler"] = model_checks.scaler_check(_model_rows_sql(), _model_columns())
    return found, sql


def _shown(rows: DataFrame, places: int = 6) -> DataFrame:
    """key, bar_ix, part, z: a row for each part of a reduced row."""
    from pyspark.ml.functions import vector_to_array

    return rows.select("key", "bar_ix", F.posexplode(vector_to_array("x")).alias("part", "z")).select("key", "bar_ix", "part", (F.round("z", places) + F.lit(0.0)).alias("z"))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.calibrate(models.fit_scores(models.reduce(_model_rows(spark, sf_dir)), "xgb"))
    return models.meta(rows).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p") == 0, 1)).alias("closed"))


def _logged(curve: DataFrame) -> DataFrame:
    return curve.select("t", "ret", (F.round(F.log("equity"), 6) + F.lit(0.0)).alias("log_equity"))


def _books() -> tuple[dict[str, Query], dict[str, str]]:
    """Books of the daily series: their champions' weights are the ranks of their keys."""

    def champions(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = tables.preds(spark, sf_dir).select("key").distinct()
        return keys.select("key", F.ascii("key").cast("double").alias("weight"))

    def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
        return book.replay(tables.preds(spark, sf_dir), champions(spark, sf_dir), "cdf_overlay", THRESH)

    def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = tables.bars(spark, sf_dir)
        return book.hold(bars, bars.select("key").distinct().count())

    def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = tables.curves(spark, sf_dir).select("strategy").distinct()
        every = names.select(F.lit("every").alias("label"), "strategy")
        return every.unionByName(names.where("strategy <> 'N'").select(F.lit("without N").alias("label"), "strategy"))

    def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
        curves = tables.curves(spark, sf_dir)
        return book.derived(curves, compositions(spark, sf_dir), curves.select("strategy").distinct().count())

    replay_sql = book.replay_check(tables.preds_sql(), sizing.size_check(tables.preds_sql(), "cdf_overlay", THRESH), f"(SELECT DISTINCT key, CAST(ascii(key) AS DOUBLE) AS weight FROM {tables.preds_sql()})")
    hold_sql = book.hold_check(tables.bars_sql(), f"(SELECT count(DISTINCT key) FROM {tables.bars_sql()})")
    names = f"(SELECT DISTINCT strategy FROM {tables.curves_sql()})"
    labelled = f"(SELECT 'every' AS label, strategy FROM {names} UNION ALL SELECT 'without N', strategy FROM {names} WHERE strategy <> 'N')"
    found: dict[str, Query] = {
        "book_replay": lambda spark, sf_dir: _logged(replayed(spark, sf_dir)),
        "book_metrics": lambda spark, sf_dir: book.metrics(replayed(spark, sf_dir)),
        "book_years": lambda spark, sf_dir: book.yearly(replayed(spark, sf_dir)),
        "book_hold": lambda spark, sf_dir: _logged(bought(spark, sf_dir)),
        "book_hold_metrics": lambda spark, sf_dir: book.metrics(bought(spark, sf_dir)),
        "book_derived": derived,
        "perf_older_score": lambda spark, sf_dir: book.older_score(tables.preds(spark, sf_dir), THRESH),
        "perf_older_score_overlay": lambda spark, sf_dir: book.older_score(tables.preds(spark, sf_dir), THRESH, wild=True),
    }
    sql = {
        "book_replay": f"SELECT t, ret, round(ln(equity), 6) + 0.0 AS log_equity FROM ({replay_sql})",
        "book_metrics": book.metrics_check(replay_sql),
        "book_years": book.yearly_check(replay_sql),
        "book_hold": f"SELECT t, ret, round(ln(equity), 6) + 0.0 AS log_equity FROM ({hold_sql})",
        "book_hold_metrics": book.metrics_check(hold_sql),
        "book_derived": book.derived_check(tables.curves_sql(), labelled, f"(SELECT count(*) FROM {names})"),
        "perf_older_score": book.older_score_check(tables.preds_sql(), THRESH),
        "perf_older_score_overlay": book.older_score_check(tables.preds_sql(), THRESH, wild=True),
    }
    return found, sql


def _sources() -> tuple[dict[str, Query], dict[str, str]]:
    """Option chains and stored rows: lines as quotes of a day, orders as revisions of a customer's cell."""

    def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = tables.read(spark, sf_dir, "lineitem")
        return lines.select(F.col("l_shipdate").alias("day"), (F.col("l_linenumber") * 10).alias("days_left"), (F.col("l_partkey") % 60 + 70.0).alias("strike"), F.col("l_discount").cast("double").alias("iv"), F.lit(100.5).alias("spot"))

    def chunks(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
        days = store.snapshot_iv(chain(spark, sf_dir))
        return [days.where("day < DATE'1998-01-01'"), days.where("day >= DATE'1997-01-01'").withColumn("iv", F.round(F.col("iv") + 1, 6))]

    def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = tables.read(spark, sf_dir, "orders")
        return o.select(F.col("o_custkey").alias("cell_key"), F.concat_ws("/", F.col("o_orderdate").cast("date").cast("string"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("timestamp"), F.col("o_orderkey").alias("id"))

    quotes = "(SELECT CAST(l_shipdate AS DATE) AS day, l_shipdate, l_linenumber * 10 AS days_left, l_partkey % 60 + 70.0 AS strike, CAST(l_discount AS DOUBLE) AS iv FROM lineitem)"
    snapshot = f"SELECT l_shipdate AS day, round(iv, 6) AS iv FROM {quotes} WHERE days_left BETWEEN 20 AND 45 AND iv > 0 QUALIFY row_number() OVER (PARTITION BY l_shipdate ORDER BY abs(strike - 100.5), days_left, strike, iv) = 1"
    revised = "(SELECT o_custkey AS cell_key, strftime(o_orderdate, '%Y-%m-%d') || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS timestamp, o_orderkey AS id FROM orders)"
    found: dict[str, Query] = {
        "source_iv_snapshot": lambda spark, sf_dir: store.snapshot_iv(chain(spark, sf_dir)),
        "source_iv_merged": lambda spark, sf_dir: store.merged_iv(chunks(spark, sf_dir)),
        "source_latest": lambda spark, sf_dir: store.latest(revisions(spark, sf_dir), "cell_key").select("cell_key", "id"),
        "source_stale": lambda spark, sf_dir: store.stale(tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_key")), revisions(spark, sf_dir).where("id % 3 = 0")),
    }
    sql = {
        "source_iv_snapshot": snapshot,
        "source_iv_merged": f"WITH d AS ({snapshot}) SELECT day, CASE WHEN day >= DATE '1997-01-01' THEN round(iv + 1, 6) ELSE iv END AS iv FROM d",
        "source_latest": f"SELECT cell_key, id FROM {revised} QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY timestamp DESC) = 1",
        "source_stale": f"SELECT c_custkey AS cell_key FROM customer WHERE c_custkey NOT IN (SELECT cell_key FROM {revised} WHERE id % 3 = 0)",
    }
    return found, sql


def _all() -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for part in (_axes, _features, _labels, _sizing, _performance, _statistics, _joins, _models, _books, _sources):
        q, s = part()
        found |= q
        sql |= s
    return found, sql


def queries() -> dict[str, Query]:
    return _all()[0]


def oracle_sql() -> dict[str, str]:
    return _all()[1]
