"""A cell end to end: bars, features, labels, fit on TRAIN, calibrate on VAL, size, score."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventclock.operators import features, label_kernels, labels, models, performance, sizing
from eventclock.plans.config import ADDED, ADDED_KERNELS, BASE_BLOCKS, BASE_KERNELS, CellConfig


def bars_of(clock: DataFrame, cuts: tuple[str, str]) -> DataFrame:
    """Bars as features and labels read them, from key, bar_ix, ts, log_close."""
    from eventclock.functions.dialect import steps
    from eventclock.sources.tables import split_text

    order = "(PARTITION BY key ORDER BY bar_ix)"
    return steps(clock.withColumnRenamed("log_close", "lc").withColumn("seq", F.col("bar_ix")), {"lr": f"coalesce(lc - lag(lc) OVER {order}, 0.0)", "split": split_text(cuts).replace("TIMESTAMP", "TIMESTAMP_NTZ")})


def labelled(bars: DataFrame, labeler: str, horizons: tuple[int, ...] | None = None) -> DataFrame:
    module = labels if labeler in labels.LABELERS else label_kernels
    return module.build(bars, labeler, horizons)


def reach_of(labeler: str, horizons: tuple[int, ...] | None = None) -> int:
    if labeler in labels.LABELERS:
        return labels.labeler_of(labeler, horizons).reach
    return label_kernels.KERNELS[labeler][2] if horizons is None else max(horizons) + 1


def blocks_of(bars: DataFrame, kind: str) -> tuple[list[str], list[str]]:
    """Blocks and kernels of a feature set."""
    blocks, kernels = [*BASE_BLOCKS, *ADDED.get(kind, ())], [*BASE_KERNELS, *ADDED_KERNELS.get(kind, ())]
    if missing := [b for b in blocks if b in features.DRIVEN and not {"drv", "slp"} <= set(bars.columns)]:
        raise ValueError(f"bars without outside series for {missing}")
    return blocks, kernels


def featured(bars: DataFrame, kind: str, held: list[DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """Feature columns of the base and the set; what is cached on the way is added to ``held``.

    A column that no bar of a series can fill, as its window is longer than the series, is zero
    for that series; one that no series can fill is left out.
    """
    blocks, kernels = blocks_of(bars, kind)
    parts = [features.build(bars, b) for b in blocks] + [features.build_kernel(bars, k) for k in kernels]
    seen: set[str] = set()
    kept = []
    for p in parts:
        own = [c for c in p.columns if c not in ("key", "bar_ix") and c not in seen]
        seen |= set(own)
        kept.append(p.select("key", "bar_ix", *own))
    x = fold(lambda a, b: a.join(b, ["key", "bar_ix"]), kept).persist()
    if held is not None:
        held.append(x)
    names = [c for c in x.columns if c not in ("key", "bar_ix")]
    by_key = x.groupBy("key").agg(*[F.count(c).alias(c) for c in names])
    least, most = (by_key.agg(*[f(c).alias(c) for c in names]).first() for f in (F.min, F.max))
    names = [c for c in names if most[c]]
    of_key = W.partitionBy("key")
    return x.select("key", "bar_ix", *[F.col(c) if least[c] else F.when(F.count(c).over(of_key) == 0, 0.0).otherwise(F.col(c)).alias(c) for c in names]), names


def predictions(bars: DataFrame, config: CellConfig, held: list[DataFrame] | None = None) -> DataFrame:
    """key, bar_ix, lc, lr, split, y, p; members of an ensemble are averaged; ``held`` gets what is cached for it."""
    held = [] if held is None else held
    members = []
    x, names = featured(bars, config.features, held)
    for labeler in config.labeler.split("+"):
        y = labelled(bars, labeler, config.horizons)
        rows = models.assembled(x.join(y, ["key", "bar_ix"]).join(bars.select("key", "bar_ix", "ts", "seq", "split", "lc", "lr"), ["key", "bar_ix"]), names)
        rows = models.masks(rows.select("key", "bar_ix", "ts", "seq", "split", "lc", "lr", "y", "x"), models.embargo(config.horizons or (50, 100, 200), reach_of(labeler, config.horizons)), config.train_purge).persist()
        held.append(rows)
        if config.permute_labels:
            dealt = models.permuted(rows).select("key", "bar_ix", F.col("y").alias("__y"))
            rows = rows.join(dealt, ["key", "bar_ix"], "left").withColumn("y", F.coalesce("__y", "y")).drop("__y")
        rows = models.reduce(rows, "autoencoder" if labeler.endswith("_ae") else config.reduce, config.n_components)
        if labeler == "survival_aft":
            rows = models.survival_scores(rows, label_kernels.survival_bounds(bars), config.max_depth).withColumn("p", F.col("score"))
        else:
            rows = models.calibrate(models.fit_scores(rows, config.model, config.max_depth), config.calibration)
        if labeler.endswith("_meta"):
            rows = models.meta(rows, config.sizing.startswith("ls"))
        members.append(rows.select("key", "bar_ix", "ts", "seq", "split", "lc", "lr", "y", "p"))
    if len(members) == 1:
        return members[0]
    by = ["key", "bar_ix", "ts", "seq", "split", "lc", "lr"]
    return fold(DataFrame.unionByName, members).groupBy(*by).agg(F.max("y").alias("y"), F.avg("p").alias("p"))


def run(bars: DataFrame, config: CellConfig, split: str = "val") -> DataFrame:
    """One row per key: the score of the sized predictions on a split.  Nothing stays cached."""
    held: list[DataFrame] = []
    preds = predictions(bars, config, held).where(F.col("split") == split)
    sized = sizing.size(preds, config.sizing, config.thresh).join(preds.select("key", "bar_ix", "lr"), ["key", "bar_ix"])
    found = performance.score(sized, band=config.rebal_band).withColumn("cell", F.lit(config.key()))
    rows, spark = found.collect(), bars.sparkSession  # a row for each key
    for part in held:
        part.unpersist()
    return spark.createDataFrame(rows, found.schema)
