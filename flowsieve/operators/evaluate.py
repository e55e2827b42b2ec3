"""Evaluation tables: confusion, per-class report, threshold metrics, ROC, distributions, timeline."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import finite_or_null, is_floating, named
from flowsieve.functions.vectors import argmax, at, cross_entropy, in_top_k, mean_squared_error
from flowsieve.operators.bounds import bounded_rows
from flowsieve.operators.ranges import ROWS_PER_RANGE, cut_points, neighbour_windows, running_totals
from flowsieve.session import written_table

RECONSTRUCTION_WEIGHT = 0.3
AUC_THRESHOLDS = 200
MAX_GRID_CLASSES = 2_000
MAX_HOURS = 1_000_000
FAR_BANDWIDTHS = 8
BINS_PER_BANDWIDTH = 256


def confusion(df: DataFrame, true: str, predicted: str, classes: list | None = None) -> DataFrame:
    """Counts and row percentages for all class pairs, pairs that never occur included.

    Without ``classes`` the grid holds every class seen on either side. The rows are read once; the
    grid is laid out by a list of classes that the driver has counted. A class without true rows has a NULL percentage.
    """
    pairs = df.groupBy(named(true).alias("t"), named(predicted).alias("p")).agg(F.count("*").alias("n"))
    kind = df.schema[true].dataType
    pairs = written_table(pairs, "class-pairs")
    if classes is None:
        sides = pairs.select(F.explode(F.array("t", "p")).alias("c")).where("c is not null").distinct()
        grid = [row["c"] for row in bounded_rows(sides, MAX_GRID_CLASSES, f"classes of {true}")]
    else:
        grid = classes
    every = F.array(*[F.lit(c) for c in grid]).cast(T.ArrayType(kind))
    empty = df.sparkSession.range(1).select(F.explode(every).alias("t")).select("t", F.explode(every).alias("p"), F.lit(0).cast("bigint").alias("n"))
    cells = pairs.unionByName(empty).groupBy("t", "p").agg(F.sum("n").alias("n"))
    if classes is not None:
        cells = cells.where(F.col("t").isin(classes) & F.col("p").isin(classes))
    row_n = F.sum("n").over(Window.partitionBy("t"))
    percent = F.when(row_n > 0, 100.0 * F.col("n") / row_n)
    return cells.select(F.col("t").alias("true_class"), F.col("p").alias("predicted_class"), "n", percent.alias("percent"))


def classification_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Per class: tp, fp, fn, support, precision, recall, F1. A ratio over nothing counts 0."""
    pairs = df.groupBy(named(true).alias("t"), named(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.col("t") == F.col("p")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("t").alias("class"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"),
                 F.when(hit, zero).otherwise(F.col("n")).alias("fn")),
        F.when(~hit, F.struct(F.col("p").alias("class"), zero.alias("tp"), F.col("n").alias("fp"), zero.alias("fn"))),
    )
    counts = (
        pairs.select(F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s"))
        .select("s.*")
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return counts.select(
        "class",
        "tp",
        "fp",
        "fn",
        (tp + fn).alias("support"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def macro_f1(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Accuracy, macro precision, recall and F1 in one row."""
    report = classification_report(df, true, predicted)
    return report.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def _threshold_counts(y: Column, probs: Column, threshold: float) -> tuple[Column, Column, Column]:
    above = F.size(F.filter(probs, lambda p: p > threshold))
    tp = F.when(at(probs, y) > threshold, 1).otherwise(0)
    return F.sum(tp), F.sum(above - tp), F.sum(1 - tp)


def threshold_metrics(df: DataFrame, true: str, probs: str, threshold: float = 0.5) -> DataFrame:
    """Counts over the one-hot matrix at a probability threshold, and their precision and recall."""
    rows = df.select(named(true).alias("_y"), named(probs).alias("_probs"))
    tp, fp, fn = _threshold_counts(F.col("_y"), F.col("_probs"), threshold)
    counts = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return counts.withColumn(
        "precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    ).withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0))


def topk_accuracy(df: DataFrame, true: str, probs: str, k: int = 3) -> DataFrame:
    return df.agg(F.avg(in_top_k(named(probs), named(true), k).cast("int")).alias(f"top{k}_accuracy"))


def joint_loss(
    df: DataFrame, true: str, probs: str, values: str, rebuilt: str, weight: float = RECONSTRUCTION_WEIGHT
) -> DataFrame:
    """Cross-entropy, reconstruction error and their weighted sum."""
    rows = df.select(cross_entropy(named(probs), named(true)).alias("_ce"), mean_squared_error(named(values), named(rebuilt)).alias("_se"))
    losses = rows.agg(F.avg("_ce").alias("cross_entropy"), F.avg("_se").alias("mse"))
    return losses.withColumn("joint_loss", F.col("cross_entropy") + weight * F.col("mse"))


def evaluation_summary(
    df: DataFrame, true: str, probs: str, values: str | None = None, rebuilt: str | None = None, threshold: float = 0.5
) -> DataFrame:
    """The whole evaluation record in one row.

    Row metrics come from one aggregate by class pair, so macro F1 needs no second scan.
    """
    nothing = F.lit(None).cast("double")
    error = mean_squared_error(named(values), named(rebuilt)) if values and rebuilt else nothing
    rows = df.select(named(true).alias("_y"), named(probs).alias("_probs"), error.alias("_error"))
    y, p, error = F.col("_y"), F.col("_probs"), F.col("_error")
    tp, fp, fn = _threshold_counts(y, p, threshold)
    pairs = rows.groupBy(y.alias("t"), argmax(p).alias("p")).agg(
        F.count("*").alias("n"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        F.sum(in_top_k(p, y, 3).cast("int")).alias("top3"),
        F.sum(cross_entropy(p, y)).alias("ce"),
        F.sum(error).alias("se"),
    )
    sums = ("n", "tp", "fp", "fn", "top3", "ce", "se")
    hit = F.col("t") == F.col("p")
    both = F.when(hit, F.col("n")).otherwise(0)
    # a class is met once as the true class, with all sums, and once as a wrong prediction
    as_true = F.struct(F.col("t").alias("class"), both.alias("hits"), F.col("n").alias("met"), *[F.col(c) for c in sums])
    as_wrong = F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("hits"), F.col("n").alias("met"),
                        *[F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in sums])
    sides = F.filter(F.array(as_true, F.when(~hit, as_wrong)), lambda side: side.isNotNull())
    # met = true rows + wrong predictions, so 2 tp + fp + fn = met + hits
    per_class = pairs.select(F.inline(sides)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hits", "met", *sums)])
    f1 = 2.0 * F.col("hits") / (F.col("met") + F.col("hits"))
    whole = per_class.agg(*[F.sum(c).alias(c) for c in ("hits", *sums)], F.avg(f1).alias("macro_f1"))
    ce, se = F.col("ce") / F.col("n"), F.col("se") / F.col("n")

    def share(part: Column, rest: Column) -> Column:
        return F.when(part + rest > 0, part / (part + rest)).otherwise(0.0)

    return whole.select(
        F.col("n").alias("n_rows"),
        (F.col("hits") / F.col("n")).alias("accuracy"),
        share(F.col("tp"), F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("fn")).alias("recall"),
        "macro_f1",
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        (F.col("top3") / F.col("n")).alias("top3_accuracy"),
        ce.alias("cross_entropy"),
        se.alias("mse"),
        (ce + RECONSTRUCTION_WEIGHT * F.coalesce(se, F.lit(0.0))).alias("loss"),
    )


def _scores_by_class(df: DataFrame, true: str, probs: str) -> DataFrame:
    """One row per class and distinct score: positives and negatives of the one-vs-rest task.

    A missing probability (NULL, NaN) and a row without a true class are left out, whatever path follows.
    """
    y = named(true)
    long = df.where(y.isNotNull()).select(y.alias("y"), F.posexplode(named(probs)).alias("class", "score"))
    hit = F.col("y") == F.col("class")
    known = F.col("score").isNotNull() & ~F.isnan("score")
    return long.where(known).groupBy("class", "score").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))


class _Steps(NamedTuple):
    running: DataFrame  # the steps with running positives and negatives
    totals: DataFrame  # positives and negatives by class
    axis: Column
    cuts: list[float]


def _running_scores(df: DataFrame, true: str, probs: str, rows_per_range: int) -> _Steps:
    """Running positives and negatives from the highest score down; ties are one step.

    The scored table is read once: totals, cuts and curve come from the written steps.
    """
    steps = written_table(_scores_by_class(df, true, probs), "roc-steps")
    axis = F.col("class") + 0.999 * F.col("score")  # classes one after the other
    n_steps = steps.count()
    cuts = cut_points(steps, axis, rows_per_range, n_steps) if n_steps > rows_per_range else []
    running = running_totals(steps, "class", [F.desc("score")], {"tp": "pos", "fp": "neg"}, cuts, axis, descending=True)
    totals = steps.groupBy("class").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return _Steps(running, totals, axis, cuts)


def roc_points(
    df: DataFrame, true: str, probs: str, rows_per_range: int = ROWS_PER_RANGE, prune: bool = False
) -> DataFrame:
    """One-vs-rest ROC points per class, equal scores grouped, from (0, 0) to (1, 1).

    ``prune`` leaves out points in the middle of two equal steps: they lie on the line between their
    neighbours, so the curve stays the same. The position of a class in ``probs`` is its index, so a class without true rows stays aligned; its
    true-positive rate is NULL.
    """
    steps, totals, axis, cuts = _running_scores(df, true, probs, rows_per_range)
    if prune:

        def with_next(table: DataFrame, window: WindowSpec) -> DataFrame:
            return table.withColumns({"next_pos": F.lead("pos").over(window), "next_neg": F.lead("neg").over(window)})

        steps = neighbour_windows(steps, ["class"], [F.desc("score")], axis, 0, 1, cuts, with_next)
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        turn = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        steps = steps.where(first | F.col("next_pos").isNull() | turn)
    start = totals.select("class", F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    points = steps.select("class", "score", "tp", "fp").unionByName(start).join(F.broadcast(totals), "class")
    return points.select(
        "class",
        F.col("score").alias("threshold"),
        F.when(F.col("n_neg") > 0, F.col("fp") / F.col("n_neg")).alias("fpr"),
        F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).alias("tpr"),
    )


def auc_ovr(df: DataFrame, true: str, probs: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Exact area under the ROC curve per class: trapezoids over the tie groups.

    A step with ``neg`` negatives adds ``neg * (positives above + half its own positives)``, which needs
    the running positives only.
    """
    steps = _running_scores(df, true, probs, rows_per_range).running
    sums = steps.groupBy("class").agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("area"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    whole = F.col("n_pos") * F.col("n_neg")
    return sums.select("class", "n_pos", F.when(whole > 0, F.col("area") / whole).alias("auc"))


def auc_summary(df: DataFrame, true: str, probs: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Macro and prevalence-weighted one-vs-rest AUC."""
    per_class = auc_ovr(df, true, probs, rows_per_range)
    return per_class.agg(
        F.avg("auc").alias("auc_macro"),
        (F.sum(F.col("n_pos") * F.col("auc")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("n_pos")))).alias("auc_weighted"),
    )


def binned_auc(df: DataFrame, true: str, probs: str, thresholds: int = AUC_THRESHOLDS) -> DataFrame:
    """Area under the ROC curve over equally spaced thresholds, per class.

    The training-time metric: thresholds ``i / (thresholds - 1)``, the outer two widened so that they
    pass all and none. Only ``classes x thresholds`` counts leave a task.
    """
    last = thresholds - 1
    y = named(true)
    long = df.select(y.alias("y"), F.posexplode(named(probs)).alias("class", "score"))
    # number of inner thresholds below the score; a score equal to a threshold does not exceed it
    passed = F.least(F.greatest(F.ceil(F.col("score") * last), F.lit(1)), F.lit(last)).cast("int")
    hit = F.col("y") == F.col("class")
    bins = long.groupBy("class", passed.alias("bin")).agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    down = Window.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # <= thresholds rows
    steps = bins.withColumn("tp", F.sum("pos").over(down))
    sums = steps.groupBy("class").agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    whole = F.col("p") * F.col("n")
    return sums.select("class", F.when(whole > 0, F.col("area") / whole).alias("binned_auc"))


def feature_histogram(df: DataFrame, feature: str, label: str, bins: int = 50) -> DataFrame:
    """Share and density of a feature per label, on equal-width bins over the common range.

    Missing and infinite values are left out.
    """
    value = finite_or_null(named(feature).cast("double"))
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        raise ValueError(f"column {feature} has no values")
    width = (high - low) / bins or 1.0
    number = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    counts = (
        df.where(value.isNotNull()).groupBy(named(label).alias("label"), number.alias("bin")).agg(F.count("*").alias("n"))
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("label"))
    return counts.select(
        "label", "bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), "n", share.alias("share"), (share / width).alias("density")
    )


def feature_density(
    df: DataFrame, feature: str, label: str, grid: int = 200, bins: int = 20_000, reach: float = 3.0
) -> DataFrame:
    """Gaussian kernel density per label on an even grid, bandwidth by Scott's rule.

    The grid spans the values of the label and ``reach`` bandwidths beyond. Values of a label are merged
    into bins no wider than 1/256 of its bandwidth, and than 1/``bins`` of its range, before the kernel is applied;
    each bin counts with its mean and variance. What is lost is of third order in the bin's share of the
    bandwidth, under 1e-8 of the kernel's height, whatever the range. Only occupied bins are rows, and each meets
    only the grid points within eight bandwidths.
    """
    value = finite_or_null(named(feature).cast("double"))
    rows = df.select(named(label).alias("label"), value.alias("x")).where("x is not null")
    facts = rows.groupBy("label").agg(
        F.count("*").alias("total"), F.min("x").alias("from"), F.max("x").alias("to"), F.stddev_samp("x").alias("spread")
    )
    facts = written_table(facts.withColumn("h", F.col("spread") * F.pow(F.col("total"), -0.2)), "density-labels")
    if facts.isEmpty():
        raise ValueError(f"column {feature} has no values")
    width = F.least((F.col("to") - F.col("from")) / bins, F.col("h") / BINS_PER_BANDWIDTH)
    usable = facts.where("total > 1 and h > 0").withColumn("width", width).withColumnRenamed("label", "_label")
    number = F.floor((F.col("x") - F.col("from")) / F.col("width"))
    merged = (
        rows.join(usable, F.col("label").eqNullSafe(F.col("_label")))
        .groupBy("label", number.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.var_pop("x").alias("inner"))
    )
    placed = merged.join(usable, F.col("label").eqNullSafe(F.col("_label")))
    start, end = F.col("from") - reach * F.col("h"), F.col("to") + reach * F.col("h")
    step = (end - start) / (grid - 1)
    # a kernel is under 1e-13 of its height beyond; a bin meets the grid points that it reaches
    far = FAR_BANDWIDTHS * F.col("h")
    first = F.greatest(F.ceil((F.col("x") - far - start) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("x") + far - start) / step), F.lit(grid - 1)).cast("int")
    near = placed.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    z = (start + F.col("point") * step - F.col("x")) / F.col("h")
    bend = 1 + (z * z - 1) * F.col("inner") / (2 * F.col("h") * F.col("h"))
    kernel = F.col("n") * F.exp(-0.5 * z * z) * bend / (F.col("total") * F.col("h") * F.sqrt(2 * F.pi()))
    heights = near.groupBy("label", "point").agg(F.sum(kernel).alias("density"))
    points = usable.select(F.col("_label").alias("label"), start.alias("start"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    points = points.select("label", "point", (F.col("start") + F.col("point") * F.col("step")).alias("position"))
    same = points["label"].eqNullSafe(heights["label"]) & (points["point"] == heights["point"])
    return points.join(heights, same, "left").select(points["label"], points["point"], "position", F.coalesce("density", F.lit(0.0)).alias("density"))


def attack_timeline(df: DataFrame, time: str, label: str, max_hours: int = MAX_HOURS) -> DataFrame:
    """Mean of a 0/1 label per hour; hours without rows are present with NULL.

    More than ``max_hours`` between the first and the last time are an error.
    """
    hour = F.date_trunc("hour", named(time).cast("timestamp"))
    value = named(label).cast("double")
    if is_floating(df.schema[label].dataType):
        value = F.when(~F.isnan(value), value)
    by_hour = df.where(named(time).isNotNull()).groupBy(hour.alias("hour")).agg(F.avg(value).alias("attack_ratio"), F.count("*").alias("n"))
    by_hour = written_table(by_hour, "hours")  # read twice: for the span and for the result
    first, last = by_hour.agg(F.min(F.unix_seconds("hour")), F.max(F.unix_seconds("hour"))).first()
    n_hours = 0 if first is None else (last - first) // 3600 + 1
    if n_hours > max_hours:
        raise ValueError(f"the timeline spans {n_hours} hours, more than {max_hours}; look for wrong times")
    hours = df.sparkSession.range(n_hours).select(F.timestamp_seconds(F.col("id") * 3600 + F.lit(first or 0)).alias("hour"))
    every = hours.select("hour", F.lit(None).cast("double").alias("attack_ratio"), F.lit(0).cast("bigint").alias("n"))
    return every.unionByName(by_hour).groupBy("hour").agg(F.max("attack_ratio").alias("attack_ratio"), F.max("n").alias("n"))
