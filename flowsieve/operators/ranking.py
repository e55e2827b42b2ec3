"""Feature ranking: ANOVA F, nearest-neighbour mutual information, forest importance, elimination."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark import keyword_only
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowsieve.functions.columns import digamma, finite_or_null, named, numeric_columns
from flowsieve.operators.bounds import MAX_CLASSES, bounded_rows, label_text
from flowsieve.operators.encode import LabelIndex
from flowsieve.operators.profile import require_columns
from flowsieve.operators.ranges import ROWS_PER_RANGE, cut_points, neighbour_windows, running_totals
from flowsieve.operators.stages import FlowEstimator, FlowModel, flag, number, state, strings, text
from flowsieve.session import shared_dir, written_table


NEIGHBOURS = 3
MAX_DEPTH = 30  # the most that Spark allows
#: Depth of the trees of elimination, a forest for every round: with nodes of 0.5 % of the rows few trees are deeper.
ELIMINATION_DEPTH = 10
#: Least share of the rows in a node: of the importance's trees, and of the many more that elimination grows.
MIN_SHARE, MIN_ELIMINATION_SHARE = 0.001, 0.005
FOREST_BINS = 32
#: Rows of a partition of the table that forests read: at least, while there are fewer than FOREST_PARTS, and at most.
FOREST_LEAST_ROWS, FOREST_ROWS = 8_000, 2_000_000
FOREST_PARTS = 16


def forest_parts(rows: int) -> int:
    """Partitions of a forest's table. Each sends the statistics of all open nodes, so they don't grow with the table before
    it is very large; and too few leave most cores without work."""
    return max(2, min(FOREST_PARTS, rows // FOREST_LEAST_ROWS), -(-rows // FOREST_ROWS))


def value_counts(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``f, c, v, n``: the rows of every feature, by its place, class and value, from one pass; NULL for a value that isn't finite.

    Written, as several steps read it. With equal values merged it grows with the distinct values, not with the rows.
    """
    require_columns(df, [*features, label])
    # adding 0.0 makes the two zeros one value
    values = [finite_or_null(named(name).cast("double")) + F.lit(0.0) for name in features]
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), v.alias("v")) for i, v in enumerate(values)]))
    rows = df.select(label_text(named(label)).alias("c"), cells)
    return written_table(rows.groupBy("f", "c", "v").agg(F.count("*").alias("n")), "points")


def _counted_moments(counts: DataFrame, features: list[str]) -> DataFrame:
    """``feature, n, mean, variance`` of every class, from ``value_counts``.

    Squares are summed around a first mean, or the value itself where there is only one, so large offsets do not cancel.
    """
    known = counts.where("v is not null")
    rough = F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(F.sum(F.col("n") * F.col("v")) / F.sum("n"))
    centres = known.groupBy("f", "c").agg(rough.alias("centre")).toDF("_f", "_c", "centre")  # one row per feature and class
    away, n = F.col("v") - F.col("centre"), F.sum("n")
    offset = F.sum(F.col("n") * away) / n
    return (
        known.join(F.broadcast(centres), (F.col("f") == F.col("_f")) & F.col("c").eqNullSafe(F.col("_c")))
        .groupBy("f", "c", "centre")
        .agg(n.alias("n"), offset.alias("offset"), (F.sum(F.col("n") * away * away) / n - offset * offset).alias("variance"))
        .select(F.get(F.lit(features), F.col("f")).alias("feature"), "n", (F.col("centre") + F.col("offset")).alias("mean"), F.greatest("variance", F.lit(0.0)).alias("variance"))
    )


def _class_moments(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``feature, n, mean, variance`` of every class."""
    per_class = df.groupBy(label_text(named(label)).alias("class")).agg(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.count(named(name)).alias("n"),
                F.avg(named(name).cast("double")).alias("mean"),
                F.var_pop(named(name).cast("double")).alias("variance"),
            ).alias(f"f{i}")
            for i, name in enumerate(features)
        ]
    )
    return per_class.select(F.inline(F.array(*[f"f{i}" for i in range(len(features))]))).where("n > 0")


def anova_f(df: DataFrame, features: list[str], label: str, counts: DataFrame | None = None) -> DataFrame:
    """One-way F statistic per feature, from one aggregate by class.

    Class variances come from the engine's merging moments, so large offsets do not cancel. A constant
    feature has no F; a feature constant within every class has an infinite one. ``counts`` may give the
    ``value_counts`` of the table, which then isn't read; they leave out values that aren't finite.
    """
    require_columns(df, [*features, label])
    long = _class_moments(df, features, label) if counts is None else _counted_moments(counts, features)
    feature = Window.partitionBy("feature")  # one row per class and feature
    grand_mean = F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature)
    sums = (
        long.withColumn("away", F.col("mean") - grand_mean)
        .groupBy("feature")
        .agg(
            F.sum("n").alias("n"),
            F.count("*").alias("k"),
            F.sum(F.col("n") * F.col("away") * F.col("away")).alias("between"),
            F.sum(F.col("n") * F.col("variance")).alias("within"),
        )
    )
    score = F.when(
        (F.col("within") > 0) & (F.col("k") > 1) & (F.col("n") > F.col("k")),
        (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))),
    ).when((F.col("within") == 0) & (F.col("between") > 0), F.lit(float("inf")))
    return sums.select("feature", score.alias("f_score"))


def _digamma_of(n: int) -> float:
    x, shift = float(n), 0.0
    while x < 10:
        shift += 1 / x
        x += 1
    return log(x) - 0.5 / x - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8) - shift


def mutual_info(
    df: DataFrame,
    features: list[str],
    label: str,
    neighbours: int = NEIGHBOURS,
    rows_per_range: int = ROWS_PER_RANGE,
    max_classes: int = MAX_CLASSES,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Mutual information of continuous features with a class, by nearest neighbours in one dimension.

    For a row of class ``c`` the radius is the distance to its ``neighbours``-th nearest row of the
    same class; with ``k`` rows of the class and ``m`` rows of any class closer than that, itself
    included, the estimate is ``psi(n) - mean psi(n_c) + mean(psi(k) - psi(m))``, never below 0. Where
    the radius is zero (counters, flags) ``k`` and ``m`` count the rows with the same value instead.
    Classes with one row are left out.

    Equal values are merged before the first shuffle, so a column with few distinct values costs next
    to nothing and no hot value reaches a task more than once. Beyond ``rows_per_range`` rows, sorting is
    spread over value ranges. All else is computed from the merged values; ``counts`` may give them if they
    are there (``value_counts``).
    """
    require_columns(df, [*features, label])
    points = value_counts(df, features, label) if counts is None else counts  # the table is read once, for these
    by_feature = points.groupBy("c", "f").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("gaps"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    cells = F.sort_array(F.collect_list(F.struct("f", "n", "gaps", "low", "high"))).alias("cells")
    facts = bounded_rows(by_feature.groupBy("c").agg(cells), max_classes, f"classes of {label}")
    gaps = [name for i, name in enumerate(features) if any(row["cells"][i].gaps for row in facts)]
    if gaps or any(row["c"] is None for row in facts):
        raise ValueError(f"mutual information needs complete rows; missing values in {gaps or [label]}")
    sizes = {row["c"]: row["cells"][0].n for row in facts if row["cells"][0].n > 1}
    if not sizes:
        raise ValueError(f"no class of {label} has two rows")
    total = sum(sizes.values())
    lows = [min(row["cells"][i].low for row in facts) for i in range(len(features))]
    highs = [max(row["cells"][i].high for row in facts) for i in range(len(features))]
    if len(sizes) < len(facts):
        points = points.where(~F.col("c").isin([row["c"] for row in facts if row["c"] not in sizes]))

    def axis(value: Column) -> Column:
        """All features on one line: the feature number plus the value's place within its range."""
        low, high = (F.get(F.array(*map(F.lit, ends)), F.col("f")) for ends in (lows, highs))
        width = high / 2 - low / 2
        place = F.when(width > 0, (value / 2 - low / 2) / width).otherwise(F.lit(0.0))
        return F.col("f") + 0.999 * F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))

    n_points = points.count()
    cuts = cut_points(points, axis(F.col("v")), rows_per_range, n_points) if n_points > rows_per_range else []

    # the nearest `neighbours` rows never need more than this many copies of one value
    copies = points.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(neighbours + 1)).cast("int"))))
    steps = range(1, neighbours + 1)

    def with_neighbours(table: DataFrame, window: WindowSpec) -> DataFrame:
        lags = {f"below{j}": F.lag("v", j).over(window) for j in steps}
        return table.withColumns(lags | {f"above{j}": F.lead("v", j).over(window) for j in steps})

    near = neighbour_windows(
        copies, ["f", "c"], [F.col("v"), F.col("copy")], axis(F.col("v")), neighbours, neighbours, cuts, with_neighbours
    ).where("copy = 1")

    v, far = F.col("v"), F.lit(float("inf"))
    left = [F.lit(0.0)] + [F.coalesce(v - F.col(f"below{j}"), far) for j in steps]
    right = [F.lit(0.0)] + [F.coalesce(F.col(f"above{j}") - v, far) for j in steps]

    def kth_distance(k: int) -> Column:
        around = [F.greatest(left[j], right[k - j]) for j in range(k + 1)]
        return F.least(*around) if len(around) > 1 else around[0]

    radius = kth_distance(neighbours)
    for k in range(1, neighbours):  # classes too small for the full neighbourhood
        small = [c for c, n in sizes.items() if n - 1 == k]
        if small:
            radius = F.when(F.col("c").isin(small), kth_distance(k)).otherwise(radius)
    near = near.withColumn("r", radius)
    r = F.col("r")
    # a bound that is a neighbour keeps that neighbour's own value; v - r would round
    low = F.coalesce(*[F.when(left[j] == r, F.col(f"below{j}")) for j in steps], v - r)
    high = F.coalesce(*[F.when(right[j] == r, F.col(f"above{j}")) for j in steps], v + r)
    closer = reduce(
        lambda a, b: a + b,
        [F.when(side[j] < r, 1).otherwise(0) for side in (left, right) for j in steps],
        F.lit(1),
    )
    tied = r == 0
    balls = near.select(
        "f",
        "c",
        "v",
        "n",
        F.when(tied, F.col("n")).otherwise(closer.cast("bigint")).alias("k"),
        F.when(tied, v).otherwise(low).alias("low"),
        F.when(tied, v).otherwise(high).alias("high"),
        tied.alias("tied"),
    )

    # rows closer than the radius: running count at the upper bound minus running count at the lower;
    # at equal value an open upper bound sorts before the points and an open lower bound after them
    nothing = F.lit(0).cast("bigint")
    marks = F.array(
        F.struct(F.col("v").alias("x"), F.lit(1).alias("place"), F.col("n").alias("rows"), F.lit(0).alias("sign")),
        F.struct(F.col("high").alias("x"), F.when(F.col("tied"), 2).otherwise(0).alias("place"), nothing.alias("rows"), F.lit(1).alias("sign")),
        F.struct(F.col("low").alias("x"), F.when(F.col("tied"), 0).otherwise(2).alias("place"), nothing.alias("rows"), F.lit(-1).alias("sign")),
    )
    swept = running_totals(
        balls.select("f", "c", "v", "n", "k", F.inline(marks)),
        "f",
        [F.col("x"), F.col("place")],
        {"upto": "rows"},
        cuts,
        axis(F.col("x")),
        counted=points.select("f", F.col("v").alias("x"), F.col("n").alias("rows")),
    )
    counted = (
        swept.where("sign <> 0")
        .groupBy("f", "c", "v")
        .agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sum(F.col("sign") * F.col("upto")).alias("m"))
    )
    fixed = _digamma_of(total) - sum(n * _digamma_of(n) for n in sizes.values()) / total
    sums = counted.groupBy("f").agg(F.sum(F.col("n") * (digamma(F.col("k")) - digamma(F.col("m")))).alias("s"))
    score = F.greatest(F.lit(0.0), F.lit(fixed) + F.col("s") / total)
    return sums.select(F.get(F.lit(features), F.col("f")).alias("feature"), score.alias("mi_score"))


def _cuts(df: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Lower ends of the bins after the first: every value of columns with few, quantiles of the others."""
    at = [k / bins for k in range(1, bins)]
    facts = df.agg(
        *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.percentile_approx(c, at, 10_000).alias(f"q{i}") for i, c in enumerate(names)],
    ).first()
    cuts = [sorted(set(facts[f"q{i}"] or [])) for i in range(len(names))]
    for i, name in enumerate(names):
        if facts[f"n{i}"] <= 2 * bins:  # the estimate is off by 5 %; the count decides
            values = df.select(name).distinct().limit(bins + 1).collect()
            if len(values) <= bins:
                cuts[i] = sorted(r[0] for r in values if r[0] is not None)[1:]
    return cuts


def binned_table(df: DataFrame, features: list[str], label_index: str, bins: int = FOREST_BINS) -> tuple[DataFrame, int]:
    """The class ``_y`` and a vector ``_x`` of the features' bin numbers, written once for all forests, and the rows.

    A tree sees the order of values only, so trees over the numbers are trees over the values. The table has as many
    partitions as its rows ask for, whatever the cluster: each holds the statistics of all open nodes. Missing
    values raise.
    """
    require_columns(df, [*features, label_index])
    short = [f"x{i}" for i in range(len(features))]
    # adding 0.0 makes the two zeros one value
    plain = df.select(named(label_index).cast("double").alias("_y"), *[(named(c).cast("double") + F.lit(0.0)).alias(s) for c, s in zip(features, short)])
    plain = written_table(plain, "forest")
    cuts = _cuts(plain, short, bins)
    missing = plain.agg(F.count("*").alias("rows"), F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in short])).alias("gaps")).first()
    if missing["gaps"]:
        raise ValueError(f"forests need complete rows; {missing['gaps']} rows have missing values")
    codes = [f"b{i}" for i in range(len(short))]
    edges = [[float("-inf"), *(c or [0.0]), float("inf")] for c in cuts]  # a constant column needs a cut as well
    buckets = Bucketizer(splitsArray=edges, inputCols=short, outputCols=codes)
    numbers = VectorAssembler(inputCols=codes, outputCol="_x").transform(buckets.transform(plain)).select("_y", "_x")
    return written_table(numbers, "bins", forest_parts(missing["rows"])), missing["rows"]


def _importances(table: DataFrame, rows: int, chosen: list[int] | None, trees: int, seed: int, max_depth: int, min_share: float, **forest) -> list[float]:
    """Importances of the chosen places of ``_x``. Node ids are kept from level to level and checkpointed now and then."""
    context = table.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(table.sparkSession))
    if chosen is not None:
        table = VectorSlicer(inputCol="_x", outputCol="_s", indices=chosen).transform(table).select("_y", F.col("_s").alias("_x"))
    model = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed, maxDepth=max_depth, minInstancesPerNode=max(1, int(rows * min_share)),
        **{"maxBins": FOREST_BINS, "maxMemoryInMB": 1024, "cacheNodeIds": True, **forest},
    )
    return model.fit(table).featureImportances.toArray().tolist()


def rf_importance(
    df: DataFrame, features: list[str], label_index: str, trees: int = 200, seed: int = 42, max_depth: int = MAX_DEPTH,
    min_share: float = MIN_SHARE, **forest,
) -> DataFrame:
    """Random-forest importance per feature.

    Trees grow to Spark's limit of depth unless ``max_depth`` is less, down to nodes of ``min_share`` of the rows, so that
    their size has a bound that doesn't grow with the table. ``forest`` goes to the forest.
    """
    table, rows = binned_table(df, features, label_index)
    found = _importances(table, rows, None, trees, seed, max_depth, min_share, **forest)
    return df.sparkSession.createDataFrame(list(zip(features, found)), "feature string, rf_importance double")


def rfe_rank(
    df: DataFrame, features: list[str], label_index: str, keep: int, trees: int = 100, step: int = 1, seed: int = 42,
    max_depth: int = ELIMINATION_DEPTH, min_share: float = MIN_ELIMINATION_SHARE, **forest,
) -> DataFrame:
    """Recursive elimination: the ``step`` least important features go each round, over one table of bins.

    Features that stay have rank 1, those removed last rank 2, and so on. Trees end at ``max_depth`` and at nodes of
    ``min_share`` of the rows; both can be opened at the cost of a longer run.
    """
    if step < 1 or keep < 1:
        raise ValueError("keep and step must be at least 1")
    table, rows = binned_table(df, features, label_index)
    left, removed = list(range(len(features))), []
    while len(left) > keep:
        scores = _importances(table, rows, left, trees, seed, max_depth, min_share, **forest)
        weakest = sorted(zip(scores, [features[k] for k in left], left))[: min(step, len(left) - keep)]
        removed.append([k for *_, k in weakest])
        left = [k for k in left if k not in removed[-1]]
    ranks = [(features[k], 1) for k in left]
    ranks += [(features[k], 2 + age) for age, batch in enumerate(reversed(removed)) for k in batch]
    return df.sparkSession.createDataFrame(ranks, "feature string, rfe_rank int")


def consensus(scores: DataFrame, inverted: tuple[str, ...] = ("rfe_rank",)) -> DataFrame:
    """Min-max of every score column and their row mean, highest first, ties by name.

    ``scores`` has one row per feature. A constant score counts 0 for all; columns in ``inverted`` are
    better when smaller. Missing scores are left out of the mean.
    """
    names = [c for c in scores.columns if c != "feature"]
    if not names:
        raise ValueError("at least one score is needed")
    everything = Window.partitionBy(F.lit(1))  # the table has one row per feature
    normed = {}
    for name in names:
        value = finite_or_null(named(name).cast("double"))
        low, width = F.min(value).over(everything), F.max(value).over(everything) - F.min(value).over(everything)
        norm = F.when(width == 0, F.when(value.isNotNull(), 0.0)).otherwise((value - low) / width)
        normed[f"{name}_norm"] = 1.0 - norm if name in inverted else norm
    present = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in normed]
    filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in normed]
    n_present = reduce(lambda a, b: a + b, present)
    mean = F.when(n_present > 0, reduce(lambda a, b: a + b, filled) / n_present)
    return scores.withColumns(normed).withColumn("consensus", mean).orderBy(F.desc_nulls_last("consensus"), "feature")


def select_top(ranking: DataFrame, k: int) -> list[str]:
    rows = ranking.orderBy(F.desc_nulls_last("consensus"), "feature").limit(k).select("feature").collect()
    return [row["feature"] for row in rows]


class FeatureSelector(FlowEstimator):
    """Keeps the ``k`` features with the highest consensus of the chosen scores, in rank order."""

    k = number("k", "features to keep")
    labelCol = text("labelCol", "class column")
    keepCols = strings("keepCols", "label and key columns that are no features but stay on the row")
    useAnova = flag("useAnova", "rank by one-way F")
    useMi = flag("useMi", "rank by mutual information")
    useRf = flag("useRf", "rank by forest importance")
    useRfe = flag("useRfe", "rank by recursive elimination")
    seed = number("seed", "seed of the forests")
    rfTrees = number("rfTrees", "trees for the importance")
    rfeTrees = number("rfeTrees", "trees per elimination round")
    rfeStep = number("rfeStep", "features removed per round")

    @keyword_only
    def __init__(self, *, k=20, labelCol="label", keepCols=None, useAnova=False, useMi=True, useRf=False, useRfe=False,
                 seed=42, rfTrees=200, rfeTrees=100, rfeStep=1):
        super().__init__()
        self._setDefault(k=20, labelCol="label", keepCols=[], useAnova=False, useMi=True, useRf=False, useRfe=False,
                         seed=42, rfTrees=200, rfeTrees=100, rfeStep=1)
        self._set(**self._input_kwargs)

    def scores(self, df: DataFrame) -> DataFrame:
        """One row per feature with the chosen scores."""
        read, label = self._read, self._read("labelCol")
        features = numeric_columns(df, [*read("keepCols"), label])
        tables = []
        both = read("useAnova") and read("useMi")
        counts = value_counts(df, features, label) if both else None
        if read("useAnova"):
            tables.append(anova_f(df, features, label, counts))
        if read("useMi"):
            tables.append(mutual_info(df, features, label, counts=counts))
        if read("useRf") or read("useRfe"):
            indexed = LabelIndex(labelCol=label, outputCol="_label_index").fit(df).transform(df)
            if read("useRf"):
                tables.append(rf_importance(indexed, features, "_label_index", read("rfTrees"), read("seed")))
            if read("useRfe"):
                tables.append(
                    rfe_rank(indexed, features, "_label_index", min(read("k"), len(features)),
                             read("rfeTrees"), read("rfeStep"), read("seed"))
                )
        if not tables:
            raise ValueError("choose at least one of useAnova, useMi, useRf, useRfe")
        return reduce(lambda a, b: a.join(b, "feature", "full_outer"), tables)

    def _fit(self, df: DataFrame) -> "FeatureSelectorModel":
        ranking = consensus(self.scores(df))
        table = [row.asDict() for row in ranking.collect()]  # one row per feature
        selected = [row["feature"] for row in table[: self._read("k")]]
        keep = [*self._read("keepCols"), self._read("labelCol")]
        return FeatureSelectorModel(keepCols=list(dict.fromkeys(keep)), selected=selected, ranking=table)


class FeatureSelectorModel(FlowModel):
    keepCols = strings("keepCols", "label and key columns that stay on the row")
    selected = strings("selected", "features kept, best first")
    ranking = state("ranking", "scores by feature, best first")

    @keyword_only
    def __init__(self, *, keepCols=None, selected=None, ranking=None):
        super().__init__()
        self._setDefault(keepCols=[], selected=[], ranking=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self._read("selected"):
            raise ValueError("the selector has not been fitted")
        kept = [c for c in self._read("keepCols") if c in df.columns]
        return df.select(*map(named, kept), *map(named, self._read("selected")))
