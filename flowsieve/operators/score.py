"""Model input, training, scoring and alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowsieve.functions.columns import is_missing, named
from flowsieve.functions.vectors import argmax, squared_sum
from flowsieve.operators.bounds import bounded_rows, small_table
from flowsieve.operators.evaluate import macro_f1
from flowsieve.operators.ranges import ROWS_PER_RANGE, neighbour_windows, nested_ranges, sortable_number
from flowsieve.operators.stages import FlowTransformer, flag, number, strings, text
from flowsieve.session import written_table

THRESHOLD = 0.9
MAX_HOT = 1_000_000


def assemble_vector(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """Packs the feature columns into one vector; a missing value fails the job. Vectors among them stay sparse.

    Flow corpora use names that a vector assembler cannot address, hence short names in between.
    """
    short = {
        f"_v{i}": named(c) if isinstance(df.schema[c].dataType, VectorUDT) else named(c).cast("double") for i, c in enumerate(features)
    }
    packed = VectorAssembler(inputCols=list(short), outputCol=output, handleInvalid="error")
    return packed.transform(df.withColumns(short)).drop(*short)


class PackFeatures(FlowTransformer):
    """``assemble_vector`` as a stage. ``dense`` takes numbers only and less time: its vectors aren't searched for zeros."""

    inputCols = strings("inputCols", "feature columns in order")
    outputCol = text("outputCol", "vector column")
    dense = flag("dense", "vectors hold every value, zeros too")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", dense=False):
        super().__init__()
        self._setDefault(inputCols=[], outputCol="features", dense=False)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self._read("dense"):
            return assemble_vector(df, self._read("inputCols"), self._read("outputCol"))
        packed = df.withColumn("_values", F.array(*[named(c).cast("double") for c in self._read("inputCols")]))
        whole = ~F.array_contains("_values", float("nan"))  # NULL if a value is
        values = F.when(whole, F.col("_values")).otherwise(F.raise_error(F.lit("missing value in a feature")).cast("array<double>"))
        return packed.withColumn(self._read("outputCol"), array_to_vector(values)).drop("_values")

    def row_error(self, df: DataFrame) -> Column:
        """Why a row can't be packed, or NULL."""
        gaps = [F.when(is_missing(df, c), F.lit(f"missing value in {c}")) for c in self._read("inputCols")]
        return F.coalesce(F.lit(None).cast("string"), *gaps)


class PackSequence(FlowTransformer):
    """A window of ``sequence_windows`` as one vector, oldest row first, for classifiers.

    Windows of another shape than ``windowSize`` rows of ``width`` values, and missing values in them, fail the job;
    ``row_error`` tells them apart before.
    """

    inputCol = text("inputCol", "window column")
    outputCol = text("outputCol", "vector column")
    windowSize = number("windowSize", "rows of a window")
    width = number("width", "values of a row")

    @keyword_only
    def __init__(self, *, inputCol="sequence", outputCol="features", windowSize=1, width=1):
        super().__init__()
        self._setDefault(inputCol="sequence", outputCol="features", windowSize=1, width=1)
        self._set(**self._input_kwargs)

    def _flat(self) -> Column:
        return F.flatten(named(self._read("inputCol")))

    def row_error(self, df: DataFrame) -> Column:
        shape = self._read("windowSize") * self._read("width")
        whole = F.coalesce(F.size(self._flat()) == shape, F.lit(False))
        return F.when(~whole, F.lit("window of another shape")).when(
            F.exists(self._flat(), lambda x: x.isNull() | F.isnan(x)), F.lit("missing value in a window")
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        problem = self.row_error(df)
        values = F.when(problem.isNull(), self._flat()).otherwise(F.raise_error(problem).cast("array<double>"))
        return df.withColumn(self._read("outputCol"), array_to_vector(values))


class AttackScore(FlowTransformer):
    """Adds ``probs``, the predicted class name and ``score``, the probability of not being benign.

    ``probs`` leaves a generator of one row, which no filter is pushed through. A condition on the score would else be asked
    on the plain columns, with every step of the model written out in it anew for each use, and the classifier ask a hit twice.
    """

    classes = strings("classes", "class names by index")
    benign = text("benign", "name of the benign class")

    @keyword_only
    def __init__(self, *, classes=None, benign="BENIGN"):
        super().__init__()
        self._setDefault(classes=[], benign="BENIGN")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, benign = self._read("classes"), self._read("benign")
        if benign not in classes:
            raise ValueError(f"benign class {benign!r} is not among {classes}: every row would count as an attack")
        probs = vector_to_array(F.col("probability"))
        harmless = F.get(F.col("probs"), F.lit(classes.index(benign)))
        scored = df.withColumn("probs", F.explode(F.array(probs))).withColumns(
            {"predicted_class": F.get(F.lit(classes), argmax(F.col("probs"))), "score": 1.0 - harmless}
        )
        return scored.drop("rawPrediction", "probability", "prediction")


def sequence_windows(
    df: DataFrame,
    features: list[str],
    entity: str,
    time: str,
    key: str,
    window_size: int,
    pad: bool = False,
    output: str = "sequence",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The last ``window_size`` rows of an entity, oldest first, as ``array<array<double>>``.

    Rows with a shorter history are dropped, or padded with zero rows in front. Entities with more than
    ``rows_per_range`` rows are sorted by time range (by key range inside a crowded moment), so that no
    entity is one task; all others take the plain window. Time and key must not be missing.
    """
    if window_size < 1:
        raise ValueError("window_size must be at least 1")
    values = F.array(*[named(c).cast("double") for c in features])
    rows = df.withColumn("_values", values)
    if window_size == 1:
        return rows.withColumn(output, F.array("_values")).drop("_values")
    order = [named(time), named(key)]

    def windows(part: DataFrame, window: WindowSpec) -> DataFrame:
        return part.withColumn(output, F.collect_list("_values").over(window.rowsBetween(1 - window_size, 0)))

    sizes = df.groupBy(named(entity).alias("_entity")).agg(F.count("*").alias("n"))
    hot_rows = bounded_rows(sizes.where(F.col("n") > rows_per_range), MAX_HOT, "hot entities; raise rows_per_range")
    whole = Window.partitionBy(named(entity)).orderBy(*order)
    if not hot_rows:
        result = windows(rows, whole)
    else:
        kind = df.schema[entity].dataType.simpleString()
        hot = small_table(df.sparkSession, [(row["_entity"],) for row in hot_rows], f"_entity {kind}")
        same = named(entity).eqNullSafe(F.col("_entity"))
        cold = windows(rows.join(hot, same, "left_anti"), whole)
        busy = rows.join(hot, same, "left_semi")
        axis, tie_axis = (sortable_number(df, c, busy) for c in (time, key))
        ranges = nested_ranges(busy, axis, tie_axis, rows_per_range, sum(row["n"] for row in hot_rows))
        cut = neighbour_windows(busy, [entity], order, axis, window_size - 1, 0, ranges, windows, tie_axis)
        result = cold.unionByName(cut)
    if not pad:
        return result.where(F.size(output) == window_size).drop("_values")
    empty = F.array_repeat(F.lit([0.0] * len(features)), window_size - F.size(output))
    return result.withColumn(output, F.concat(empty, F.col(output))).drop("_values")


CLASSIFIERS = {
    "forest": RandomForestClassifier,
    "logistic": LogisticRegression,
    "perceptron": MultilayerPerceptronClassifier,
    "bayes": NaiveBayes,
}


def train_classifier(
    df: DataFrame, label_index: str, kind: str = "forest", features: str = "features", weight: str | None = None, **params
) -> Model:
    """Fits a distributed multi-class classifier; the perceptron has no row weights."""
    if kind not in CLASSIFIERS:
        raise ValueError(f"unknown classifier: {kind}; known: {', '.join(CLASSIFIERS)}")
    if weight is not None:
        if kind == "perceptron":
            raise ValueError("the perceptron takes no row weights")
        params["weightCol"] = weight
    return CLASSIFIERS[kind](featuresCol=features, labelCol=label_index, **params).fit(df)


def predict(df: DataFrame, model: Model | PipelineModel, probability: str = "probability") -> DataFrame:
    """Adds ``probs`` (array) and ``predicted`` (index of the largest probability)."""
    scored = model.transform(df)
    return scored.withColumn("probs", vector_to_array(named(probability))).withColumn("predicted", argmax(F.col("probs")))


def predict_batches(
    df: DataFrame, features: list[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]], output: str = "probs"
) -> DataFrame:
    """Class probabilities from a model that Spark does not know, as ``array<double>``.

    ``load`` runs once per task and gives a function from a feature matrix to a probability matrix. Only
    the features travel to Python, in Arrow batches; the partitions stay as they are.
    """

    @F.pandas_udf("array<double>")
    def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.to_numpy(dtype="float64")), dtype="float64")))

    packed = F.struct(*[named(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    return df.withColumn(output, score_batches(packed))


class MacroF1(Evaluator):
    """Unweighted mean of the per-class F1 scores, larger is better."""

    def __init__(self, label: str = "label", predicted: str = "prediction"):
        super().__init__()
        self._label, self._predicted = label, predicted

    def _evaluate(self, dataset: DataFrame) -> float:
        return macro_f1(dataset, self._label, self._predicted).first()["macro_f1"]

    def isLargerBetter(self) -> bool:
        return True


def choose_model(
    candidates: dict[str, tuple[str, dict]], train: DataFrame, validation: DataFrame, label_index: str, features: str = "features"
) -> tuple[Model, DataFrame]:
    """Trains every ``name: (kind, params)`` and keeps the one with the best validation macro F1.

    Returns the model and the table ``(candidate, macro_f1, chosen)``.
    """
    evaluator = MacroF1(label_index, "prediction")
    train, validation = written_table(train, "candidates-train"), written_table(validation, "candidates-validation")
    models = {name: train_classifier(train, label_index, kind, features, **params) for name, (kind, params) in candidates.items()}
    scores = {name: evaluator.evaluate(model.transform(validation)) for name, model in models.items()}
    best = max(sorted(scores), key=scores.get)
    table = train.sparkSession.createDataFrame(
        [(name, score, name == best) for name, score in scores.items()], "candidate string, macro_f1 double, chosen boolean"
    )
    return models[best], table


def digest_fold(key: Column, folds: int) -> Column:
    """Fold of a row by the first 32 bits of its key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % folds


def macro_f1_by(df: DataFrame, by: str, label: str, predicted: str) -> DataFrame:
    """``by, macro_f1``: the unweighted mean over the classes that occur or are predicted, from one pass over the rows."""
    counts = df.groupBy(named(by).alias("by"), named(label).cast("double").alias("y"), named(predicted).cast("double").alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("named"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("named"), F.lit(0).cast("bigint").alias("hits")),
    )
    by_class = counts.select("by", F.inline(sides)).groupBy("by", "class").agg(*[F.sum(c).alias(c) for c in ("actual", "named", "hits")])
    f1 = 2.0 * F.col("hits") / (F.col("actual") + F.col("named"))
    return by_class.groupBy("by").agg(F.avg(f1).alias("macro_f1")).withColumnRenamed("by", by)


def choose_over_folds(
    candidates: dict[str, tuple[str, dict]], df: DataFrame, label_index: str, key: str, folds: int = 3, features: str = "features"
) -> tuple[Model, DataFrame]:
    """Cross-validates every ``name: (kind, params)`` and refits the best on all rows.

    A row's fold comes from its key, so the choice doesn't depend on order or partitions. The rows are written once;
    what all candidates say about the rows they haven't seen is one table, scored by one aggregate. Returns the model
    and ``candidate, macro_f1, chosen``; equal scores go to the first name.
    """
    if folds < 2 or not candidates:
        raise ValueError("at least one candidate and two folds are needed")
    rows = df.select(named(label_index).alias("_y"), named(features).alias("_x"), digest_fold(named(key), folds).alias("_fold"))
    rows = written_table(rows, "folds")
    said = []
    for name, (kind, params) in candidates.items():
        for fold in range(folds):
            model = train_classifier(rows.where(F.col("_fold") != fold), "_y", kind, "_x", **params)
            unseen = model.transform(rows.where(F.col("_fold") == fold))
            said.append(unseen.select(F.lit(name).alias("candidate"), "_y", F.col("prediction").alias("_p")))
    scored = macro_f1_by(reduce(DataFrame.unionByName, said), "candidate", "_y", "_p")
    found = {row["candidate"]: row["macro_f1"] for row in scored.collect()}  # one row a candidate
    best = max(sorted(found), key=found.get)
    table = df.sparkSession.createDataFrame([(n, f, n == best) for n, f in found.items()], "candidate string, macro_f1 double, chosen boolean")
    kind, params = candidates[best]
    return train_classifier(df, label_index, kind, features, **params), table


def fit_reconstruction(df: DataFrame, features: str = "features", components: int = 32) -> PipelineModel:
    """Centring and principal components: the linear counterpart of an autoencoder bottleneck.

    No more components than the vectors have entries.
    """
    first = df.select(F.size(vector_to_array(named(features)))).first()
    if first is None:
        raise ValueError("no row to fit on")
    components = min(components, first[0])
    centre = StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False)
    pca = PCA(k=components, inputCol="_centred", outputCol="_reduced")
    return Pipeline(stages=[centre, pca]).fit(df)


def reconstruction_score(df: DataFrame, model: PipelineModel, output: str = "reconstruction_error") -> DataFrame:
    """Mean squared error between a row and its rebuilt form.

    The components are orthonormal, so the squared error is the squared length that the projection
    loses; the rebuilt vector itself is never formed.
    """
    return _with_error(model.transform(df), output)


def _with_error(projected: DataFrame, output: str) -> DataFrame:
    whole, reduced = vector_to_array(F.col("_centred")), vector_to_array(F.col("_reduced"))
    lost = (squared_sum(whole) - squared_sum(reduced)) / F.size(whole)
    return projected.withColumn(output, F.greatest(lost, F.lit(0.0))).drop("_centred", "_reduced")


class ReconstructionError(FlowTransformer):
    """``reconstruction_score`` as the stage after centring and projection, so that both live in a saved model."""

    outputCol = text("outputCol", "error column")

    @keyword_only
    def __init__(self, *, outputCol="reconstruction_error"):
        super().__init__()
        self._setDefault(outputCol="reconstruction_error")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return _with_error(df, self._read("outputCol"))


def rebuilt_rows(df: DataFrame, model: PipelineModel, values: str = "values", rebuilt: str = "rebuilt") -> DataFrame:
    """The input vector and its rebuilt form as arrays, for the losses that compare them."""
    centre, pca = model.stages
    matrix, mean = pca.pc.toArray(), centre.mean.toArray()  # entries x components: as small as the model
    projected = pca.transform(centre.transform(df))
    reduced = vector_to_array(F.col("_reduced"))
    rows = F.array(*[F.array(*map(F.lit, [float(m), *map(float, row)])) for m, row in zip(mean, matrix)])

    def entry(row: Column) -> Column:
        terms = F.zip_with(F.slice(row, 2, matrix.shape[1]), reduced, lambda a, b: a * b)
        return F.aggregate(terms, row[0], lambda total, x: total + x)

    whole = vector_to_array(F.col(centre.getInputCol()))
    return projected.withColumns({values: whole, rebuilt: F.transform(rows, entry)}).drop("_centred", "_reduced")


class JointModel(NamedTuple):
    """A classifier and a reconstruction over the same vectors."""

    classifier: Model
    reconstruction: PipelineModel


def fit_joint(
    df: DataFrame, label_index: str, kind: str = "forest", features: str = "features", components: int = 32, **params
) -> JointModel:
    """Class head and reconstruction head fitted on the same rows."""
    return JointModel(train_classifier(df, label_index, kind, features, **params), fit_reconstruction(df, features, components))


def joint_rows(df: DataFrame, model: JointModel) -> DataFrame:
    """Adds what the joint loss and the evaluation record compare: ``probs``, ``predicted``, ``values``, ``rebuilt``."""
    return predict(rebuilt_rows(df, model.reconstruction), model.classifier)


def array_vector(df: DataFrame, array: str, output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(named(array).cast("array<double>")))


def alerts(
    scored: DataFrame, score: str = "score", source: str = "src_ip", destination: str = "dst_ip",
    time: str = "timestamp", threshold: float = THRESHOLD, context: list[str] | None = None,
) -> DataFrame:
    """Alert records for rows above the threshold; works on batch and streaming tables alike."""
    message = F.format_string(
        "ALERT: Malicious traffic detected from %s to %s (score: %.2f)",
        named(source).cast("string"),
        named(destination).cast("string"),
        named(score).cast("double"),
    )
    hits = scored.where(named(score) > threshold)
    return log_records(hits, "WARNING", message, time, [score, source, destination, *(context or [])])


def log_records(df: DataFrame, level: str, message: Column, time: str, context: list[str]) -> DataFrame:
    """Structured log rows: level, message, event time and the context columns as JSON text."""
    fields = F.struct(*[named(c).alias(c) for c in dict.fromkeys(context)])
    return df.select(
        F.lit(level).alias("level"), message.alias("message"), named(time).alias("event_time"), F.to_json(fields).alias("context")
    )
