"""Encoders: one-hot columns aligned to the fitted table, label indices and their inverses."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import named, string_columns
from flowsieve.operators.bounds import MAX_CLASSES, bounded_rows, label_text, small_table
from flowsieve.operators.profile import require_columns
from flowsieve.operators.stages import FlowEstimator, FlowModel, FlowTransformer, number, state, strings, text

MISSING = "Missing"
#: Most values of a column in a sparse vector: the dictionary goes to the driver and to every task.
MAX_WIDE = 100_000


def categorical(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(MISSING))


def typed_fill(data_type: str, numeric_fill: float = 0) -> Column:
    """Fill for a column the table lacks: zero for numbers, ``Missing`` for text, else NULL."""
    parsed = T._parse_datatype_string(data_type)
    if isinstance(parsed, T.NumericType):
        return F.lit(numeric_fill).cast(parsed)
    if isinstance(parsed, T.StringType):
        return F.lit(MISSING)
    return F.lit(None).cast(parsed)


def align_columns(df: DataFrame, fitted: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """The fitted columns in fitted order: extras dropped, absent ones added with a typed fill."""
    kept = [c for c in (keep or []) if c in df.columns and c not in fitted]
    return df.select(
        *map(named, kept),
        *[named(c) if c in df.columns else typed_fill(kind).alias(c) for c, kind in fitted.items()],
    )


def category_values(df: DataFrame, columns: list[str], limit: int) -> dict[str, list[str]]:
    """Sorted distinct values of every column from one pass, at most ``limit`` each.

    A column with more values raises: it is not categorical, and its one-hot form would be as wide.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), categorical(named(c)).alias("value")) for c in columns])
    found = df.select(F.inline(cells)).distinct()
    values: dict[str, list[str]] = {c: [] for c in columns}
    for row in bounded_rows(found, limit * len(columns), f"categories of {', '.join(columns)}"):
        values[row["column"]].append(row["value"])
    too_wide = [c for c, found_values in values.items() if len(found_values) > limit]
    if too_wide:
        raise ValueError(f"more than {limit} categories in {', '.join(too_wide)}")
    return {c: sorted(found_values) for c, found_values in values.items()}


def category_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact number of categories of every column, from one pass; values meet spread over all tasks."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), categorical(named(c)).alias("value")) for c in columns])
    found = df.select(F.inline(cells)).distinct().groupBy("column").agg(F.count("*").alias("n"))
    counts = {row["column"]: row["n"] for row in bounded_rows(found, len(columns), "columns")}
    return {c: counts.get(c, 0) for c in columns}


class OneHot(FlowEstimator):
    """Replaces text columns by 0/1 columns ``<column>_<value>``, appended after the others.

    Unknown values become all zeros (``ignore``) or fail the job (``error``). ``keepCols`` (label,
    key) are neither encoded nor part of the fitted columns.
    """

    inputCols = strings("inputCols", "categorical columns; empty: all text columns")
    keepCols = strings("keepCols", "label and key columns passed through untouched")
    handleUnknown = text("handleUnknown", "ignore or error")
    maxCategories = number("maxCategories", "most values a column may have")

    @keyword_only
    def __init__(self, *, inputCols=None, keepCols=None, handleUnknown="error", maxCategories=200):
        super().__init__()
        self._setDefault(inputCols=[], keepCols=[], handleUnknown="error", maxCategories=200)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "OneHotModel":
        kept = self._read("keepCols")
        if self._read("handleUnknown") not in ("ignore", "error"):
            raise ValueError(f"unknown mode: {self._read('handleUnknown')}")
        columns = self._read("inputCols") or string_columns(df, kept)
        require_columns(df, columns)
        return OneHotModel(
            keepCols=kept,
            handleUnknown=self._read("handleUnknown"),
            categories=category_values(df, columns, self._read("maxCategories")),
            fitted={f.name: f.dataType.simpleString() for f in df.schema if f.name not in kept},
        )


class OneHotModel(FlowModel):
    keepCols = strings("keepCols", "label and key columns passed through untouched")
    handleUnknown = text("handleUnknown", "ignore or error")
    categories = state("categories", "sorted values by categorical column")
    fitted = state("fitted", "type by input column, in order")

    @keyword_only
    def __init__(self, *, keepCols=None, handleUnknown=None, categories=None, fitted=None):
        super().__init__()
        self._setDefault(keepCols=[], handleUnknown="error", categories={}, fitted={})
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        categories, fitted = self._read("categories"), self._read("fitted")
        kept = [c for c in self._read("keepCols") if c in df.columns]
        aligned = align_columns(df, fitted, kept)
        plain = [named(c) for c in aligned.columns if c not in categories]
        encoded = [
            self._indicator(c, value, values).alias(f"{c}_{value}")
            for c, values in categories.items()
            for value in values
        ]
        return aligned.select(*plain, *encoded)

    def row_error(self, df: DataFrame) -> Column:
        """The first unknown category of a row in ``error`` mode, or NULL."""
        aligned = {c for c in self._read("fitted") if c in df.columns}
        problems = [
            F.when(~categorical(named(c)).isin(values), F.concat(F.lit(f"unknown category in {c}: "), categorical(named(c))))
            for c, values in self._read("categories").items()
            if c in aligned and self._read("handleUnknown") == "error"
        ]
        return F.coalesce(F.lit(None).cast("string"), *problems)

    def _indicator(self, name: str, value: str, values: list[str]) -> Column:
        found = categorical(named(name))
        hit = (found == value).cast("double")
        if self._read("handleUnknown") == "ignore":
            return hit
        problem = F.raise_error(F.concat(F.lit(f"unknown category in {name}: "), found))
        return F.when(found.isin(values), hit).otherwise(problem)


class CategoryTexts(FlowTransformer):
    """Adds the text of each categorical column under a short name; a column the table lacks counts as missing."""

    inputCols = strings("inputCols", "categorical columns")
    outputCols = strings("outputCols", "their texts")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._setDefault(inputCols=[], outputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = zip(self._read("inputCols"), self._read("outputCols"))
        return df.withColumns({out: categorical(named(c)) if c in df.columns else F.lit(MISSING) for c, out in pairs})


class KnownCategories(FlowTransformer):
    """Fails the job at a category that the dictionary lacks, if ``handleUnknown`` is ``error``; see ``row_error``."""

    inputCols = strings("inputCols", "categorical columns")
    indexCols = strings("indexCols", "their places in the dictionary")
    sizes = state("sizes", "entries of each dictionary; the next place stands for all other values")
    handleUnknown = text("handleUnknown", "ignore or error")

    @keyword_only
    def __init__(self, *, inputCols=None, indexCols=None, sizes=None, handleUnknown="ignore"):
        super().__init__()
        self._setDefault(inputCols=[], indexCols=[], sizes=[], handleUnknown="ignore")
        self._set(**self._input_kwargs)

    def row_error(self, df: DataFrame) -> Column:
        """The first unknown category of a row in ``error`` mode, or NULL."""
        columns = zip(self._read("inputCols"), self._read("indexCols"), self._read("sizes"))
        problems = [
            F.when(named(index) >= size, F.concat(F.lit(f"unknown category in {c}: "), categorical(named(c)) if c in df.columns else F.lit(MISSING)))
            for c, index, size in columns
            if self._read("handleUnknown") == "error"
        ]
        return F.coalesce(F.lit(None).cast("string"), *problems)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._read("handleUnknown") != "error" or not self._read("indexCols"):
            return df
        first, problem = self._read("indexCols")[0], self.row_error(df)
        return df.withColumn(first, F.when(problem.isNull(), named(first)).otherwise(F.raise_error(problem).cast("double")))


class PackCategories(FlowTransformer):
    """Joins the indicator vectors into one and drops the columns they were made from."""

    inputCols = strings("inputCols", "indicator vectors")
    dropCols = strings("dropCols", "columns that go")
    outputCol = text("outputCol", "sparse vector of all categories")

    @keyword_only
    def __init__(self, *, inputCols=None, dropCols=None, outputCol="onehot"):
        super().__init__()
        self._setDefault(inputCols=[], dropCols=[], outputCol="onehot")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        packed = VectorAssembler(inputCols=self._read("inputCols"), outputCol=self._read("outputCol")).transform(df)
        gone = {*self._read("inputCols"), *self._read("dropCols")}
        return packed.select(*[named(c) for c in packed.columns if c not in gone])


def fit_onehot_vector(
    df: DataFrame, columns: list[str], output: str = "onehot", max_categories: int = MAX_WIDE, unknown: str = "ignore", keep: bool = True
) -> PipelineModel:
    """One sparse vector for all categorical columns, for more categories than columns can carry.

    Values are in sorted order, column after column; an unknown value adds nothing to the vector (``ignore``) or
    fails the job (``error``). A column with more than ``max_categories`` values, counted exactly, raises. Without ``keep``
    the categorical columns go.
    """
    too_wide = [c for c, n in category_counts(df, columns).items() if n > max_categories]
    if too_wide:
        raise ValueError(f"more than {max_categories} categories in {', '.join(too_wide)}")
    texts, indices, hots = ([f"_{kind}{i}" for i in range(len(columns))] for kind in ("text", "index", "hot"))
    words = CategoryTexts(inputCols=columns, outputCols=texts)
    table = words.transform(df.select(*map(named, columns)))
    indexer = StringIndexer(inputCols=texts, outputCols=indices, handleInvalid="keep", stringOrderType="alphabetAsc").fit(table)
    encoder = OneHotEncoder(inputCols=indices, outputCols=hots, dropLast=True).fit(indexer.transform(table))
    known = KnownCategories(inputCols=columns, indexCols=indices, sizes=[len(v) for v in indexer.labelsArray], handleUnknown=unknown)
    pack = PackCategories(inputCols=hots, dropCols=[*texts, *indices, *([] if keep else columns)], outputCol=output)
    return PipelineModel([words, indexer, known, encoder, pack])


class LabelIndex(FlowEstimator):
    """Numbers the sorted classes of a label column from 0.

    ``handleInvalid`` decides about a class not seen at fit: ``error`` fails the job, ``keep`` gives
    NULL, ``skip`` drops the row.
    """

    labelCol = text("labelCol", "class column")
    outputCol = text("outputCol", "index column")
    handleInvalid = text("handleInvalid", "error, keep or skip")
    maxClasses = number("maxClasses", "most classes allowed")

    @keyword_only
    def __init__(self, *, labelCol="label", outputCol="label_index", handleInvalid="error", maxClasses=MAX_CLASSES):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="label_index", handleInvalid="error", maxClasses=MAX_CLASSES)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LabelIndexModel":
        label = self._read("labelCol")
        require_columns(df, [label])
        found = df.select(label_text(named(label)).alias("class")).where("class is not null").distinct()
        classes = sorted(row["class"] for row in bounded_rows(found, self._read("maxClasses"), f"classes of {label}"))
        return LabelIndexModel(
            labelCol=label, outputCol=self._read("outputCol"), handleInvalid=self._read("handleInvalid"), classes=classes
        )


class LabelIndexModel(FlowModel):
    labelCol = text("labelCol", "class column")
    outputCol = text("outputCol", "index column")
    handleInvalid = text("handleInvalid", "error, keep or skip")
    classes = strings("classes", "sorted class names; the position is the index")

    @keyword_only
    def __init__(self, *, labelCol=None, outputCol=None, handleInvalid=None, classes=None):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="label_index", handleInvalid="error", classes=[])
        self._set(**self._input_kwargs)

    def class_table(self, spark: SparkSession) -> DataFrame:
        """The fitted classes as ``(class, index)``."""
        rows = [(name, i) for i, name in enumerate(self._read("classes"))]
        return small_table(spark, rows, "class string, index int")

    def _transform(self, df: DataFrame) -> DataFrame:
        label, output, mode = self._read("labelCol"), self._read("outputCol"), self._read("handleInvalid")
        table = self.class_table(df.sparkSession).toDF("_class", output)
        joined = df.join(table, label_text(named(label)) == F.col("_class"), "inner" if mode == "skip" else "left")
        if mode == "error":
            problem = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col("_class"), label_text(named(label)), F.lit("NULL"))))
            joined = joined.withColumn(output, F.coalesce(F.col(output), problem.cast("int")))
        return joined.drop("_class")

    def unseen_labels(self, df: DataFrame) -> DataFrame:
        """Distinct labels of a table that the fit did not see."""
        label = self._read("labelCol")
        table = self.class_table(df.sparkSession)
        labels = df.select(label_text(named(label)).alias("class"))
        return labels.join(table, "class", "left_anti").distinct()

    def names(self, df: DataFrame, index: str, output: str) -> DataFrame:
        """Adds the class name of an index column."""
        table = self.class_table(df.sparkSession).toDF(output, "_index")
        return df.join(table, named(index) == F.col("_index"), "left").drop("_index")


def one_vs_rest(df: DataFrame, index: str, classes: list[str], output: str = "is_class") -> DataFrame:
    """Long 0/1 form: one row per input row and class."""
    names = F.array(*map(F.lit, classes))
    return df.select("*", F.posexplode(names).alias("class_index", "class")).withColumn(
        output, (named(index) == F.col("class_index")).cast("int")
    )
