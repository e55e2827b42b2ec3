"""Cleaning: identifiers out, infinities to missing, median imputation, exact duplicate rows."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import finite_or_null, is_floating, named, nan_to_null, numeric_columns
from flowsieve.operators.quantiles import exact_quantiles
from flowsieve.operators.stages import FlowEstimator, FlowModel, state, strings, text

IDENTIFIERS = ["flow_id", "src_ip", "dst_ip"]


def drop_identifiers(df: DataFrame, names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Drops identifier columns; absent names are ignored, ``keep`` survives as row key."""
    names = IDENTIFIERS if names is None else names
    return df.drop(*[name for name in names if name not in (keep or [])])


def median_values(df: DataFrame, columns: list[str], method: str = "exact") -> dict[str, float | None]:
    """Medians over the finite values, exact by default.

    ``approx`` is a sketch for tables where one pass matters more than the last digits: it returns
    an element of the column, not an interpolation.
    """
    if method == "exact":
        return {c: values[0] for c, values in exact_quantiles(df, columns, [0.5]).items()}
    if method != "approx":
        raise ValueError(f"unknown median method: {method}")
    row = df.agg(
        *[
            F.percentile_approx(finite_or_null(named(c).cast("double")), 0.5, 10_000).alias(f"v{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: row[f"v{i}"] for i, c in enumerate(columns)}


def dedup_flows(
    df: DataFrame, policy: str = "features_and_label", label: str | None = None, key: str | None = None
) -> DataFrame:
    """Removes exact duplicate rows.

    - ``features_and_label``: rows count as copies when features and label agree.
    - ``features``: rows count as copies when the features agree; a group with several labels has
      no usable label and goes away as a whole.
    - ``none``: no change.

    Missing compares equal to missing. The smallest ``key`` of a group stays on the row. Copies are
    merged before the shuffle, so a group of copies may be of any size.
    """
    if policy == "none":
        return df
    for f in df.schema:
        if is_floating(f.dataType):
            df = df.withColumn(f.name, nan_to_null(named(f.name)))
    order = df.columns
    if policy == "features_and_label":
        same = [c for c in order if c != key]
        if key is None:
            return df.distinct()
        return df.groupBy(*map(named, same)).agg(F.min(named(key)).alias(key)).select(*map(named, order))
    if policy != "features":
        raise ValueError(f"unknown duplicate policy: {policy}")
    same = [c for c in order if c not in (key, label)]
    if label is None and key is None:
        return df.distinct()
    kept = [F.min(named(c)).alias(c) for c in (label, key) if c is not None]
    one_label = [] if label is None else [F.max(named(label)).alias("_last_label"), F.count_if(named(label).isNull()).alias("_no_label")]
    grouped = df.groupBy(*map(named, same)).agg(*kept, *one_label, F.count("*").alias("_copies"))
    if label is not None:
        unlabelled = F.col("_no_label") == F.col("_copies")
        agreed = (named(label) == F.col("_last_label")) & (F.col("_no_label") == 0)
        grouped = grouped.where(unlabelled | agreed)
    return grouped.select(*map(named, order))


def _filled(column: Column, data_type: T.DataType, median: float | None, string_null: str) -> Column | None:
    """The column without gaps. Numbers become double whatever the data, as medians are fractional."""
    if isinstance(data_type, T.NumericType):
        return F.coalesce(finite_or_null(column.cast("double")), F.lit(0.0 if median is None else float(median)))
    if isinstance(data_type, T.StringType):
        return F.coalesce(column, F.lit(string_null))
    if isinstance(data_type, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    return None


class FlowCleaner(FlowEstimator):
    """Fits the medians on the training flows, before duplicates are removed.

    ``keepCols`` are label and key columns: they stay on the row and are never imputed.
    ``stringNull`` fills missing text: ``Missing`` by default, ``0`` for a plain zero fill.
    """

    dropCols = strings("dropCols", "identifier columns to drop; absent names are ignored")
    keepCols = strings("keepCols", "label and key columns passed through untouched")
    median = text("median", "exact or approx")
    stringNull = text("stringNull", "fill for missing text")

    @keyword_only
    def __init__(self, *, dropCols=None, keepCols=None, median="exact", stringNull="Missing"):
        super().__init__()
        self._setDefault(dropCols=IDENTIFIERS, keepCols=[], median="exact", stringNull="Missing")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "FlowCleanerModel":
        dropped, kept = self._read("dropCols"), self._read("keepCols")
        numeric = numeric_columns(df, [*(c for c in dropped if c not in kept), *kept])
        medians = median_values(df, numeric, self._read("median")) if numeric else {}
        model = FlowCleanerModel(
            dropCols=dropped, keepCols=kept, stringNull=self._read("stringNull"), medians=medians
        )
        return model


class FlowCleanerModel(FlowModel):
    """Applies the fitted medians in one projection; scoring never drops a row."""

    dropCols = strings("dropCols", "identifier columns to drop; absent names are ignored")
    keepCols = strings("keepCols", "label and key columns passed through untouched")
    stringNull = text("stringNull", "fill for missing text")
    medians = state("medians", "median by numeric column, null where the column had no value")

    @keyword_only
    def __init__(self, *, dropCols=None, keepCols=None, stringNull=None, medians=None):
        super().__init__()
        self._setDefault(dropCols=IDENTIFIERS, keepCols=[], stringNull="Missing", medians={})
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        kept, medians = self._read("keepCols"), self._read("medians")
        df = drop_identifiers(df, self._read("dropCols"), kept)
        filled = {
            f.name: _filled(named(f.name), f.dataType, medians.get(f.name), self._read("stringNull"))
            for f in df.schema
            if f.name not in kept
        }
        return df.select(
            *[named(c) if filled.get(c) is None else filled[c].alias(c) for c in df.columns]
        )
