"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")
EULER_GAMMA = 0.5772156649015329


def named(name: str) -> Column:
    """A top-level column by its exact name; flow corpora put spaces and dots into names."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Integer, decimal and floating columns; booleans and timestamps do not count as numeric."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def finite_or_null(column: Column) -> Column:
    """NaN and both infinities become NULL; Spark orders NaN above infinity, so one test does."""
    return F.when(F.abs(column) < F.lit(INFINITY), column)


def is_missing(df: DataFrame, name: str) -> Column:
    column = named(name)
    missing = column.isNull()
    return missing | F.isnan(column) if is_floating(df.schema[name].dataType) else missing


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 at a zero denominator and NULL where an input is NULL."""
    return F.when(denominator != 0, numerator / denominator).when(denominator == 0, F.lit(0.0))


def file_stem(path: Column) -> Column:
    """Last path part without its extension."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def hash_order(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of a unique key: the md5 digest of ``key:seed``."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def digamma(count: Column) -> Column:
    """Digamma of a positive integer: six recurrence steps, then the asymptotic series."""
    x = count.cast("double")
    shift = sum((1.0 / (x + i) for i in range(1, 6)), 1.0 / x)
    y = x + 6.0
    inv2 = 1.0 / (y * y)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240)))
    return F.log(y) - 0.5 / y - series - shift
