"""Profiles of flow tables: class shares, missing cells, shapes, schema and step differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import is_missing, named


def require_columns(df: DataFrame, names: list[str]) -> None:
    """Fails on the driver, before any job, when a needed column is absent."""
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}; available: {df.columns}")


def class_distribution(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Rows and share per class, most frequent first; shares are within ``by`` where given."""
    by = by or []
    require_columns(df, [label, *by])
    counts = df.groupBy(*map(named, [*by, label])).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*(map(named, by) if by else [F.lit(1)]))  # over the class table, not over the rows
    share = F.col("n") / F.sum("n").over(whole)
    return counts.withColumn("share", share).orderBy(*map(named, by), F.desc("n"), named(label))


def split_distribution(df: DataFrame, label: str, split: str = "split", held_out_of: dict[str, str] | None = None) -> DataFrame:
    """Class percentage per split from one scan.

    ``held_out_of`` maps a split to the table it was cut from, e.g. ``{'train': 'original',
    'validation': 'original'}``; that table is added as a row group of its own.
    """
    parents = held_out_of or {}
    counts = df.groupBy(split, named(label)).agg(F.count("*").alias("n"))
    if parents:
        parent = F.lit(None).cast("string")
        for child, whole in parents.items():
            parent = F.when(F.col(split) == child, F.lit(whole)).otherwise(parent)
        groups = F.filter(F.array(F.col(split), parent), lambda g: g.isNotNull())
        counts = counts.withColumn(split, F.explode(groups)).groupBy(split, named(label)).agg(F.sum("n").alias("n"))
    percent = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(split))
    return counts.withColumn("percent", percent)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing cells and type per column, in long form; one wide aggregate over the table."""
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, name)).alias(f"m{i}") for i, name in enumerate(df.columns)],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("rows").alias("n_rows"),
                F.col(f"m{i}").alias("n_missing"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    return counts.select(F.inline(cells))


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two tables side by side: same, type_changed, only_left or only_right.

    The missing cells of each side come along, so one call answers whether two splits agree.
    """
    a = null_profile(left).toDF("column", "left_type", "left_rows", "left_missing")
    b = null_profile(right).toDF("column", "right_type", "right_rows", "right_missing")
    status = (
        F.when(F.col("right_type").isNull(), "only_left")
        .when(F.col("left_type").isNull(), "only_right")
        .when(F.col("left_type") != F.col("right_type"), "type_changed")
        .otherwise("same")
    )
    return a.join(b, "column", "full_outer").withColumn("status", status)


def column_types(df: DataFrame) -> list[str]:
    return sorted({f.dataType.simpleString() for f in df.schema})


def step_profile(before: DataFrame, after: DataFrame, operation: str) -> DataFrame:
    """One row: rows and columns on both sides of a step, and the columns it removed.

    Counting a stored table reads no column of it, so for steps that end in a written table this is
    cheap; a side that is computed on the fly is computed for the count.
    """
    removed = sorted(set(before.columns) - set(after.columns))
    n = F.count("*")
    rows_before = before.agg(n.alias("rows_before"), F.lit(0).cast("bigint").alias("rows_after"))
    rows_after = after.agg(F.lit(0).cast("bigint").alias("rows_before"), n.alias("rows_after"))
    return (
        rows_before.unionByName(rows_after)
        .agg(F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after"))
        .select(
            F.lit(operation).alias("operation"),
            "rows_before",
            "rows_after",
            F.lit(before.columns).alias("columns_before"),
            F.lit(after.columns).alias("columns_after"),
            F.lit(removed).cast(T.ArrayType(T.StringType())).alias("removed_columns"),
        )
    )
