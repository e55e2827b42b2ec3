"""Size-checked small tables: class lists, class counts, fitted maps.

Only data whose size is checked here reaches the driver or is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MAX_CLASSES = 10_000


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """All rows of a table that must be small; raises instead of cutting it short."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast side built from driver values that ``bounded_rows`` has counted."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def label_text(label: Column) -> Column:
    return label.cast("string")


def class_counts(df: DataFrame, label: str, limit: int = MAX_CLASSES) -> dict[str, int]:
    """Rows per class by name, in class order. A missing label is an error."""
    counts = df.groupBy(label_text(F.col(f"`{label}`")).alias("class")).agg(F.count("*").alias("n"))
    found = {row["class"]: row["n"] for row in bounded_rows(counts, limit, f"classes of {label}")}
    if None in found:
        raise ValueError(f"column {label} has {found[None]} rows without a label")
    return dict(sorted(found.items()))
