"""Metadata records of assembled tables and splits, as one-row DataFrames written to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import named


def dataset_metadata(df: DataFrame, label: str = "attack_type", source: str | None = "source_file") -> DataFrame:
    """Totals, class counts, classes and source files of a table, from one scan."""
    origin = named(source) if source and source in df.columns else F.lit(None).cast("string")
    cells = df.groupBy(named(label).cast("string").alias("class"), origin.alias("source")).agg(F.count("*").alias("n"))
    by_class = cells.groupBy("class").agg(F.sum("n").alias("n"), F.collect_set("source").alias("sources"))
    return by_class.agg(
        F.sum("n").alias("total_samples"),
        F.lit(len(df.columns)).alias("total_features"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("class_distribution"),
        F.sort_array(F.collect_list("class")).alias("attack_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("source_files"),
    )


def source_counts(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows by source file as a table, for corpora with more files than one record should list."""
    return df.groupBy(named(source).cast("string").alias("source")).agg(F.count("*").alias("n"))


def linked_metadata(df: DataFrame, sources: str, label: str = "attack_type", source: str = "source_file") -> DataFrame:
    """The record of ``dataset_metadata`` with the number of source files and the path of their table instead of their names.

    Rows by class and source file are counted once and written as Parquet to ``sources`` (``class, source, n``); the record comes from
    that table and doesn't grow with the number of files. Rows without a class or a source count under NULL.
    """
    cells = df.groupBy(named(label).cast("string").alias("class"), named(source).cast("string").alias("source")).agg(F.count("*").alias("n"))
    cells.write.parquet(sources)
    written = df.sparkSession.read.schema(cells.schema).parquet(sources)
    # two steps: a distinct count of files in one row would gather them in one task
    files = written.where("source is not null").select("source").distinct().agg(F.count("*").alias("n_source_files"))
    by_class = written.groupBy("class").agg(F.sum("n").alias("n"))
    entries = F.sort_array(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "n"))))  # one entry per class
    record = by_class.agg(
        F.sum("n").alias("total_samples"),
        F.lit(len(df.columns)).alias("total_features"),
        F.map_from_entries(entries).alias("class_distribution"),
        F.sort_array(F.collect_list("class")).alias("attack_types"),
    )
    count = files.first()["n_source_files"]
    return record.withColumns({"n_source_files": F.lit(count).cast("bigint"), "source_table": F.lit(sources)})


def holdout_metadata(df: DataFrame, label: str = "label", val_size: float = 0.15, random_state: int = 42, split: str = "split") -> DataFrame:
    """The record of a hold-out split, from one scan: sizes of the original and new parts, the parameters, and
    the class counts of each part. ``df`` is what ``holdout_split`` gives."""
    cells = df.groupBy(named(split).alias("split"), named(label).cast("string").alias("class")).agg(F.count("*").alias("n"))

    def rows(*parts: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("split").isin(*parts), F.col("n"))), F.lit(0).cast("bigint"))

    def classes(part: str) -> Column:  # one entry per class
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("split") == part, F.struct("class", "n")))))

    return cells.agg(
        rows("train", "validation").alias("original_training_samples"),
        rows("test").alias("original_test_samples"),
        rows("train").alias("new_train_samples"),
        rows("validation").alias("validation_samples"),
        rows("test").alias("test_samples"),
        F.lit(val_size).alias("val_size"),
        F.lit(random_state).alias("random_state"),
        classes("train").alias("train_distribution"),
        classes("validation").alias("val_distribution"),
        classes("test").alias("test_distribution"),
    )


def split_metadata(df: DataFrame, label: str, parameters: dict[str, float | int], split: str = "split") -> DataFrame:
    """One row per split: rows, class counts and shares, and the parameters of the split."""
    cells = df.groupBy(named(split).alias("split"), named(label).cast("string").alias("class")).agg(F.count("*").alias("n"))
    cells = cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))
    given = F.create_map(*[x for name, value in parameters.items() for x in (F.lit(name), F.lit(float(value)))])
    return cells.groupBy("split").agg(
        F.sum("n").alias("num_samples"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("class_counts"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "share")))).alias("class_distribution"),
        given.alias("split_parameters"),
    )


def write_metadata(record: DataFrame, path: str, mode: str = "errorifexists") -> None:
    record.coalesce(1).write.mode(mode).json(path)  # a handful of rows
