"""Reading, assembling and writing labelled flow tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import file_stem, named
from flowsieve.operators.bounds import bounded_rows
from flowsieve.operators.profile import require_columns

MAX_SCHEMAS = 1_000

# The storage format of each corpus, and the class each capture day stands for. The
# first rule whose tokens all occur in the file name decides; matching is case-sensitive.
CORPUS_FORMATS = {"CIC": "parquet", "UNSW": "csv"}
BENIGN = "BENIGN"
NAME_SUFFIX = "-no-metadata"
CAPTURE_RULES = (
    (("Monday",), "BENIGN"),
    (("Tuesday",), "Bruteforce"),
    (("Wednesday",), "DoS"),
    (("Thursday", "Infiltration"), "Infiltration"),
    (("Thursday",), "WebAttacks"),
    (("Friday", "DDoS"), "DDoS"),
    (("Friday", "Portscan"), "Portscan"),
    (("Friday", "Botnet"), "Botnet"),
)


def read_flows(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: T.StructType | str | None = None
) -> DataFrame:
    """A flow table from Parquet or from CSV with a header.

    Without a schema, CSV types are inferred, which reads the data once more; pin the schema of the
    first read (``df.schema``) for large folders.
    """
    if fmt == "parquet":
        reader = spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(*([path] if isinstance(path, str) else path))
    if fmt != "csv":
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_splits(
    spark: SparkSession, paths: dict[str, str], dataset: str, schema: T.StructType | str | None = None
) -> dict[str, DataFrame]:
    """The tables of a corpus by split name; later CSV splits take the schema of the first."""
    if dataset.upper() not in CORPUS_FORMATS:
        raise ValueError(f"unknown corpus: {dataset}; known: {', '.join(CORPUS_FORMATS)}")
    fmt = CORPUS_FORMATS[dataset.upper()]
    tables: dict[str, DataFrame] = {}
    for split, path in paths.items():
        tables[split] = read_flows(spark, path, fmt, schema)
        if fmt == "csv" and schema is None:
            schema = tables[split].schema
    return tables


def label_from_filename(name: Column, rules=CAPTURE_RULES) -> Column:
    """Class of a capture file by the tokens in its name (without extension).

    Names that no rule matches give their last ``-`` token, the metadata suffix aside.
    """
    label = F.element_at(F.split(F.replace(name, F.lit(NAME_SUFFIX), F.lit("")), "-"), -1)
    for tokens, value in reversed(rules):
        matches = F.lit(True)
        for token in tokens:
            matches = matches & name.contains(token)
        label = F.when(matches, F.lit(value)).otherwise(label)
    return label


def attack_flag(label: Column, benign: str = BENIGN) -> Column:
    return F.when(label == benign, 0).otherwise(1)


def with_capture_labels(df: DataFrame, name: Column) -> DataFrame:
    """Adds ``attack_type``, ``attack_label`` and ``source_file`` from a file-name column."""
    label = label_from_filename(name)
    return df.withColumns({"attack_type": label, "attack_label": attack_flag(label), "source_file": name})


def capture_file(path: Column) -> Column:
    """Name of the capture a data file belongs to: the file itself, or the Parquet folder it is a part of."""
    parts = F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/")
    folder, file = F.element_at(parts, -2), F.element_at(parts, -1)
    return file_stem(F.when(folder.endswith(".parquet"), folder).otherwise(file))


def assemble(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All ``*.parquet`` captures of a folder as one labelled table, columns matched by name.

    A capture may be one file or a folder of part files. Columns it lacks are NULL. One scan reads
    everything. Only when captures disagree about the type of a column is there one scan for each schema, and
    such columns are widened (numbers to double, the rest to text). A given schema is taken as it is.
    """
    captures = f"{folder}/*.parquet"
    if schema is not None:
        return _labelled([spark.read.schema(schema).parquet(captures)])
    try:
        return _labelled([spark.read.option("mergeSchema", True).parquet(captures)])
    except (PySparkException, Py4JJavaError) as error:
        if not _is_conflict(error):
            raise
    return _labelled([spark.read.schema(spark.read.parquet(files[0]).schema).parquet(*files) for files in files_by_schema(spark, captures)])


def _labelled(tables: list[DataFrame]) -> DataFrame:
    named_rows = [t.withColumn("_capture", capture_file(F.col("_metadata.file_path"))) for t in tables]
    flows = named_rows[0] if len(tables) == 1 else union_by_name(named_rows)
    return with_capture_labels(flows, F.col("_capture")).drop("_capture")


def _is_conflict(error: PySparkException | Py4JJavaError) -> bool:
    """Whether Spark's condition is that two files have different types for a column."""
    condition = error.getCondition() if isinstance(error, PySparkException) else _java_condition(error.java_exception)
    return (condition or "").startswith("CANNOT_MERGE_SCHEMA")


def _java_condition(error) -> str | None:
    return error.getCondition() if "getCondition" in dir(error) else None


def files_by_schema(spark: SparkSession, captures: str) -> list[list[str]]:
    """The Parquet files in groups of one schema. Tasks read the footers, through Arrow's file systems; what
    reaches the driver is the list of files, which every read needs, and at most ``MAX_SCHEMAS`` groups."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("file_path").to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                found.append(str(pq.read_schema(path, filesystem=system).remove_metadata()))
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array(found, pa.string())], names=["file_path", "kinds"])

    paths = spark.read.parquet(captures).select("_metadata.file_path").distinct()
    plain = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    literal = F.regexp_replace(plain, r"([\[\]{}*?\\])", r"\\$1")  # a path of a read is a pattern
    groups = paths.mapInArrow(footers, "file_path string, kinds string").groupBy("kinds").agg(F.sort_array(F.collect_list(literal)).alias("files"))
    return sorted(row["files"] for row in bounded_rows(groups, MAX_SCHEMAS, "schemas of the captures"))


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """Union with columns matched by name; absent ones are NULL, conflicting types are widened."""
    kinds: dict[str, list[T.DataType]] = {}
    for table in tables:
        for f in table.schema:
            seen = kinds.setdefault(f.name, [])
            if f.dataType not in seen:
                seen.append(f.dataType)
    widened = {
        name: (T.DoubleType() if all(isinstance(t, T.NumericType) for t in seen) else T.StringType())
        for name, seen in kinds.items()
        if len(seen) > 1
    }
    result = None
    for table in tables:
        table = table.select(*[named(c).cast(widened[c]).alias(c) if c in widened else named(c) for c in table.columns])
        result = table if result is None else result.unionByName(table, allowMissingColumns=True)
    if result is None:
        raise ValueError("no tables to unite")
    return result


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split: str = "split", mode: str = "errorifexists") -> None:
    """One folder per split under ``path``; a later filter on the split reads only its folder."""
    require_columns(df, [split])
    writer = df.write.mode(mode).partitionBy(split)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
