"""Scratch tables, words and file access shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import uuid
import weakref
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import scratch_path, shared_dir

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: While a scratch table is written: texts and shingle sets are long, and a batch stands in the JVM and in the worker.
WRITE_WITH = {CLEAN_SHUFFLES: "true", BATCH_ROWS: "1000"}
#: Fixed by the contracts: the characters between words.
SPACES = " \t\n\x0b\x0c\r"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back.

    It cuts the lineage: a lost executor costs a re-read. The shuffle files behind it are dropped
    as soon as it is written, so that the steps of an operator don't add up on disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {key: spark.conf.get(key, None) for key in WRITE_WITH}
    for key, value in WRITE_WITH.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Removes the files of stored tables that nothing will read again; other tables are left alone.

    What was made from them must be stored itself: a plan that isn't run yet still reads them.
    """
    for df in tables:
        path = _PATHS.pop(df, None) if df is not None else None
        if path is not None:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, for files that tasks write themselves."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; both sides of a cluster reach it by its address."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_fold(name: str, folds: int) -> Column:
    """crc32 of the id's text, modulo folds."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % folds


_RANDOM = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def codes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit code of each word: a polynomial over its bytes, each byte replaced by a random odd number, mixed
    so that every bit depends on the whole word."""
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = sizes.cumsum()
    values = _RANDOM[np.frombuffer(b"".join(words), np.uint8)]
    place = np.arange(len(values), dtype=np.int64) - np.repeat(ends - sizes, sizes)
    powers = _powers(int(sizes.max()))
    sums = np.add.reduceat(values * powers[place], ends - sizes)
    return mixed(sums + sizes.astype(np.uint64))


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n consecutive words."""
    out = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * _BASE + codes[i : i + len(out)]
    return mixed(out)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch a few rows at a time: a whole batch of texts that goes back stands in the worker and in the JVM once more."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def records(batch: pa.RecordBatch, *names: str, rows: int = 512) -> Iterator[tuple]:
    """The batch's rows as tuples, a few at a time: whole batches of texts would stand in memory twice."""
    part = batch.select(list(names))
    for at in range(0, batch.num_rows, rows):
        yield from zip(*(column.to_pylist() for column in part.slice(at, rows).columns))
    give_back()


@lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL | None:
    library = ctypes.CDLL(None) if sys.platform.startswith("linux") else None
    return library if hasattr(library, "malloc_trim") else None


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on for later stages and would keep the most it ever had."""
    pa.default_memory_pool().release_unused()
    if _c_library() is not None:
        _c_library().malloc_trim(0)


def crc(data: bytes, before: int = 0) -> int:
    return zlib.crc32(data, before) & 0xFFFFFFFF


def unused_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted
