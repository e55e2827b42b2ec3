"""Language identification by multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams by language in one pass over the labelled documents; tasks add theirs up
before the shuffle. The log-probability matrix has a fixed number of rows and a checked number of
columns and is broadcast. Scoring takes many texts at a time: the n-grams of a text are a sparse
row of counts, and its product with the matrix is a sum of gathered rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import id_fold, mixed, records, stored, table
from flowsieve.operators.bounds import bounded_rows

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGS = 200
CELLS = 1 << 21
SLICE = 1 << 17
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"

_SPACE_BELOW_128 = np.array([0 if chr(c).isalpha() else 1 for c in range(128)], bool)


def slices(text: str) -> list[np.ndarray]:
    """Lower-cased code points in slices of bounded length; ASCII other than letters is a space, and two spaces stand
    at both ends of the text. Slices overlap by two characters, so every run of three is in one slice."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    padded = np.full(len(points) + 4, 32, np.uint32)
    padded[2:-2] = np.where(_SPACE_BELOW_128[np.minimum(points, 127)] & (points < 128), 32, points)
    return [padded[at : at + SLICE + 2] for at in range(0, len(padded) - 2, SLICE)]


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place (the last places run into what follows)."""
    codes = np.full(len(points) - order + 1, order, np.uint64)
    for k in range(order):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(codes)]
    return (mixed(codes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def fit(docs: DataFrame, label: Column | str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the (bucket, language) log-probabilities, from ``text`` and the label.

    Rows without a text or label are not used. No labelled row gives no language.
    """
    spark = docs.sparkSession
    labelled = docs.select("text", F.col(label) if isinstance(label, str) else label).toDF("text", "lang")
    labelled = labelled.where("text is not null and lang is not null")
    schema = "lang string, bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def add_up(lang: str) -> None:
            if held[lang]:
                counts[lang] += np.bincount(np.concatenate(held[lang]), minlength=1 << BUCKET_BITS)
            held[lang], sizes[lang] = [], 0

        for batch in batches:
            for text, lang in records(batch, "text", "lang"):
                if lang not in counts:
                    counts[lang], held[lang], sizes[lang] = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
                    if len(counts) > MAX_LANGS:
                        raise ValueError(f"more than {MAX_LANGS} languages")
                for points in slices(text):
                    held[lang] += [grams(points, order) for order in ORDERS]
                    sizes[lang] += len(points)
                if sizes[lang] >= 4 * SLICE:
                    add_up(lang)
        for lang, mine in counts.items():
            add_up(lang)
            used = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(mine[used], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    totals = stored(labelled.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r["lang"] for r in bounded_rows(totals.select("lang").distinct(), MAX_LANGS, "languages"))
    matrix = np.full((1 << BUCKET_BITS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):  # at most 2**BUCKET_BITS rows each
        cells = totals.where(F.col("lang") == lang).select("bucket", "n").toPandas()
        matrix[cells["bucket"].to_numpy(), k] += cells["n"].to_numpy()
    if langs:
        matrix = np.log(matrix / matrix.sum(0))
    return langs, matrix


def log_likelihoods(texts: list[list[np.ndarray]], matrix: np.ndarray) -> np.ndarray:
    """Sum of the matrix rows of each text's n-grams."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    points = np.concatenate([p for t in texts for p in t])
    sizes = np.array([len(p) for t in texts for p in t])
    starts = sizes.cumsum() - sizes
    total = np.zeros((len(sizes), matrix.shape[1]))
    for order in ORDERS:
        rows = np.vstack([matrix[grams(points, order)], np.zeros((order, matrix.shape[1]))])
        cuts = np.stack([starts, starts + sizes - order + 1], 1).reshape(-1)
        total += np.add.reduceat(rows, cuts)[::2]
    out = np.zeros((len(texts), matrix.shape[1]))
    np.add.at(out, owner, total)
    return out


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the posterior, even prior) to the columns of docs.

    A NULL text and one without a letter are ``und`` with score 0, and so is all if nothing was learned.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(matrix)
    group_points = max(CELLS // max(len(langs), 1), 1)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred: list[str] = [UNKNOWN] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            held: list[tuple[int, list[np.ndarray]]] = []
            points = 0

            def flush() -> None:
                if not held:
                    return
                logs = log_likelihoods([t for _, t in held], model.value)
                odds = np.exp(logs - logs.max(1, keepdims=True))
                odds /= odds.sum(1, keepdims=True)
                for (row, _), best, odd in zip(held, odds.argmax(1).tolist(), odds):
                    pred[row], scores[row] = langs[best], odd[best]
                held.clear()

            for row, (text,) in enumerate(records(batch, "text") if langs else ()):
                if text is None or not LETTER.search(text):
                    continue
                held.append((row, slices(text)))
                points += len(text)
                if points >= group_points:
                    flush()
                    points = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(score, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds other than 2. A missing id counts as
    the empty text; repeated rows are predicted each; an empty table gives no row."""
    fold = F.coalesce(id_fold("doc_id", 4), F.lit(0))
    docs = table(spark, sf_dir, "documents")
    langs, matrix = fit(docs.where(fold != 2))
    return predict(docs.select("doc_id", (fold == 2).alias("held_out"), "text"), langs, matrix).drop("text")
