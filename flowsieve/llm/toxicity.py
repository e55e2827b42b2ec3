"""Toxic documents by compression distance.

A text becomes two sequences of 32-bit codes, one for each run of five bytes and eight for each whole word,
and both are cut into windows.
Two zstandard dictionaries are trained, one on the stretches that toxic texts share and ordinary
ones lack, one the other way round. A window that the toxic dictionary shortens by more bytes than
the ordinary one speaks for toxicity; coded this way, a match saves many times what the
compressor's own choices add or take. The largest gain of a document's windows is held against a
threshold calibrated on labelled documents that trained neither dictionary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import codes_of, id_fold, mixed, records, slices, stored, table, unused_name
from flowsieve.operators.bounds import bounded_rows, small_table

RUN = 5
WORD_CODES = 8
_AROUND = b".,;:!?()[]{}<>*_-'\""
WINDOW = 1024  # codes
SLICE = WINDOW << 9
FOLDS = 5
HELD_OUT, CALIBRATION = 0, 4
#: Bound of the labelled sample, by label.
SAMPLE_ROWS = 8_000
#: A code is trained on if it is in this share of a label's documents, and in LOG_ODDS more often there.
LEAST_SHARE = 0.005
LEAST_DOCS = 5
LOG_ODDS = {1: 3.0, 0: 1.0}
MAX_CODES = 50_000
DICTIONARY_BYTES = 32_000
MAX_STRETCHES = 20_000


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    threshold: float
    scale: float


def codes(text: str | None) -> Iterator[np.ndarray]:
    """Codes of the lower-cased text with single spaces, in slices of bounded length."""
    words = (text or "").lower().encode().split()
    if not words:
        return
    data = np.frombuffer(b"  " + b" ".join(words) + b"     ", np.uint8)
    for at in range(0, len(data) - RUN + 1, SLICE):
        part = data[at : at + SLICE + RUN - 1].astype(np.uint32)
        out = np.zeros(len(part) - RUN + 1, np.uint32)
        for k in range(RUN):
            out = out * np.uint32(0x02000327) + part[k : k + len(out)] * np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x2C1B3C6D)
        yield out ^ (out >> np.uint32(13))


def word_codes(text: str | None) -> Iterator[np.ndarray]:
    """``WORD_CODES`` codes of each whole word without punctuation around it, in slices of bounded length."""
    words = (text or "").lower().encode().split()
    for at in range(0, len(words), SLICE // WORD_CODES):
        bare = [w for word in words[at : at + SLICE // WORD_CODES] if (w := word.strip(_AROUND))]
        if bare:
            salted = codes_of(bare)[:, None] + np.arange(1, WORD_CODES + 1, dtype=np.uint64)
            yield (mixed(salted) >> np.uint64(32)).astype(np.uint32).ravel()


def units(text: str | None) -> Iterator[np.ndarray]:
    """Codes of the runs, then of the words: a word of ordinary syllables has no run of its own."""
    yield from codes(text)
    yield from word_codes(text)


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard as z

    settings = z.ZstdCompressionParameters(
        compression_level=1, window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=6,
        strategy=z.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    trained = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=settings)
    return z.ZstdCompressor(dict_data=trained, compression_params=settings)


def windows(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Windows that overlap by half, across slices too, so that half a window is whole in one of them."""
    step = WINDOW // 2
    rest = np.zeros(0, np.uint32)
    for part in parts:
        rest = np.concatenate((rest, part))
        ready = max(len(rest) - step - 1, 0) // step * step
        for at in range(0, ready, step):
            yield rest[at : at + WINDOW]
        rest = rest[ready:]
    if len(rest):
        yield rest[:WINDOW]
    if len(rest) > WINDOW:
        yield rest[step:]


def gain(text: str | None, toxic: bytes, ordinary: bytes) -> int:
    """Most bytes by which the toxic dictionary shortens a window of the text; 0 without words."""
    more, less = _compressor(ordinary), _compressor(toxic)
    best: int | None = None
    for parts in (codes(text), word_codes(text)):
        for window in map(np.ndarray.tobytes, windows(parts)):
            saved = len(more.compress(window)) - len(less.compress(window))
            best = saved if best is None else max(best, saved)
    return best or 0


def filled(stretches: Iterable[bytes], size: int) -> bytes:
    """The stretches that fit, the first one last: near matches are cheap."""
    data = b""
    for stretch in stretches:
        if len(data) + len(stretch) <= size:
            data = bytes(stretch) + data
    return data


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, label, fold`` of at most ``rows`` labelled documents of each label, taken by a hash of the
    id; the held-out fold is left out. Missing ids, texts and labels are not used."""
    fold = id_fold("doc_id", FOLDS)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.where(fold != HELD_OUT).select("doc_id", "label", fold.cast("int").alias("fold")).distinct()
    taken = []
    for label in (0, 1):
        first = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        taken += [tuple(r) for r in bounded_rows(first, rows, "labelled sample")]
    ids = small_table(docs.sparkSession, taken, "doc_id long, label int, fold int")
    return docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id").select("text", "label", "fold")


def _code_counts(sample: DataFrame) -> DataFrame:
    """Documents of each label that hold a code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label in (0, 1):
                found = [
                    np.unique(np.concatenate(parts))
                    for text, x in records(batch, "text", "label")
                    if x == label and (parts := list(units(text)))
                ]
                if found:
                    values, n = np.unique(np.concatenate(found), return_counts=True)
                    kinds = [pa.array(np.full(len(values), label, np.int32)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(kinds, names=["label", "code", "n"])

    return sample.mapInArrow(count, "label int, code long, n long").groupBy("code").agg(
        *[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"n{x}") for x in (0, 1)]
    )


def _stretches(sample: DataFrame, chosen: dict[int, np.ndarray]) -> DataFrame:
    """Longest runs of a label's codes in its documents, and how often they occur."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            for text, label in records(batch, "text", "label"):
                for part in units(text):
                    inside = np.isin(part, chosen[label])
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
                    out += [(label, part[a:b].tobytes()) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "stretch"])

    return sample.mapInArrow(cut, "label int, stretch binary").groupBy("label", "stretch").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Dictionaries and threshold from a bounded sample; None if a label is missing."""
    sample = stored(sampled(docs, labels, rows).repartition(docs.sparkSession.sparkContext.defaultParallelism), "labelled")
    training, rest = sample.where(F.col("fold") != CALIBRATION), sample.where(F.col("fold") == CALIBRATION)
    n = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    counts = stored(_code_counts(training), "codes")
    chosen = {}
    for x in (0, 1):
        here, there = F.col(f"n{x}"), F.col(f"n{1 - x}")
        odds = F.log((here + 0.5) / (n[x] + 1)) - F.log((there + 0.5) / (n[1 - x] + 1))
        often = counts.where(here >= max(LEAST_DOCS, LEAST_SHARE * n[x])).where(odds > LOG_ODDS[x])
        top = often.orderBy(odds.desc(), "code").select("code").limit(MAX_CODES)
        chosen[x] = np.array([r["code"] for r in bounded_rows(top, MAX_CODES, "codes")], np.uint32)
    found = stored(_stretches(training, chosen), "stretches")
    dictionaries = {}
    size = DICTIONARY_BYTES
    for x in (1, 0):  # the ordinary dictionary is as long as the toxic one
        rows = found.where(F.col("label") == x).orderBy(F.col("n").desc(), "stretch").limit(MAX_STRETCHES).collect()
        data = filled((row["stretch"] for row in rows), size)
        dictionaries[x] = data or b"\0" * 8
        size = len(dictionaries[x])
    gains = scored(rest, dictionaries[1], dictionaries[0]).groupBy("label", "gain").agg(F.count("*").alias("n")).collect()
    threshold, scale = calibrated([(r["label"], r["gain"], r["n"]) for r in gains])
    return Model(dictionaries[1], dictionaries[0], threshold, scale)


def calibrated(gains: list[tuple[int, int, int]]) -> tuple[float, float]:
    """The cut with the least balanced error, in the middle of the widest gap that has it; and the
    spread that the score's slope is taken from."""
    values = sorted({g for _, g, _ in gains} | {0})
    total = {x: sum(n for label, _, n in gains if label == x) or 1 for x in (0, 1)}
    below = {x: 0 for x in (0, 1)}
    best: list[tuple[float, float, float]] = []
    for low, high in zip([values[0] - 1, *values], [*values, values[-1] + 1]):
        for label, g, n in gains:
            if g == low:
                below[label] += n
        error = below[1] / total[1] + 1 - below[0] / total[0]
        best.append((error, low - high, (low + high) / 2))
    cut = max(min(best)[2], 0.5)
    return cut, max(cut / 4, 0.5)


def scored(docs: DataFrame, toxic: bytes, ordinary: bytes, name: str = "gain") -> DataFrame:
    """Adds the gain of each row's ``text``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.IntegerType())])
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast((toxic, ordinary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = pa.array([gain(t, *shared.value) for (t,) in records(part, "text")], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=names)

    return docs.mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """Adds a score from 0 to 1, 0.5 at the threshold, to the columns of docs. Empty and NULL texts
    have gain 0; without a model all scores are 0."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    held = unused_name(docs, "_gain")
    steep = (F.col(held) - F.lit(model.threshold)) / F.lit(model.scale)
    return scored(docs, model.toxic, model.ordinary, held).withColumn(name, 1 / (1 + F.exp(-steep))).drop(held)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels outside fold 0. A missing id is fold 0 of the
    empty text; repeated rows are scored each; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    fold = F.coalesce(id_fold("doc_id", FOLDS), F.lit(0))
    found = score_texts(docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
