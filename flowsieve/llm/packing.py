"""Best-fit packing by exact complements.

Pieces of one length are interchangeable, so the plan works on the number of pieces per length, a
table no longer than a sequence however large the corpus is. For the longest length left, the index
of lengths, of pair sums and, through it, of triple sums is asked for combinations that fill the gap
exactly; a combination is used as often as its lengths last. What no combination completes is packed
best-fit: the longest length that still fits, again and again. The plan is a list of rank ranges per
length; Spark ranks the pieces and joins them with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import crc, records, stored, table
from flowsieve.llm.tokens import tokenizer_path, word_encoder
from flowsieve.operators.bounds import bounded_rows, small_table

CAPACITY = 4096
END_ID = 1
ROWS_PER_RANKING = 10_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Placed(NamedTuple):
    """Pieces of one length with ranks first..last-1: ``per_sequence`` in each sequence from
    ``sequence`` on, side by side from ``offset``."""

    length: int
    first: int
    last: int
    sequence: int
    offset: int
    per_sequence: int


class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.out: list[Placed] = []
        self.index_pairs()

    def index_pairs(self) -> None:
        have = np.flatnonzero(self.left)
        self.pair_sums = np.zeros(self.capacity + 1, bool)
        for a in have:
            sums = have + a
            self.pair_sums[sums[sums <= self.capacity]] = True

    def take(self, lengths: Counter[int]) -> None:
        """Uses a combination as often as its lengths last."""
        times = min(int(self.left[length]) // k for length, k in lengths.items())
        offset = 0
        for length, k in sorted(lengths.items(), reverse=True):
            first = int(self.used[length])
            self.out.append(Placed(length, first, first + k * times, self.sequences, offset, k))
            self.used[length] += k * times
            self.left[length] -= k * times
            offset += k * length
        self.sequences += times

    def pair(self, total: int, left: np.ndarray) -> tuple[int, int] | None:
        """The two lengths of that sum with the largest first one."""
        if total < 2:
            return None
        small = np.arange(1, total // 2 + 1)
        fits = (left[small] > 0) & (left[total - small] > 0)
        if total % 2 == 0:
            fits[-1] = left[total // 2] > 1
        found = np.flatnonzero(fits)
        return (total - int(small[found[0]]), int(small[found[0]])) if len(found) else None

    def complement(self, length: int) -> list[int] | None:
        """One, two or three available lengths that fill the gap beside a piece exactly."""
        gap = self.capacity - length
        left = self.left.copy()
        left[length] -= 1
        if gap and left[gap] > 0:
            return [gap]
        if self.pair_sums[gap] and (two := self.pair(gap, left)):
            return [*two]
        for attempt in range(2):
            firsts = np.flatnonzero((left[:gap] > 0) & self.pair_sums[gap : 0 : -1]) if gap > 2 else np.zeros(0, int)
            for a in firsts[::-1]:
                left[a] -= 1
                two = self.pair(gap - int(a), left)
                left[a] += 1
                if two:
                    return [int(a), *two]
            if attempt or not len(firsts):
                return None
            self.index_pairs()  # sums of used-up lengths had misled the search
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placed], int]:
    """Where the pieces of each length go, and the number of sequences."""
    p = _Plan(counts, capacity)
    if p.left[capacity]:
        p.take(Counter([capacity]))
    for length in range(capacity - 1, 0, -1):
        while p.left[length] and (rest := p.complement(length)) is not None:
            p.take(Counter([length, *rest]))
    for length in range(capacity - 1, 0, -1):
        while p.left[length]:
            together, gap, left = Counter({length: 1}), capacity - length, p.left.copy()
            left[length] -= 1
            while gap and len(fits := np.flatnonzero(left[: gap + 1])):
                best = int(fits[-1])
                k = min(gap // best, int(left[best]))
                together[best] += k
                left[best] -= k
                gap -= k * best
            p.take(together)
    return p.out, p.sequences


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of ``capacity``; the last may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = word_encoder(path), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in records(batch, "doc_id", "text"):
                data = encoder.encode(text) + end
                rows += [
                    (doc_id, k, at // 4, (min(at + step, len(data)) - at) // 4, crc(data[at : at + step]))
                    for k, at in enumerate(range(0, len(data), step))
                ]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def ranked(pieces: DataFrame, counts: dict[int, int], rows: int = ROWS_PER_RANKING) -> DataFrame:
    """Adds the piece's rank among those of its length, from 0. A length with many pieces is ranked in
    parts: no task sorts much more than ``rows`` of them, equal rows neither. Parts are dealt at random and written,
    so that all later readers see the same ones."""
    spark = pieces.sparkSession
    parts = small_table(spark, [(length, ceil(n / rows)) for length, n in counts.items()], "length long, _parts long")
    parted = stored(pieces.join(parts, "length").withColumn("_part", F.floor(F.rand(7) * F.col("_parts"))), "parts")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
        .select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        parted.withColumn("_rank", F.row_number().over(own) - 1)
        .join(starts, ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_parts", "_part", "_before")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Pieces that agree in every column are told apart by their place only.
    """
    counted = bounded_rows(pieces.groupBy("length").agg(F.count("*").alias("n")), capacity, "piece lengths")
    counts = {row["length"]: row["n"] for row in counted}
    placed, _ = plan(counts, capacity)
    spark = pieces.sparkSession
    ranges = small_table(
        spark, [tuple(p) for p in placed],
        "length long, _first long, _last long, _sequence long, _offset long, _per long",
    )
    at = F.col("_rank") - F.col("_first")
    here = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    return (
        ranked(pieces, counts).join(ranges, "length").where(here)
        .withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_per")))
        .withColumn("offset", F.col("_offset") + at % F.col("_per") * F.col("length"))
        .drop("_rank", "_first", "_last", "_sequence", "_offset", "_per")
    )


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``doc_id, text`` with their places. NULL text is empty and gives a piece of the end
    id alone; a repeated or NULL doc_id is packed like any other; an empty table gives no row."""
    cut = stored(pieces(docs, path, end_id, capacity), "pieces")
    names = [c.split()[0] for c in _PIECES.split(", ")]
    return pack(cut, capacity).select(*names, "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
