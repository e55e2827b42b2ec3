"""Benchmark items inside training documents.

The items are a BM25 inverted index; impacts are divided by the item's score for its own words, so
that one threshold holds for all. Every passage of every document is a query. Upper bounds of blocks
of items, added up for many passages at a time, leave few passages; block-max WAND over their words
returns all items above the threshold. An item counts as leaked when the passage holds its five-word
shingles; how much of its question and of its answer (the last sentence) is there is reported.

The index is broadcast; the number of items and words is checked first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import records, table
from flowsieve.llm.licenses import normal
from flowsieve.operators.bounds import bounded_rows

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of an item's own score
OVERLAP = 0.8
SHINGLE = 5
LEAST_STRIDE = 32
GROUP_WORDS = 1 << 16
BOUND_BLOCKS = 256
POSTING_BLOCK = 16
MAX_ITEMS = 100_000
MAX_WORDS = 20_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


class Item(NamedTuple):
    item_id: int | None
    words: list[bytes]
    question: list[bytes]
    answer: list[bytes]


class Leak(NamedTuple):
    item_id: int | None
    first_word: int
    score: float
    overlap: float
    question_overlap: float
    answer_overlap: float


def words_of(text: str | None) -> list[bytes]:
    return normal(text)[0].split()


def parse_item(item_id: int | None, text: str) -> Item:
    """Question and answer: all sentences but the last, and the last; one sentence is all question."""
    parts = [p for p in _SENTENCE.split(text.strip()) if words_of(p)]
    question = parts if len(parts) < 2 else parts[:-1]
    answer = parts[-1] if len(parts) > 1 else ""
    return Item(item_id, words_of(text), words_of(" ".join(question)), words_of(answer))


def shingles(words: list[bytes]) -> set[bytes]:
    """Runs of five words; a shorter sequence is one run."""
    if len(words) <= SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def held(words: list[bytes], passage: set[bytes], line: bytes) -> float:
    """Share of the words' shingles in the passage; 1 for none."""
    own = shingles(words)
    if len(words) < SHINGLE:
        return float(not own or b" " + b" ".join(words) + b" " in line)
    return sum(s in passage for s in own) / len(own)


class Postings(NamedTuple):
    items: list[int]  # ascending
    impacts: list[float]
    most: float
    block_most: list[float]  # of each POSTING_BLOCK postings


class Index:
    """BM25 impacts of items by term, with the upper bounds that skip them."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]], threshold: float = THRESHOLD) -> None:
        self.items = [item for i, t in items if t and (item := parse_item(i, t)).words]
        self.threshold = threshold
        self.stride = max([LEAST_STRIDE, *(len(item.words) for item in self.items)])
        n = len(self.items)
        mean = sum(len(item.words) for item in self.items) / n if n else 1.0
        df = Counter(w for item in self.items for w in set(item.words))
        self.terms = {w: k for k, w in enumerate(sorted(df))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for number, item in enumerate(self.items):
            flat = K1 * (1 - B + B * len(item.words) / mean)
            impact = {w: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + flat) for w, tf in Counter(item.words).items()}
            own = sum(impact.values())
            for w, value in impact.items():
                lists[self.terms[w]].append((number, value / own))
        self.postings = []
        for one in lists:
            impacts = [v for _, v in one]
            cut = [max(impacts[k : k + POSTING_BLOCK]) for k in range(0, len(impacts), POSTING_BLOCK)]
            self.postings.append(Postings([i for i, _ in one], impacts, max(impacts), cut))
        size = max(ceil(n / BOUND_BLOCKS), 1)
        self.bounds = np.zeros((len(lists), ceil(n / size) if n else 1), np.float32)
        for k, one in enumerate(lists):
            for number, value in one:
                self.bounds[k, number // size] = max(self.bounds[k, number // size], value)

    def search(self, terms: Iterable[int]) -> list[tuple[int, float]]:
        """All items that the terms score at the threshold or above, by block-max WAND."""
        least = self.threshold - 1e-9
        cursors = [[self.postings[t].items[0], 0, self.postings[t]] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, (_, _, p) in enumerate(cursors):
                total += p.most
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, after = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items)
            for _, at, p in cursors[: pivot + 1]:
                block = at // POSTING_BLOCK
                while (block + 1) * POSTING_BLOCK <= len(p.items) and p.items[(block + 1) * POSTING_BLOCK - 1] < item:
                    block += 1
                if block < len(p.block_most):
                    bound += p.block_most[block]
                    last = min((block + 1) * POSTING_BLOCK, len(p.items)) - 1
                    after = min(after, p.items[last] + 1)
            if bound < least:  # nothing before the next block boundary can do it
                goal = max(after, item + 1)
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(p.impacts[at] for _, at, p in cursors[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                goal, moved = item + 1, cursors[: pivot + 1]
            else:
                goal, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                at, p = c[1], c[2]
                while at < len(p.items) and p.items[at] < goal:
                    at += 1
                c[1], c[0] = at, p.items[at] if at < len(p.items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def verify(self, number: int, passage: list[bytes], runs: set[bytes], line: bytes) -> tuple[float, float, float]:
        item = self.items[number]
        return held(item.words, runs, line), held(item.question, runs, line), held(item.answer, runs, line)

    def _crowded(self, texts: list[np.ndarray]) -> list[list[int]]:
        """Passages of each text (by stretch) whose bounds reach the threshold for some block of items."""
        sizes = np.array([max(ceil(len(t) / self.stride), 1) for t in texts])
        first = sizes.cumsum() - sizes
        stretch = np.concatenate([f + np.arange(len(t)) // self.stride for f, t in zip(first, texts)])
        ids = np.concatenate(texts)
        known = ids >= 0
        stretch, ids = stretch[known], ids[known]
        after = ~np.isin(stretch, first)  # a stretch ends the passage that the one before begins
        keys = np.unique(np.concatenate([stretch, stretch[after] - 1]) * len(self.terms) + np.concatenate([ids, ids[after]]))
        sums = np.zeros((int(sizes.sum()), self.bounds.shape[1]), np.float32)
        if len(keys):
            owner = keys // len(self.terms)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sums[owner[starts]] = np.add.reduceat(self.bounds[keys % len(self.terms)], starts, axis=0)
        reached = sums.max(1) >= self.threshold - 1e-3
        return [np.flatnonzero(reached[f : f + s]).tolist() for f, s in zip(first, sizes)]

    def leaks(self, texts: Iterable[str | None]) -> Iterator[list[Leak]]:
        """Leaked items of each text in turn, each once, from the passage that holds most of it."""
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            group.append(words_of(text))
            size += len(group[-1])
            if size >= GROUP_WORDS:
                yield from self._leaks(group)
                group, size = [], 0
        yield from self._leaks(group)

    def _leaks(self, group: list[list[bytes]]) -> Iterator[list[Leak]]:
        if not group:
            return
        if not self.items:
            yield from ([] for _ in group)
            return
        ids = [np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words)) for words in group]
        for words, terms, crowded in zip(group, ids, self._crowded(ids)):
            best: dict[int, Leak] = {}
            for stretch in crowded:
                at = stretch * self.stride
                here = terms[at : at + 2 * self.stride]
                found = self.search(np.unique(here[here >= 0]).tolist())
                if not found:
                    continue
                passage = words[at : at + 2 * self.stride]
                runs, line = shingles(passage), b" " + b" ".join(passage) + b" "
                for number, score in found:
                    overlap, question, answer = self.verify(number, passage, runs, line)
                    if overlap >= OVERLAP and (number not in best or overlap > best[number].overlap):
                        best[number] = Leak(self.items[number].item_id, at, score, overlap, question, answer)
            yield [best[k] for k in sorted(best)]


def build_index(items: DataFrame, threshold: float = THRESHOLD) -> Index:
    """Index of ``item_id, text``; more than ``MAX_ITEMS`` items or ``MAX_WORDS`` words are an error.
    Items without a word are left out."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > 2 * MAX_WORDS:
        raise ValueError("benchmark: too much text to broadcast")
    rows = bounded_rows(items.select("item_id", "text"), MAX_ITEMS, "benchmark")
    return Index(((r["item_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))), threshold)


_FIELDS = (
    ("doc_id", T.LongType(), pa.int64()), ("item_id", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("score", T.DoubleType(), pa.float64()),
    ("overlap", T.DoubleType(), pa.float64()), ("question_overlap", T.DoubleType(), pa.float64()), ("answer_overlap", T.DoubleType(), pa.float64()),
)


def find_leaks(docs: DataFrame, index: Index) -> DataFrame:
    """One row for each ``doc_id, text`` and item that it holds: the passage's first word, the score as a
    share of the item's own, and the shares of shingles found. Repeated rows are searched each."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = (t for (t,) in records(batch, "text"))
            rows = [(doc_id, *leak) for doc_id, leaks in zip(ids, shared.value.leaks(texts)) for leak in leaks]
            columns = list(zip(*rows)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, _, k) in zip(columns, _FIELDS)], names=[n for n, *_ in _FIELDS])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k, _ in _FIELDS]))


def without_leaks(docs: DataFrame, index: Index) -> DataFrame:
    """The rows of docs that hold no item."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t for (t,) in records(batch, "text"))
            yield batch.filter(pa.array([not leaks for leaks in shared.value.leaks(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` in all ``documents``; NULL and empty texts hold none."""
    return find_leaks(table(spark, sf_dir, "documents"), build_index(table(spark, sf_dir, "benchmark")))
