"""Repeated 20-word windows, by suffix trees that are split by prefix.

Only suffixes that can repeat take part. Each window names an anchor: the place of the smallest code
among its 8-word runs. Equal windows name it at the same offset, so suffixes need to start at
anchors only, and an anchor whose 8 words occur once in the corpus is dropped. The others are
dealt into groups by their first 8 words, many prefixes to a memory-sized group. A prefix with more
suffixes than a group may hold is made longer: its windows are dealt by all of their 20 words, and
equal ones of a batch are merged before they are sent.

In a group the subtree is built from the root down, one word of depth at a time, for all suffixes
together, and likewise the tree of the words to the left of the anchors. A node with two suffixes
or more that lies, left and right together, 20 words deep is a repeated window; all of its
occurrences but the first are reported. Copies of a whole document are set aside beforehand.

Words are told apart by 64-bit codes. NULL and empty texts have no words; texts of any length are read whole; an
empty table gives no row; other columns pass through (``without_repeats``) or aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import SPACES, codes_of, dropped, gram_codes, mixed, records, slices, stored, table, unused_name

WINDOW = 20
GRAM = 8
SPAN = WINDOW - GRAM + 1
LEFT = SPAN - 1  # words that a window may have left of its anchor
GROUP_SUFFIXES = 20_000
SLICE = 1 << 13  # suffixes that are packed together
ROW_BYTES = 1 << 14  # most that a row of packed suffixes holds: the engine hands rows on by the thousand
NO_ID = 2**63 - 1

_SUFFIX = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("at", "<i4"), ("low", "i1"), ("high", "i1"), ("words", "<u8", (LEFT + WINDOW,))])
_WHOLE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i4")])


def _tag(words: list[bytes]) -> tuple[str, int]:
    """Digest of the words, and its first 64 bits: with the id, what tells documents apart."""
    found = hashlib.sha256(b" ".join(words))
    return found.hexdigest(), int.from_bytes(found.digest()[:8], "big", signed=True)


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 8-word runs, and the anchor's place of each 20-word window."""
    grams = gram_codes(codes, GRAM)
    if len(codes) < WINDOW:
        return grams, np.zeros(0, np.int64)
    return grams, np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(1) + np.arange(len(codes) - WINDOW + 1)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _read(docs: DataFrame) -> DataFrame:
    """Per row: order of the document, digest, and its distinct anchors with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, shas, values, places = [], [], [], [], []
            deals = batch.column(batch.schema.get_field_index("deal"))
            for doc, text in records(batch, "doc", "text"):
                words = (text or "").encode().split()
                sha, tag = _tag(words)
                grams, at = anchors(codes_of(words)) if len(words) >= WINDOW else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                at = np.unique(at)
                ids.append(doc)
                tags.append(tag)
                shas.append(sha)
                values.append(grams[at].view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), deals, pa.array(tags, pa.int64()), pa.array(shas, pa.string()), _lists(values, pa.int64()), _lists(places, pa.int32())],
                names=["doc", "deal", "tag", "sha", "anchors", "places"],
            )

    return docs.mapInArrow(run, "doc long, deal long, tag long, sha string, anchors array<long>, places array<int>")


def _suffixes(found: DataFrame, parts: int) -> DataFrame:
    """Packed suffixes by group, from ``doc, text`` and the tags, places and hot marks of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, text, hits in records(batch, "doc", "text", "hits", rows=64):
                for kind, keys, rows in _of_document(doc, text.encode().split(), hits):
                    held.append((kind, keys, rows))
                    n += len(rows)
                    if n >= SLICE:
                        yield _packed(held, parts)
                        held, n = [], 0
        yield _packed(held, parts)

    return found.mapInArrow(run, "part int, kind int, data binary")


def _of_document(doc: int, words: list[bytes], hits: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, keys and rows of a document's suffixes (0) and whole windows (1), a slice at a time."""
    tag = _tag(words)[1]
    mine = [h for h in hits if h["tag"] == tag]
    if not mine:
        return  # another text of the same id
    codes = codes_of(words)
    grams, at = anchors(codes)
    where = np.array([p for h in mine for p in h["places"]], np.int64)
    hot = np.array([x for h in mine for x in h["hot"]], bool)
    first, last = np.searchsorted(at, where, "left"), np.searchsorted(at, where, "right") - 1
    padded = np.zeros(len(codes) + LEFT + WINDOW, np.uint64)
    padded[LEFT : LEFT + len(codes)] = codes
    cold = np.flatnonzero(~hot)
    for a in range(0, len(cold), SLICE):
        some = cold[a : a + SLICE]
        here = where[some]
        rows = np.zeros(len(some), _SUFFIX)
        rows["doc"], rows["tag"], rows["at"] = doc, tag, here
        rows["low"], rows["high"] = here - last[some], here - first[some]
        rows["words"] = padded[here[:, None] + np.arange(LEFT + WINDOW)]
        yield 0, grams[here], rows
    if hot.any():
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[hot], last[hot])])
        rows = np.zeros(len(starts), _WHOLE)
        rows["a"] = gram_codes(codes, WINDOW)[starts]
        rows["b"] = gram_codes(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5), WINDOW)[starts]
        rows["doc"], rows["tag"], rows["at"] = doc, tag, starts
        yield 1, rows["a"], rows


def _packed(held: list[tuple[int, np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    out: list[tuple[int, int, bytes]] = []
    near = [h for h in held if h[0] == 0]
    whole = [h[2] for h in held if h[0] == 1]
    if near:
        out += _by_part(np.concatenate([h[2] for h in near]), np.concatenate([h[1] for h in near]), parts, 0)
    if whole:
        first_of, again = _firsts(np.concatenate(whole))
        out += _by_part(first_of, first_of["a"], parts, 1)
        out += _by_part(again, mixed(again["doc"].view(np.uint64)), parts, 2)  # they meet nobody
    columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int32(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "data"])


def _by_part(rows: np.ndarray, keys: np.ndarray, parts: int, kind: int) -> list[tuple[int, int, bytes]]:
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(0, int)
    most = ROW_BYTES // rows.itemsize
    return [(int(part[a]), kind, rows[x : min(x + most, b)].tobytes()) for a, b in zip(cuts.tolist(), cuts[1:].tolist()) for x in range(a, b, most)]


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each whole window, and the others."""
    rows = np.unique(rows)  # by code, then document and place; repeated rows of a table count once
    new = np.concatenate(([True], (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])))
    return rows[new], rows[~new]


def _refined(node: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Nodes one word deeper."""
    number = np.unique(words, return_inverse=True)[1]
    return np.unique(node * (int(number.max(initial=0)) + 1) + number, return_inverse=True)[1]


def repeats(rows: np.ndarray) -> np.ndarray:
    """``doc, tag, at`` of every window of these suffixes that stands elsewhere before."""
    rows = rows[np.lexsort((rows["at"], rows["tag"], rows["doc"]))]
    same = (rows["doc"][1:] == rows["doc"][:-1]) & (rows["tag"][1:] == rows["tag"][:-1]) & (rows["at"][1:] == rows["at"][:-1])
    rows = rows[np.concatenate(([True], ~same))] if len(rows) else rows
    node = np.zeros(len(rows), np.int64)
    for depth in range(GRAM):  # a node with one suffix is a leaf: nothing below repeats
        node = _refined(node, rows["words"][:, LEFT + depth])
        inner = np.bincount(node)[node] > 1
        rows, node = rows[inner], node[inner]
    right, left = {GRAM: node}, {0: np.zeros(len(rows), np.int64)}
    for depth in range(GRAM, WINDOW):
        right[depth + 1] = _refined(right[depth], rows["words"][:, LEFT + depth])
    for depth in range(LEFT):
        left[depth + 1] = _refined(left[depth], rows["words"][:, LEFT - 1 - depth])
    found = [np.zeros(0, _WHOLE)]
    for before in range(LEFT + 1):
        here = np.flatnonzero((rows["low"] <= before) & (before <= rows["high"]))
        if len(here) < 2:
            continue
        node = _refined(right[WINDOW - before][here], left[before][here])
        first = np.full(int(node.max()) + 1, len(here))
        np.minimum.at(first, node, np.arange(len(here)))  # rows are in document order
        again = here[first[node] != np.arange(len(here))]
        out = np.zeros(len(again), _WHOLE)
        out["doc"], out["tag"], out["at"] = rows["doc"][again], rows["tag"][again], rows["at"][again] - before
        found.append(out)
    return np.concatenate(found)


def _repeated(packed: DataFrame, parts: int) -> DataFrame:
    """``doc, tag, starts`` of the windows that stand elsewhere before; several rows for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((part, kind, data) for batch in batches for part, kind, data in records(batch, "part", "kind", "data"))
        for _, group in groupby(rows, key=lambda r: r[0]):
            data: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
            for _, kind, packed_rows in group:
                data[kind].append(packed_rows)
            found = [repeats(np.frombuffer(b"".join(data[0]), _SUFFIX))] if data[0] else []
            if data[1]:
                found.append(_firsts(np.frombuffer(b"".join(data[1]), _WHOLE))[1])
            if data[2]:
                found.append(np.frombuffer(b"".join(data[2]), _WHOLE))
            out = np.concatenate(found)
            out = out[np.lexsort((out["at"], out["tag"], out["doc"]))]
            new = np.flatnonzero(np.concatenate(([True], (out["doc"][1:] != out["doc"][:-1]) | (out["tag"][1:] != out["tag"][:-1])))) if len(out) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc"][new]), pa.array(out["tag"][new]), _lists(np.split(out["at"], new[1:]) if len(out) else [], pa.int32())],
                names=["doc", "tag", "starts"],
            )

    spark = packed.sparkSession
    tasks = min(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    placed = packed.repartition(tasks, "part").sortWithinPartitions("part")
    return placed.mapInArrow(run, "doc long, tag long, starts array<int>")


def repeated_windows(docs: DataFrame, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``doc, deal, marks``: for each document with something to remove its tag, the starts of its windows that stand
    earlier, and whether the whole of it does. ``docs`` has ``doc``, ``deal`` (see ``_deal``) and ``text``."""
    read = stored(_read(docs), "anchors")
    own = stored(
        read.groupBy("sha").agg(
            F.min(F.struct("doc", "tag", "deal")).alias("d"), F.first("anchors").alias("anchors"), F.first("places").alias("places")
        ).select("sha", "d.*", "anchors", "places"),
        "originals",
    )
    copies = read.select("doc", "tag", "sha").join(own.select("sha", F.col("doc").alias("first")), "sha").where("doc <> first")
    copies = stored(copies.select("doc", "tag").distinct(), "copies")
    without_id = F.col("doc") == NO_ID
    deals = stored(read.where(without_id).select(F.col("tag").alias("own"), "deal").distinct(), "deals")
    dropped(read)
    places = own.select("doc", "tag", "deal", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select(
        "doc", "tag", "deal", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place")
    )
    # written: only a join of two plain exchanges lets the engine split a crowded anchor over tasks
    again = stored(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    hits = places.join(again, "anchor").groupBy("doc", "tag", "deal").agg(
        F.collect_list(F.struct("place", (F.col("n") > group_suffixes).alias("hot"))).alias("h")  # one document's
    )
    hits = stored(hits.select("doc", "deal", F.struct("tag", F.col("h.place").alias("places"), F.col("h.hot").alias("hot")).alias("h")), "hits")
    dropped(own, again)
    n = hits.agg(F.sum(F.size("h.places"))).first()[0] or 0
    parts = max(ceil(n / group_suffixes), docs.sparkSession.sparkContext.defaultParallelism)
    texts = docs.join(hits.groupBy("doc", "deal").agg(F.collect_list("h").alias("hits")), ["doc", "deal"]).select("doc", "text", "hits")
    windows = _repeated(_suffixes(texts, parts), parts)
    marks = windows.select("doc", "tag", "starts", F.lit(False).alias("copy")).unionByName(
        copies.select("doc", "tag", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    )
    by_text = marks.withColumn("own", F.when(without_id, F.col("tag")).otherwise(0)).groupBy("doc", "own")
    found = stored(by_text.agg(F.collect_list(F.struct("tag", "starts", "copy")).alias("marks")), "marks")
    dropped(hits, copies)
    return found.where(~without_id).select("doc", F.lit(0).cast("long").alias("deal"), "marks").unionByName(
        found.where(without_id).join(deals, "own").select("doc", "deal", "marks")
    )


def _deal() -> Column:
    """Rows without an id have one place in the order; this deals them by their words. 0 for all others."""
    words = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACES}]+", " "), F.lit(" "))
    return F.when(F.col("doc_id").isNull(), F.xxhash64(words)).otherwise(F.lit(0).cast("long"))


def kept_words(words: list[bytes], marks: list[dict]) -> list[bytes]:
    """The words that no marked window covers."""
    tag = _tag(words)[1]
    mine = [m for m in marks if m["tag"] == tag]
    if len(words) < WINDOW or not mine:
        return words
    if any(m["copy"] for m in mine):
        return []
    starts = np.concatenate([np.array(m["starts"], np.int64) for m in mine])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return [w for w, c in zip(words, covered.tolist()) if not c]


def _with_marks(docs: DataFrame, group_suffixes: int) -> tuple[DataFrame, str]:
    """The rows with the marks of their document (NULL: none) in a column of that name."""
    order, deal, name = unused_name(docs, "_doc"), unused_name(docs, "_deal"), unused_name(docs, "_marks")
    keyed = docs.withColumn(order, F.coalesce("doc_id", F.lit(NO_ID))).withColumn(deal, _deal())
    found = repeated_windows(keyed.select(F.col(order).alias("doc"), F.col(deal).alias("deal"), "text"), group_suffixes)
    marks = found.select(F.col("doc").alias(order), F.col("deal").alias(deal), F.col("marks").alias(name))
    return keyed.join(marks, [order, deal], "left").drop(order, deal), name


def without_repeats(docs: DataFrame, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """docs with the repeated windows taken out of ``text``, and ``n_chars`` (if there) adjusted.

    A changed text is its kept words with one space between; texts without a repeat stay as they are. Rows
    stay, a copy with an empty text. Documents are ordered by id, NULL last, then by digest; repeated rows of
    one id and text count as one document.
    """
    marked, name = _with_marks(docs, group_suffixes)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts, sizes = [], []
            for text, marks in records(batch, "text", name):
                if text is not None and marks:
                    words = text.encode().split()
                    kept = kept_words(words, marks)
                    text = text if len(kept) == len(words) else b" ".join(kept).decode()
                texts.append(text)
                sizes.append(len(text or ""))
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in schema.names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                known = columns["n_chars"].is_valid().to_pylist()
                columns["n_chars"] = pa.array([s if k else None for s, k in zip(sizes, known)], kind)
            yield pa.RecordBatch.from_arrays([*columns.values()], names=schema.names)

    return marked.mapInArrow(run, schema)


_DIGEST = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
)


def digests(docs: DataFrame, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Words, words removed and digest of the kept ones of each row; see ``without_repeats``."""
    marked, name = _with_marks(docs.select("doc_id", "text"), group_suffixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, marks in records(batch, "doc_id", "text", name):
                words = (text or "").encode().split()
                kept = kept_words(words, marks) if marks else words
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], names=_DIGEST.names)

    return marked.mapInArrow(run, _DIGEST)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; an empty table gives no row."""
    return digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY sha256(array_to_string(words[i:i+19], ' ')) ORDER BY doc_id, i) AS r FROM s),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM k WHERE r > 1),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
g AS (SELECT doc_id, count(*) AS n, array_to_string(list(word ORDER BY p), ' ') AS kept FROM u ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
