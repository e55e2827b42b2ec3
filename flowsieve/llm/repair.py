"""Re-Pair grammar compression of token ids, one grammar per shard.

Frequent neighbouring id pairs become nonterminals, round after round, until no pair occurs
``MIN_COUNT`` times; a round replaces the most frequent pairs of the moment together, left to right.
A shard file holds the rules, the length each rule expands to, the compressed sequence, an index of
its documents and the place of every ``MARK_STEP``-th symbol among the ids, so that any stretch of
ids, also within a document, is decoded without the rest.

File: ``MAGIC``, header length (unsigned 32-bit), JSON header, then little-endian arrays: doc ids
(signed 64-bit), doc id present (one byte), first id and first symbol of each document (unsigned
64-bit), rules (two unsigned 32-bit), expansion lengths (unsigned 32-bit), places (unsigned 64-bit),
symbols (``width`` bytes).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import crc, open_folder, records, scratch_folder, stored, table
from flowsieve.llm.tokens import tokenizer_path, word_encoder
from flowsieve.operators.bounds import bounded_rows, small_table

MAGIC = b"REPAIR2\n"
END_ID = 2
SHARD_IDS = 2_000_000
PAIRS_PER_ROUND = 16384  # the others wait for a later round
MIN_COUNT = 8
MARK_STEP = 64
READ_IDS = 1 << 18
DEALT_CHARS = 64
MAX_PARTS = 1_000_000
_TABLE_BITS = 17
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NO_PAIR = np.uint64(2**64 - 1)  # symbols stay below 2**32 - 1


class Grammar(NamedTuple):
    base: int  # symbols below are ids, the others rules
    rules: np.ndarray  # (n, 2) unsigned 32-bit
    lengths: np.ndarray  # ids that each rule expands to
    symbols: np.ndarray  # the compressed sequence
    starts: np.ndarray  # symbol at which each document starts


def _frequent(keys: np.ndarray, least: int) -> np.ndarray:
    """The keys that occur that often, most frequent first."""
    keys = np.sort(keys)
    if not len(keys):
        return keys
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    enough = counts >= least
    values, counts = keys[first[enough]], counts[enough]
    return values[np.lexsort((values, -counts))]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * _MIX) >> np.uint64(64 - _TABLE_BITS)


def compress(ids: np.ndarray, starts: np.ndarray, pairs: int = PAIRS_PER_ROUND, least: int = MIN_COUNT) -> Grammar:
    """Grammar of the ids; no rule spans the start of a document. Goes on until no pair occurs ``least`` times.

    Every round replaces a place at least, because the most frequent pair always has its slot. A pair of
    old symbols never becomes more frequent, so after the first round only places with a symbol of the last
    round, or with symbols that were in a frequent pair, are counted.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols = ids.astype(np.uint32)
    begins = np.zeros(len(ids) + 1, bool)
    begins[starts] = True
    begins = begins[: len(ids)]
    rules: list[np.ndarray] = []
    n_rules, newest = 0, 0
    lefts = rights = np.ones(base, bool)  # symbols that may be on that side of a frequent pair
    while len(symbols) > 1:
        places = ((lefts[symbols[:-1]] & rights[symbols[1:]]) | (symbols[:-1] >= newest) | (symbols[1:] >= newest)) & ~begins[1:]
        places = np.flatnonzero(places)
        keys = (symbols[places].astype(np.uint64) << np.uint64(32)) | symbols[places + 1]
        frequent = _frequent(keys, least)
        chosen = frequent[:pairs]
        held = np.full(1 << _TABLE_BITS, _NO_PAIR)
        number = np.zeros(1 << _TABLE_BITS, np.uint32)
        slots = _slots(chosen)
        _, first = np.unique(slots, return_index=True)  # the more frequent pair keeps a shared slot
        chosen, slots = chosen[np.sort(first)], slots[np.sort(first)]
        held[slots] = chosen
        number[slots] = np.arange(len(chosen), dtype=np.uint32)
        slots = _slots(keys)
        hit = held[slots] == keys
        at, slots = places[hit], slots[hit]
        if not len(at):
            break
        run = np.concatenate(([True], np.diff(at) != 1))  # neighbouring places overlap: every other one
        order = np.arange(len(at))
        taken = (order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0
        at, pair = at[taken], number[slots[taken]]
        used = np.bincount(pair, minlength=len(chosen)) > 0  # overlaps may have taken all places of a pair
        rules.append(np.stack([chosen[used] >> np.uint64(32), chosen[used] & np.uint64(2**32 - 1)], 1).astype(np.uint32))
        newest = base + n_rules
        symbols[at] = (np.cumsum(used) - 1 + newest).astype(np.uint32)[pair]
        n_rules += int(used.sum())
        lefts, rights = np.zeros(base + n_rules, bool), np.zeros(base + n_rules, bool)
        lefts[frequent >> np.uint64(32)] = True
        rights[frequent & np.uint64(2**32 - 1)] = True
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, begins = symbols[keep], begins[keep]
    table_ = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    lengths = np.ones(base + len(table_), np.uint32)
    done = base
    for block in rules:  # a round's rules refer to earlier rounds only
        lengths[done : done + len(block)] = lengths[block].sum(1)
        done += len(block)
    # documents start at the symbols marked as beginnings; empty ones share the next one's place
    cover = np.concatenate(([0], np.cumsum(lengths[symbols].astype(np.int64))))
    return Grammar(base, table_, lengths[base:], symbols, np.searchsorted(cover, starts))


def expansions(base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all symbols one after another, and where each symbol's begin."""
    flat = np.arange(base + len(rules), dtype=np.uint32)
    while (big := flat >= base).any():
        sizes = np.where(big, 2, 1)
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[at] = np.where(big, rules[np.where(big, flat - base, 0), 0] if len(rules) else flat, flat)
        out[at[big] + 1] = rules[flat[big] - base, 1]
        flat = out
    size = np.concatenate((np.ones(base, np.int64), lengths.astype(np.int64)))
    return flat, np.cumsum(size) - size


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file's bytes."""
    g = compress(ids, starts)
    top = g.base + len(g.rules)
    width = 1 + (top > 1 << 8) + (top > 1 << 16) + (top > 1 << 24)
    header = json.dumps(
        {"base": g.base, "docs": len(doc_ids), "ids": len(ids), "rules": len(g.rules), "step": MARK_STEP, "symbols": len(g.symbols), "width": width}
    ).encode()
    symbols = g.symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    sizes = np.concatenate((np.ones(g.base, np.int64), g.lengths.astype(np.int64)))[g.symbols]
    marks = (np.cumsum(sizes) - sizes)[::MARK_STEP]
    return b"".join(
        (
            MAGIC,
            np.uint32(len(header)).astype("<u4").tobytes(),
            header,
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            starts.astype("<u8").tobytes(),
            g.starts.astype("<u8").tobytes(),
            g.rules.astype("<u4").tobytes(),
            g.lengths.astype("<u4").tobytes(),
            marks.astype("<u8").tobytes(),
            symbols.tobytes(),
        )
    )


class Shard:
    """A shard file, decoded on demand; the rules are expanded once, when the first ids are read."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        self._data, self._at = memoryview(data), len(MAGIC)
        size = int(self._take("<u4", 1)[0])
        h = json.loads(bytes(self._data[self._at : self._at + size]))
        self._at += size
        self.base, self.n_ids, self.step = h["base"], h["ids"], h["step"]
        ids, present = self._take("<i8", h["docs"]), self._take(np.uint8, h["docs"])
        self.doc_ids = [int(d) if p else None for d, p in zip(ids, present)]
        self.starts = np.append(self._take("<u8", h["docs"]).astype(np.int64), self.n_ids)
        self.symbol_starts = np.append(self._take("<u8", h["docs"]).astype(np.int64), h["symbols"])
        self.rules = self._take("<u4", 2 * h["rules"]).reshape(-1, 2)
        self.lengths = self._take("<u4", h["rules"])
        self.marks = self._take("<u8", -(-h["symbols"] // self.step)).astype(np.int64)
        raw = self._take(np.uint8, h["symbols"] * h["width"]).reshape(-1, h["width"])
        wide = np.zeros((h["symbols"], 4), np.uint8)
        wide[:, : h["width"]] = raw
        self.symbols = wide.reshape(-1).view("<u4")
        self.size = np.concatenate((np.ones(self.base, np.int64), self.lengths.astype(np.int64)))

    def _take(self, kind: object, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    @cached_property
    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        return expansions(self.base, self.rules, self.lengths)

    def doc(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop of the shard. Only the symbols between the marks around them are looked at,
        and of a symbol that reaches beyond only the part inside is decoded."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.marks, start, "right")) - 1
        symbols = self.symbols[first * self.step : int(np.searchsorted(self.marks, stop, "left")) * self.step]
        ends = self.marks[first] + self.size[symbols].cumsum()
        some = slice(int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1)
        symbols, ends = symbols[some], ends[some]
        begins = ends - self.size[symbols]
        skipped = np.maximum(start - begins, 0)
        sizes = np.minimum(ends, stop) - begins - skipped
        flat, at = self._expanded
        after = sizes.cumsum()
        return flat[np.repeat(at[symbols] + skipped - (after - sizes), sizes) + np.arange(stop - start)]

    def stretches(self, ids: int = READ_IDS) -> Iterator[tuple[int, np.ndarray]]:
        """Stretches of about that many ids one after another, and where each begins."""
        for start in range(0, self.n_ids, ids):
            yield start, self.read(start, start + ids)

    def all(self) -> np.ndarray:
        return self.read(0, self.n_ids)


_MANIFEST = "part int, shard int, path string, n_docs long, n_ids long, ids_before long, n_bytes long"
_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes ``doc_id, text`` in ascending doc_id order into shard files; one row per file.

    A task writes its range of documents as files of about ``shard_ids`` ids. A file that a lost task
    left behind is in no row. NULL ids come first, NULL text is empty, documents with the same id lie
    in the order of their texts. Very long texts are not cut and make a longer shard.
    """
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, place = open_folder(folder)
        encoder, part = word_encoder(path), TaskContext.get().partitionId()
        done: list[tuple] = []
        doc_ids: list[int | None] = []
        data: list[bytes] = []
        held = before = 0

        def flush() -> None:
            nonlocal held, before, doc_ids, data
            sizes = np.array([len(d) // 4 for d in data], np.int64)
            packed = pack(doc_ids, sizes.cumsum() - sizes, np.frombuffer(b"".join(data), "<u4"))
            name = f"part-{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.rp"
            with system.open_output_stream(f"{place}/{name}") as out:
                out.write(packed)
            done.append((part, len(done), name, len(doc_ids), int(held), int(before), len(packed)))
            before += held
            doc_ids, data, held = [], [], 0

        for batch in batches:
            for doc_id, text in records(batch, "doc_id", "text"):
                data.append(encoder.encode(text) + end)
                doc_ids.append(doc_id)
                held += len(data[-1]) // 4
                if held >= shard_ids:
                    flush()
        if doc_ids:
            flush()
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            names = [c.split()[0] for c in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    # rows of one id (NULL above all) are dealt by the first characters of their texts, too: the same order as whole texts
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, DEALT_CHARS)).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, _MANIFEST), "shards")


def checksums(shard: Shard, ids: int = READ_IDS) -> list[int]:
    """crc32 of each document's ids, read stretch by stretch: a shard with one very long document isn't decoded whole."""
    out = [0] * len(shard.doc_ids)
    starts = shard.starts.tolist()
    doc = 0
    for start, stretch in shard.stretches(ids):
        data, stop = memoryview(stretch.astype("<u4")).cast("B"), start + len(stretch)
        while doc < len(out):
            a, b = max(starts[doc], start), min(starts[doc + 1], stop)
            out[doc] = crc(data[4 * (a - start) : 4 * (b - start)], out[doc])
            if starts[doc + 1] > stop:
                break
            doc += 1
    return out


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: its place among all ids, their number and checksum."""
    spark = manifest.sparkSession
    totals = bounded_rows(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")), MAX_PARTS, "parts")
    offsets, so_far = [], 0
    for row in sorted(totals, key=lambda r: r["part"]):  # parts are ranges of doc_id in ascending order
        offsets.append((row["part"], so_far))
        so_far += row["n"]
    placed = manifest.join(small_table(spark, offsets, "part int, part_start long"), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(folder)
        for batch in batches:
            for name, part_start, before in records(batch, "path", "part_start", "ids_before"):
                with system.open_input_stream(f"{place}/{name}") as file:
                    shard = Shard(file.read())
                starts = shard.starts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts[:-1] + (part_start + before), pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(checksums(shard), pa.int64()),
                    ],
                    names=[c.split()[0] for c in _DIGEST.split(", ")],
                )

    tasks = min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)
    return placed.select("path", "part_start", "ids_before").repartition(max(tasks, 1)).mapInArrow(read, _DIGEST)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as Re-Pair shard files, read back: doc_id, start, n_tokens, ids_crc32.

    An empty table gives no file and no row; see ``write_shards`` for NULLs and ties.
    """
    folder = scratch_folder(spark, "repair")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_shards(manifest, folder)
