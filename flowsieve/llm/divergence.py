"""How far the sources of a language differ in their words, recounted through minimal perfect hashes.

The first pass counts documents by term and keeps the frequent ones, exactly. The kept terms of a language are
dealt into shards of bounded size; a task builds each shard's perfect hash, which gives every key a slot of its
own, and stores the keys in slot order. The second pass gets the shards by broadcast, as many at a time as fit a
fixed number of bytes, looks the distinct words of some texts up at once, compares each with the key stored in its
slot, and adds their counts to one dense row of slots for every (language, source). Cells are summed by Spark;
distances of two sources are sums over blocks of slots, and a block meets the sources of one tile pair only.

NULL text, language and source count as ''. Whole texts are read, a few megabytes at a time; repeated rows are
documents of their own; ties rank by term or source; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import pickle
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import codes_of, mixed, stored, table

MIN_DOCUMENTS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Keys of a shard, at about.
SHARD_KEYS = 1 << 16
#: Bytes of shards broadcast at a time; a larger vocabulary takes another pass for each.
ROUND_BYTES = 64 << 20
#: Terms a task counts, and slots it holds, before it passes them on.
HELD_TERMS, HELD_SLOTS = 300_000, 1 << 22
#: Bytes of text looked up together.
SLICE_BYTES = 4 << 20
BLOCK_SLOTS = 1 << 12
#: Sources of one language that meet in a block at a time, squared.
TILE = 128
_LETTERS = string.ascii_letters.encode()
#: Fixed by the contract: a term is a run of ASCII letters and of everything beyond ASCII.
_TO_TERMS = bytes(b if b >= 128 or b in _LETTERS else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """The terms in order, A-Z lower-cased (UTF-8)."""
    return (text or b"").translate(_TO_TERMS).split()


class PerfectHash:
    """A slot of its own, below their number, for every key.

    Keys alone at their place of a level's bit array take it, the others go to the next level; a key's slot is the
    rank of its bit. Keys whose 64-bit codes agree never part and are kept by name. ``find`` compares with the
    stored keys, so a foreign word is never taken for a key.
    """

    LEVELS = 32

    def __init__(self, keys: list[bytes]) -> None:
        codes = codes_of(keys)
        left = np.arange(len(keys))
        self.sizes_of_levels: list[int] = []
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        order, taken = [], 0
        while len(left) and len(self.bits) < self.LEVELS:
            size = 2 * len(left) + 64
            place = self._place(codes[left], len(self.bits), size)
            here, first, times = np.unique(place, return_index=True, return_counts=True)
            alone = here[times == 1]
            bits = np.zeros(size, bool)
            bits[alone] = True
            packed = np.packbits(bits)
            counts = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
            self.sizes_of_levels.append(size)
            self.bits.append(packed)
            self.ranks.append((taken + counts - np.bitwise_count(packed)).astype(np.int64))
            order.append(left[first[times == 1]])
            taken += len(alone)
            left = np.delete(left, first[times == 1])
        self.rest = {keys[k]: taken + i for i, k in enumerate(left.tolist())}
        order.append(left)
        self.keys = [keys[k] for k in np.concatenate(order).tolist()] if keys else []
        sizes = np.fromiter(map(len, self.keys), np.int64, len(self.keys))
        self.ends = sizes.cumsum()
        self.sizes = sizes
        self.text = np.frombuffer(b"".join(self.keys), np.uint8)

    @staticmethod
    def _place(codes: np.ndarray, level: int, size: int) -> np.ndarray:
        salted = mixed(codes ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return (salted % np.uint64(size)).astype(np.int64)

    def to_bytes(self) -> bytes:
        parts = {k: v for k, v in self.__dict__.items() if k != "keys"}
        return pickle.dumps(parts, protocol=5)

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        made = object.__new__(cls)
        made.__dict__ = pickle.loads(data)
        return made

    def find(self, words: list[bytes], codes: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for words that are no key."""
        slots = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, packed in enumerate(self.bits):
            place = self._place(codes[left], level, self.sizes_of_levels[level])
            byte, bit = place >> 3, (7 - (place & 7)).astype(np.uint16)
            value = packed[byte].astype(np.uint16)
            hit = (value >> bit & 1).astype(bool)
            before = np.bitwise_count(value >> bit + 1)
            slots[left[hit]] = self.ranks[level][byte[hit]] + before[hit]
            left = left[~hit]
        slots = self._verified(words, slots)
        for k, word in enumerate(words) if self.rest else ():
            slots[k] = self.rest.get(word, slots[k])
        return slots

    def _verified(self, words: list[bytes], slots: np.ndarray) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        maybe = np.flatnonzero(slots >= 0)
        maybe = maybe[self.sizes[slots[maybe]] == sizes[maybe]]
        out = np.full(len(words), -1, np.int64)
        if len(maybe):
            n = sizes[maybe]
            text = np.frombuffer(b"".join(words), np.uint8)
            within = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            mine = text[np.repeat(sizes.cumsum()[maybe] - n, n) + within]
            kept = self.text[np.repeat(self.ends[slots[maybe]] - n, n) + within]
            same = np.logical_and.reduceat(mine == kept, n.cumsum() - n)
            out[maybe[same]] = slots[maybe[same]]
        return out


def _texts(docs: DataFrame) -> DataFrame:
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*named, F.col("text").cast("binary").alias("text"))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def document_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, documents``: of every term, the documents of the language that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, mine in counts.items():
                found = [pa.array(list(mine), pa.binary()).cast(pa.string()), pa.array(list(mine.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), *found], names=["lang", "term", "n"])
            counts.clear()

        for k, (lang, text) in enumerate(_rows(batches, "lang", "text")):
            counts[lang].update(set(terms(text)))
            if k % 64 == 0 and sum(map(len, counts.values())) > HELD_TERMS:
                yield from flush()
        yield from flush()

    found = _texts(docs).select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("documents"))


def _with_code(kept: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = codes_of(batch.column(1).cast(pa.binary()).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=["lang", "term", "code"])

    return kept.select("lang", "term").mapInArrow(run, "lang string, term string, code long")


def perfect_hashes(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``lang, shards, shard, keys, hash`` from distinct ``lang, term``: the keys in the order of their slots.

    A term's shard is its code modulo the ``shards`` of the language.
    """
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / shard_keys).alias("shards"))
    placed = _with_code(kept).join(sizes, "lang").select("lang", "shards", F.pmod("code", "shards").alias("shard"), "term")
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, group in groupby(_rows(batches, "lang", "shards", "shard", "term"), key=lambda r: r[:3]):
            made = PerfectHash([t.encode() for *_, t in group])
            keys = pa.array([[k.decode() for k in made.keys]], pa.list_(pa.string()))
            columns = [*(pa.array([x]) for x in names), keys, pa.array([made.to_bytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "shards", "shard", "keys", "hash"])

    ready = placed.repartition(tasks, "lang", "shard").sortWithinPartitions("lang", "shard", "term")
    return ready.mapInArrow(run, "lang string, shards long, shard long, keys array<string>, hash binary")


def recount(docs: DataFrame, hashes: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``lang, source, shard, slot, n``: every occurrence of every key, where there is one."""
    spark = docs.sparkSession
    rounds: list[list[tuple[str, int]]] = []
    room = 0
    for lang, shard, size in hashes.select("lang", "shard", F.octet_length("hash")).orderBy("lang", "shard").collect():  # one row a shard
        if not rounds or size > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append((lang, shard))
        room -= size
    schema = "lang string, source string, shard long, slot long, n long"
    cells = spark.createDataFrame([], schema)
    for shards in rounds:
        wanted = spark.createDataFrame(shards, "lang string, shard long")
        held = hashes.join(F.broadcast(wanted), ["lang", "shard"]).select("lang", "shards", "shard", "hash").collect()  # at most round_bytes
        model = spark.sparkContext.broadcast([(r["lang"], r["shards"], r["shard"], bytes(r["hash"])) for r in held])
        texts = _texts(docs).where(F.col("lang").isin(sorted({lang for lang, _ in shards})))
        cells = cells.unionByName(texts.mapInArrow(_counter(model), schema))
    return cells.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def _counter(model):
    """Counts a partition's words into dense rows of slots by (language, source, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, list[tuple[int, int, PerfectHash]]] = defaultdict(list)
        for lang, shards, shard, data in model.value:
            hashes[lang].append((shards, shard, PerfectHash.from_bytes(data)))
        slots: dict[tuple[str, str, int], np.ndarray] = {}
        waiting: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def look_up() -> None:
            for (lang, source), counts in waiting.items():
                words = np.array(list(counts), object)
                codes, times = codes_of(list(counts)), np.fromiter(counts.values(), np.int64, len(words))
                for shards, shard, keys in hashes[lang] if len(words) else ():
                    here = np.flatnonzero(np.mod(codes.view(np.int64), shards) == shard)
                    found = keys.find(words[here].tolist(), codes[here])
                    row = slots.get((lang, source, shard))
                    if row is None:
                        row = slots[lang, source, shard] = np.zeros(len(keys.sizes), np.int64)
                    hit = found >= 0
                    row[found[hit]] += times[here[hit]]
            waiting.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source, shard), row in slots.items():
                used = np.flatnonzero(row)
                names = [pa.array([x] * len(used), pa.string()) for x in (lang, source)]
                values = [pa.array(np.full(len(used), shard, np.int64)), pa.array(used), pa.array(row[used])]
                yield pa.RecordBatch.from_arrays([*names, *values], names=["lang", "source", "shard", "slot", "n"])
            slots.clear()

        size = 0
        for lang, source, text in _rows(batches, "lang", "source", "text"):
            waiting[lang, source].update(terms(text))
            size += len(text or b"")
            if size > SLICE_BYTES:
                look_up()
                size = 0
                if sum(map(len, slots.values())) > HELD_SLOTS:
                    yield from flush()
        look_up()
        yield from flush()

    return run


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / total), exact beyond 64 bits; 1 if there is no term."""
    wide = "decimal(19,0)"
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast(wide)
    return F.lit(1).cast("long") + F.when(total > 0, F.call_function("div", scaled, F.greatest(total, F.lit(1)).cast(wide))).otherwise(0)


def _distances(shares: DataFrame, groups: DataFrame, blocks: DataFrame, tile: int, block: int) -> DataFrame:
    """``lang, source, item, value``: the summed differences of every two sources of a language.

    ``shares`` has ``lang, source, shard, slot, p`` of the occurring cells, ``groups`` the share ``base`` of a
    source's other cells, ``blocks`` the slots ``width`` of every ``lang, shard, block``. The sources of a language
    are dealt into tiles, and a block is searched by each pair of tiles.
    """
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    marked = groups.join(tiles, "lang").select("lang", "source", "base", "tiles", F.pmod(F.xxhash64("source"), "tiles").alias("t"))
    names = ["lang", "low", "high", "shard", "block", "slot", "width", "source", "t", "p"]
    keys = names[:5]

    def met(frame: DataFrame) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("o")
        return frame.select("*", other).select("*", F.least("t", "o").alias("low"), F.greatest("t", "o").alias("high")).select(*names)

    bases = marked.join(blocks, "lang").withColumns({"slot": F.lit(-1).cast("long"), "p": F.col("base")})
    cells = shares.join(marked, ["lang", "source"]).withColumns({"block": F.floor(F.col("slot") / block), "width": F.lit(0).cast("long")})
    tasks = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = met(bases).unionByName(met(cells)).repartition(tasks, *keys).sortWithinPartitions(*keys, "slot", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, low, high), crowd in groupby(_rows(batches, *names), key=lambda r: r[:3]):
            for at, (_, rows) in enumerate(groupby(crowd, key=lambda r: r[3:5])):
                sources, matrix = _block(rows, block)
                if not at:
                    known, sums = sources, np.zeros((len(sources), len(sources)), np.int64)
                for k in range(len(sources)):
                    sums[k] += np.abs(matrix - matrix[k]).sum(1)
            side = np.array([t for _, t in known])
            apart = ~np.eye(len(known), dtype=bool) if low == high else side[:, None] != side
            a, b = np.nonzero(apart)
            pair = [pa.array([known[k][0] for k in x.tolist()], pa.string()) for x in (a, b)]
            columns = [pa.array([lang] * len(a), pa.string()), *pair, pa.array(sums[a, b], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])

    found = ready.mapInArrow(run, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _block(rows: Iterator[tuple], block: int) -> tuple[list[tuple[str, int]], np.ndarray]:
    """The sources, in order, with their tile, and their shares by slot; each source's base comes first."""
    sources: list[tuple[str, int]] = []
    place: dict[str, int] = {}
    bases: list[int] = []
    matrix, width = None, 0
    for *_, slot, size, source, t, p in rows:
        if slot < 0:
            place[source], width = len(sources), size
            sources.append((source, t))
            bases.append(p)
            continue
        if matrix is None:
            matrix = np.repeat(np.array(bases, np.int64)[:, None], width, 1)
        matrix[place[source], slot % block] = p
    if matrix is None:
        matrix = np.repeat(np.array(bases, np.int64)[:, None], width, 1)
    return sources, matrix


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, shard_keys: int = SHARD_KEYS,
          round_bytes: int = ROUND_BYTES, tile: int = TILE, block: int = BLOCK_SLOTS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources of the language (part ``pair``),
    and the ``top`` terms that a source has more of than its language (part ``term``)."""
    kept = stored(document_counts(docs).where(F.col("documents") >= least).select("lang", "term"), "terms")
    hashes = stored(perfect_hashes(kept, shard_keys), "hashes")
    cells = stored(recount(docs, hashes, round_bytes), "cells")
    vocabulary = kept.groupBy("lang").agg((F.count("*") * PRIOR).alias("prior"))
    counted = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = _texts(docs).select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("prior", F.lit(0)).alias("prior"))
    groups = stored(groups.select("*", (F.col("n") + F.col("prior")).alias("total")), "groups")
    nothing = F.lit(0).cast("long")

    shares = cells.join(groups.select("lang", "source", "total"), ["lang", "source"])
    shares = stored(shares.select("lang", "source", "shard", "slot", _share(F.col("n"), F.col("total")).alias("p")), "shares")
    blocks = hashes.select("lang", "shard", F.size("keys").cast("long").alias("keys"))
    blocks = blocks.select("*", F.explode(F.sequence(nothing, F.floor((F.col("keys") - 1) / block))).alias("block"))
    blocks = blocks.select("lang", "shard", "block", F.least(F.lit(block).cast("long"), F.col("keys") - F.col("block") * block).alias("width"))
    langs = groups.groupBy("lang").agg(F.max("prior").alias("prior"), F.sum("n").alias("n"))
    wordless = langs.where("prior = 0").select("lang", nothing.alias("shard"), nothing.alias("block"), nothing.alias("width"))
    based = groups.select("lang", "source", _share(nothing, F.col("total")).alias("base"))
    pairs = _distances(shares, based, blocks.unionByName(wordless), tile, block).withColumn("part", F.lit("pair"))

    whole = cells.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n"))
    whole = whole.join(langs.select("lang", (F.col("n") + F.col("prior")).alias("total")), "lang")
    keys = hashes.select("lang", "shard", F.posexplode("keys").alias("slot", "item"))
    place = ["lang", "shard", "slot"]
    whole = whole.select(*place, _share(F.col("n"), F.col("total")).alias("q")).join(keys.withColumn("slot", F.col("slot").cast("long")), place)
    marks = shares.join(whole, place).where("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of ``documents``; an empty table gives no row."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM dense
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), results AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, s.p - w.q FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM results)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
