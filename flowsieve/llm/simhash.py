"""Near-duplicates by SimHash fingerprints and BK-trees.

Two fingerprints that differ in at most three of 64 bits agree on one of four 16-bit blocks, so the
distinct fingerprints are dealt into shards by (block, value); a shard with too many is dealt again
by blocks of its remaining bits. Each shard is searched with a BK-tree: children are keyed by their
distance to the parent, and only edges within the radius are followed. A shard yields a spanning
forest of its links, never all pairs; components of all links come from star contraction.

The trees go to the tasks with their shards, not as a broadcast: together they grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import dropped, records, stored, table

SHINGLE = 3
RADIUS = 3
SEED = 42
SHARD_ROWS = 4096
LEVELS = 4
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the ASCII-lower-cased words' shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < size:
        cuts: Iterator = iter([(0, len(data))])
    else:
        cuts = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(data[a:b], SEED) for a, b in cuts], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", size: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of each row's ``text`` as a signed 64-bit column in place of the text."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            values = np.array([fingerprint(t, size) for (t,) in records(batch, "text")], np.uint64).view(np.int64)
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(values)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _blocks(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """The bits outside the mask, cut into blocks; each result is the mask and one block."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Fingerprints by Hamming distance; components of those within the radius."""

    def __init__(self, radius: int = RADIUS) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, value: int) -> None:
        """Links the value to all within the radius and hangs it into the tree.

        Everything below an edge e lies at distance e from the parent. Below edges within the radius all
        is linked to the parent already; if the value is as well, nothing there adds to its component.
        """
        me, radius = len(self.values), self.radius
        self.values.append(value)
        self.children.append({})
        self.parent.append(me)
        if not me:
            return
        todo = [0]
        while todo:
            k = todo.pop()
            d = (self.values[k] ^ value).bit_count()
            least = d - radius
            if d <= radius:
                self.parent[self.root(k)] = self.root(me)
                least = radius + 1
            for e, child in self.children[k].items():
                if least <= e <= d + radius:
                    todo.append(child)
        k = 0
        while True:
            d = (self.values[k] ^ value).bit_count()
            child = self.children[k].get(d)
            if child is None:
                self.children[k][d] = me
                return
            k = child

    def links(self) -> Iterator[tuple[int, int]]:
        """Each linked value with the one that stands for its component here."""
        for k, value in enumerate(self.values):
            if (top := self.root(k)) != k:
                yield value, self.values[top]


def _dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """One row per fingerprint and mask, with the bits under the mask as key."""
    keys = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]
    return fps.select("fp", F.explode(F.array(*keys)).alias("s")).select("s.mask", "s.key", "fp")


def _shards(fps: DataFrame, most: int, levels: int) -> DataFrame:
    """``mask, key, fp`` of all shards with two fingerprints or more, none above ``most`` until the last
    level. Each level splits the remaining bits of the large ones, so every close pair stays together
    in one shard at least."""
    done: DataFrame | None = None
    rows, masks = _dealt(fps, _blocks(0)), _blocks(0)
    for level in range(levels):
        rows = stored(rows, "fingerprints")
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        counted = rows.join(sizes, ["mask", "key"])
        last = level == levels - 1
        here = (counted if last else counted.where(F.col("n") <= most)).drop("n")
        done = here if done is None else done.unionByName(here)
        if last or not sizes.where(F.col("n") > most).limit(1).count():
            break
        big = counted.where(F.col("n") > most).drop("n")
        finer = {m: _blocks(m) for m in masks}
        parts = F.create_map(*[x for m, ms in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in ms]))])
        rows = big.select("fp", F.explode(F.element_at(parts, F.col("mask"))).alias("mask")).select(
            "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp"
        )
        masks = [k for ms in finer.values() for k in ms]
    return done


def close_links(fps: DataFrame, radius: int = RADIUS, most: int = SHARD_ROWS, levels: int = LEVELS) -> DataFrame:
    """Links ``u, v`` that connect all distinct ``fp`` within the radius."""
    if radius != RADIUS:
        raise ValueError(f"the blocks are cut for radius {RADIUS}")
    shards = _shards(fps, most, levels)
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int]]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple[int, int]] = []
        for _, group in groupby(rows(), key=lambda r: r[:2]):  # sorted: one shard at a time
            tree = BKTree(radius)
            for *_, fp in group:
                tree.add(fp & _ALL)
            out += tree.links()
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    placed = shards.repartition(tasks, "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return placed.mapInArrow(search, "u long, v long").distinct()


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    values = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(values[:, 0].copy()), pa.array(values[:, 1].copy())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``u, v``: each linked node but the smallest of its component, and that smallest one.

    Large and small stars in turn: every node's neighbours move to the smallest of them, until nothing
    changes. No step gathers a component; the driver sees a count and a checksum a round.
    """

    def star(edges: DataFrame, pick: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        # with a second key the sums aren't joined where they were made: only a join of two plain exchanges
        # lets the engine split a node with very many neighbours
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        keyed = least.withColumn("_deal", F.xxhash64("u"))
        joined = edges.withColumn("_deal", F.xxhash64("u")).join(keyed, ["u", "_deal"]).drop("_deal")
        return pick(joined, least).where("u != v").distinct()

    def large(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return star(both, lambda e, _: e.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))

    def small(edges: DataFrame) -> DataFrame:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return star(
            down,
            lambda e, least: e.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))),
        )

    edges, before = stored(links.where("u != v").distinct(), "links"), None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sums["n"] == 0 or (sums["n"], sums["s"]) == before:
            return edges
        before = (sums["n"], sums["s"])
        old, edges = edges, stored(small(large(edges)), "stars")
        dropped(old)


def grouped(docs: DataFrame, most: int = SHARD_ROWS, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id that links of any length reach.

    Copies share a fingerprint and are counted once in the search. A NULL id is never the smallest;
    NULL and empty texts have fingerprint 0.
    """
    found = stored(with_fingerprint(docs.select("doc_id", "text"), size=size), "simhash")
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    stars = components(close_links(distinct.select("fp"), most=most))
    named = distinct.join(stars.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = stored(named.join(smallest, "root").select("fp", "component_id"), "groups")
    return found.join(groups, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; an empty table gives no row."""
    found = grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
