"""Phrases whose words keep together, found by Rabin-Karp fingerprints.

Each text is a row of word codes; the prefix sums of a polynomial over them give the fingerprint of every n-gram by
one subtraction and one product in numpy. Language and length are part of a fingerprint. Three passes read the texts:

1. words are counted by their text, by task first, and Spark adds them up;
2. fingerprints of two words, both frequent, are counted with that of the first word;
3. those of three and four words, where every two words in them are frequent, with that of all but the last.

The difference between a fingerprint and that of its first words is the code of its last word, so a frequent
fingerprint is written out by joining its first words and its last one: one row for each phrase, however many tasks
met it. Counts by phrase are exact: a fingerprint that came with two different beginnings, or a word code that two words
share, is noticed, and what contains it is counted by its text in one more pass (``phrase_counts``). There n-grams
point to one place in the slice of text at hand, and every other occurrence is compared with the words at that place.

Frequent fingerprints go to the tasks as bits of a map of fixed size, two for each. Chance hits cost rows, never results; a
corpus with far more frequent n-grams than the map has bits saves less and gives the same.

NULL texts are empty, a NULL language is ``und``. Texts are read whole, long ones in blocks that overlap by three words
if no piece ends; repeated rows count each; ties go by count, then phrase; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import codes_of, mixed, stored, table

MIN_COUNT = 30
LONGEST = 4
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
#: Bytes of text that a task looks at together.
SLICE_BYTES = 2 << 20
#: Fingerprints and phrases a task adds up before it passes them on, and the bytes of the phrases' table.
HELD_CODES, HELD_PHRASES, HELD_BYTES = 1 << 20, 1 << 20, 32 << 20
#: Rows of a batch that a task gives back.
OUT_ROWS = 1 << 16
#: The map of frequent fingerprints has 2**FILTER_BITS bits (16 MB), made in segments of 2**SEGMENT_BITS.
FILTER_BITS, SEGMENT_BITS = 27, 20
#: Bits of a fingerprint in the map, from parts of it that don't overlap: rare n-grams pass by chance with the square of the share of set bits.
PROBES = 2
#: Buckets that rank a language's phrases before the last ranking.
BUCKETS = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_MIXER_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_LENGTHS = np.array([0, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xF1357AEA2E62A9C5], np.uint64)
#: Fixed by the contract: pieces end at these characters.
ENDS = ".,;:!?\n\x0b\x0c\r"
_BREAK, _GAP = b".", b" "
_WORD_END = re.compile(rb"[^ \t.][ \t.]")
_TO_BREAKS = bytes(_BREAK[0] if b in ENDS.encode() else b for b in range(256)).lower()


def blocks(text: bytes | None, most: int = SLICE_BYTES) -> Iterator[tuple[bytes, int]]:
    """The lower-cased text with ``.`` for every end of a piece, in blocks of at most ``most`` new bytes (or one
    word), and how many words at a block's start the block before has had."""
    data, start, overlap, carried = (text or b"").translate(_TO_BREAKS), 0, 0, 0
    while len(data) - start - carried > most:
        limit = start + carried + most
        end = data.rfind(_BREAK, start + carried, limit) + 1
        if end:
            yield data[start:end], overlap
            start, overlap, carried = end, 0, 0
            continue
        end = max(data.rfind(gap, start + carried, limit) for gap in (b" ", b"\t"))
        if end < 0 or not data[start + carried : end].strip():  # no new word fits: one word more
            found = _WORD_END.search(data, limit - 1)
            end = found.end() - 1 if found else len(data)
        yield data[start:end], overlap
        words = data[start:end].split()[1 - LONGEST :] if data[end : end + 1] != _BREAK else []
        tail = b" ".join(words)
        data, start, overlap, carried = tail + data[end:], 0, len(words), len(tail)
    yield data[start:], overlap


class Slice:
    """Words of some texts in a row, with the fingerprints of their n-grams."""

    def __init__(self, parts: list[tuple[str, bytes, int]]) -> None:
        texts, langs, sizes, overlaps = [], [], [], []
        for lang, data, overlap in parts:
            found = data.replace(_BREAK, b" . ").split()
            found.append(_BREAK)
            texts.append(b" ".join(found))
            langs.append(lang)
            sizes.append(len(found))
            overlaps.append(overlap)
        self.data = b"".join(t + b" " for t in texts)
        letters = np.frombuffer(self.data, np.uint8)
        self.ends = np.flatnonzero(letters == _GAP[0])
        offsets = np.concatenate(([0], self.ends + 1))
        self.starts = offsets[:-1]
        words = pa.Array.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)]).dictionary_encode()
        ids = self.ids = words.indices.to_numpy()
        codes = codes_of(words.dictionary.to_pylist())  # each with the gap behind it
        self.names = langs
        self.part = np.repeat(np.arange(len(parts)), sizes)
        ends = np.cumsum(sizes)
        self.fresh = np.repeat(ends - sizes + overlaps, sizes)  # n-grams that end before were counted
        self.breaks = np.concatenate(([0], np.cumsum(letters[self.starts] == _BREAK[0])))
        lang_codes = codes_of([x.encode() for x in langs])
        self.tint = np.repeat(lang_codes, sizes)
        powers = np.full(max(len(ids), 1), _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        undo = np.full(len(powers), _INVERSE, np.uint64)
        undo[0] = 1
        self.undo = np.multiply.accumulate(undo)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[ids] * powers[: len(ids)], dtype=np.uint64)))

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    def phrases(self, places: np.ndarray, n: int) -> pa.Array:
        """The n words at each place."""
        ends = self.ends[places + (n - 1)]
        return pa.array([self.data[a:b] for a, b in zip(self.starts[places].tolist(), ends.tolist())], pa.binary())

    def places(self, n: int) -> np.ndarray:
        """Where an n-gram of one piece starts that no earlier block has had."""
        starts = np.arange(max(len(self.ids) - n + 1, 0))
        return starts[(self.breaks[n:] == self.breaks[: len(starts)]) & (starts + n > self.fresh[: len(starts)])]

    def codes(self, places: np.ndarray, n: int) -> np.ndarray:
        polynomial = (self.sums[places + n] - self.sums[places]) * self.undo[places]
        return mixed(polynomial + self.tint[places] + _LENGTHS[n])


class Filter:
    """The bits of frequent fingerprints."""

    def __init__(self, data: bytes, bits: int) -> None:
        self.data, self.bits = np.frombuffer(data, np.uint8), bits

    def has(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for k in range(PROBES):
            left = np.flatnonzero(found)
            place = (codes[left] << np.uint64(k * self.bits) >> np.uint64(64 - self.bits)).astype(np.int64)
            found[left] = self.data[place >> 3] >> (place & 7).astype(np.uint8) & 1
        return found


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Slice]:
    held, size = [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            for data, overlap in blocks(batch.column(1)[row].as_py(), most):
                held.append((batch.column(0)[row].as_py(), data, overlap))
                size += len(data) + 64
                if size > most:
                    yield Slice(held)
                    held, size = [], 0
    if held:
        yield Slice(held)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))


def unmixed(x: np.ndarray) -> np.ndarray:
    """What ``mixed`` was given."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIXER_INVERSE
    x = x ^ (x >> np.uint64(32))
    x = x * _MIXER_INVERSE
    return x ^ (x >> np.uint64(32))


def last_codes(size: np.ndarray, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The code of an n-gram's last word, from the fingerprints of the n-gram and of the words before the last."""
    undo = np.array([1, *(pow(_BASE, -k, 1 << 64) for k in range(1, LONGEST))], np.uint64)
    added = unmixed(codes) - _LENGTHS[size] - (unmixed(firsts) - _LENGTHS[size - 1])
    return added * undo[size - 1]


def word_codes(langs: list[str], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words, the same in every language, and their fingerprints."""
    codes = codes_of([w + _GAP for w in words])
    names = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
    tints = codes_of([lang.encode() for lang in names])
    return codes, mixed(codes + tints[[names[lang] for lang in langs]] + _LENGTHS[1]) if names else codes


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _added(codes: np.ndarray, firsts: np.ndarray, n: np.ndarray) -> Counts:
    """Counts of equal neighbours in the order of the codes."""
    order = np.argsort(codes, kind="stable")  # two sorted runs: merged, not sorted anew
    codes, firsts, n = codes[order], firsts[order], n[order]
    if not len(codes):
        return codes, firsts, n
    heads = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (firsts[1:] != firsts[:-1]))))
    return codes[heads], firsts[heads], np.add.reduceat(n, heads)


Wanted = Callable[["Slice"], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def frequent_grams(docs: DataFrame, wanted: Wanted, least: int, most: int = SLICE_BYTES) -> DataFrame:
    """``size, fp, first, n, sole, code`` of the fingerprints that occur ``least`` times or more, of those that
    ``wanted`` takes from a slice: the words before the last have the fingerprint ``first`` (always if ``sole``), the
    last one has the code ``code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counts] = {}

        def made() -> Iterator[pa.RecordBatch]:
            for size, (codes, firsts, n) in held.items():
                for at in range(0, len(codes), OUT_ROWS):
                    part = slice(at, at + OUT_ROWS)
                    sizes = pa.array(np.full(len(n[part]), size, np.int32))
                    columns = [sizes, pa.array(codes[part].view(np.int64)), pa.array(firsts[part].view(np.int64)), pa.array(n[part])]
                    yield pa.RecordBatch.from_arrays(columns, names=["size", "fp", "first", "n"])

        for piece in _slices(batches, most):
            for size, codes, firsts in wanted(piece):
                found = _added(codes, firsts, np.ones(len(codes), np.int64))
                held[size] = _added(*map(np.concatenate, zip(held[size], found))) if size in held else found
            if sum(len(codes) for codes, _, _ in held.values()) > HELD_CODES:
                yield from made()
                held.clear()
        yield from made()

    def lasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, codes, firsts = (batch.column(name).to_numpy() for name in ("size", "fp", "first"))
            code = last_codes(size, codes.view(np.uint64), firsts.view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], names=[*batch.schema.names, "code"])

    rows = _texts(docs).mapInArrow(run, "size int, fp long, first long, n long")
    sums = rows.groupBy("size", "fp").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("first").alias("other"))
    sums = sums.where(F.col("n") >= least).select("size", "fp", "first", "n", (F.col("first") == F.col("other")).alias("sole"))
    return sums.mapInArrow(lasts, "size int, fp long, first long, n long, sole boolean, code long")


def bit_map(codes: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """The map that ``Filter`` reads; tasks fill segments, the driver gets at most 2**bits bits."""
    segment_bits = min(SEGMENT_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(1 << segment_bits, bool))
        for batch in batches:
            place = batch.column(0).to_numpy()
            segments = place >> segment_bits
            for s in np.unique(segments).tolist():
                made[s][place[segments == s] & (1 << segment_bits) - 1] = True
        for s, found in made.items():
            data = np.packbits(found, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([data], pa.binary())], names=["segment", "bits"])

    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = [F.shiftrightunsigned(F.shiftleft("fp", k * bits), 64 - bits) for k in range(PROBES)]
    places = codes.select(F.explode(F.array(*probes)).alias("place"))
    dealt = places.repartition(tasks, F.shiftright("place", segment_bits))
    out = bytearray(max((1 << bits) >> 3, 1))
    size = max((1 << segment_bits) >> 3, 1)
    for row in dealt.mapInArrow(run, "segment long, bits binary").toLocalIterator():
        out[row["segment"] * size : (row["segment"] + 1) * size] = row["bits"]
    return bytes(out)


def _pairs(words, bits: int) -> Wanted:
    def wanted(piece: Slice) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        single = piece.codes(np.arange(len(piece.ids)), 1)
        heard = Filter(words.value, bits).has(single)
        here = piece.places(2)
        here = here[heard[here] & heard[here + 1]]
        yield 2, piece.codes(here, 2), single[here]

    return wanted


def _longer(words, pairs, bits: int) -> Wanted:
    def wanted(piece: Slice) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        heard = Filter(words.value, bits).has(piece.codes(np.arange(len(piece.ids)), 1))
        here = np.flatnonzero(piece.breaks[2:] == piece.breaks[:-2])
        here = here[heard[here] & heard[here + 1]]  # the pairs that were counted
        good = np.zeros(len(piece.ids), bool)  # two words that are frequent together start here
        good[here] = Filter(pairs.value, bits).has(piece.codes(here, 2))
        for n in range(3, LONGEST + 1):
            here = piece.places(n)
            for k in range(n - 1):
                here = here[good[here + k]]
            yield n, piece.codes(here, n), piece.codes(here, n - 1)

    return wanted


def _table(lang: np.ndarray, size: np.ndarray, phrases: pa.Array, n: np.ndarray) -> pa.Table:
    return pa.table({"lang": lang.astype(np.int32), "size": size.astype(np.int32), "phrase": phrases, "n": n.astype(np.int64)})


def _summed(counts: list[pa.Table]) -> pa.Table:
    keys = ["lang", "size", "phrase"]
    found = pa.concat_tables(counts).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return pa.table({**{k: found.column(k) for k in keys}, "n": found.column("n_sum")})


class Tally:
    """Phrases with their counts, one for each fingerprint."""

    def __init__(self) -> None:
        self.codes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending codes, and where their phrases stand
        self.table = _table(np.zeros(0), np.zeros(0), pa.array([], pa.binary()), np.zeros(0)).drop_columns("n")
        self.n = np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, table: pa.Table) -> pa.Table:
        """Adds the rows' counts and returns those whose fingerprint stands for another phrase."""
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.concatenate(([True], codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, bool)
        apart = [order[~first]]
        order, codes = order[first], codes[first]
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        rows, mine = self.rows[at[known]], order[known]
        here, there = table.take(mine), self.table.take(rows)
        same = np.ones(len(rows), bool)
        for name in ("lang", "size", "phrase"):
            same &= pc.equal(here.column(name), there.column(name)).to_numpy()
        self.n[rows[same]] += here.column("n").to_numpy()[same]
        apart.append(mine[~same])
        fresh = table.take(order[~known])
        self.codes = np.concatenate((self.codes, codes[~known]))
        self.rows = np.concatenate((self.rows, len(self.n) + np.arange(fresh.num_rows)))
        sort = np.argsort(self.codes, kind="stable")  # two sorted runs: merged, not sorted anew
        self.codes, self.rows = self.codes[sort], self.rows[sort]
        self.n = np.concatenate((self.n, fresh.column("n").to_numpy()))
        self.table = pa.concat_tables([self.table, fresh.drop_columns("n")]).combine_chunks()
        return table.take(np.concatenate(apart))

    def whole(self) -> pa.Table:
        return self.table.append_column("n", pa.array(self.n))


def phrase_counts(
    slices: Iterator[Slice], known: Filter, most: int = HELD_PHRASES, most_bytes: int = HELD_BYTES, longest: int = LONGEST
) -> Iterator[pa.RecordBatch]:
    """``lang, size, phrase, n`` of the n-grams with a known fingerprint, added up over the slices in tables of at most
    ``most`` rows and ``most_bytes`` bytes and those of one slice."""
    langs: dict[str, int] = {}
    spoken: Counter = Counter()
    tally, apart = Tally(), []

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(langs), pa.string())
        for batch in table.to_batches(max_chunksize=OUT_ROWS):
            columns = [names.take(batch.column("lang")), batch.column("size"), batch.column("phrase").cast(pa.string()), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n"])

    for piece in slices:
        lang = np.array([langs.setdefault(x, len(langs)) for x in piece.names], np.int64)[piece.part]
        totals = np.bincount(lang[piece.places(1)])
        spoken.update({k: int(totals[k]) for k in np.flatnonzero(totals).tolist()})
        found, tables = [], []
        for n in range(1, longest + 1):
            here = piece.places(n)
            codes = piece.codes(here, n)
            hit = known.has(codes)
            places, times = pointers(piece, here[hit], codes[hit], n)
            found.append(piece.codes(places, n))
            tables.append(_table(lang[places], np.full(len(places), n), piece.phrases(places, n), times))
        apart.append(tally.add(np.concatenate(found), pa.concat_tables(tables).combine_chunks()))
        apart = [_summed(apart)]
        if len(tally.codes) + apart[0].num_rows > most or tally.table.nbytes + apart[0].nbytes > most_bytes:
            yield from made(tally.whole())
            yield from made(apart.pop())
            tally = Tally()
    yield from made(tally.whole())
    for table in apart:
        yield from made(table)
    yield from made(_table(np.array([*spoken]), np.zeros(len(spoken)), pa.array([b""] * len(spoken), pa.binary()), np.array([*spoken.values()])))


def counted_phrases(docs: DataFrame, frequent: bytes, bits: int, most: int = SLICE_BYTES) -> DataFrame:
    """``lang, size, phrase, n`` of all n-grams with a frequent fingerprint; size 0 has all words of the language."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(frequent)
    schema = "lang string, size int, phrase string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from phrase_counts(_slices(batches, most), Filter(model.value, bits))

    return _texts(docs).mapInArrow(run, schema).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def counted_words(docs: DataFrame, most: int = SLICE_BYTES) -> DataFrame:
    """``lang, size, phrase, n, fp, code, sole`` of all words; ``sole`` if no other word has the fingerprint. Size 0 has
    all words of the language."""
    schema = "lang string, size int, phrase string, n long, fp long, code long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in phrase_counts(_slices(batches, most), Filter(b"\xff", 3), longest=1):
            words = batch.column("phrase").cast(pa.binary()).to_pylist()
            codes, fps = word_codes(batch.column("lang").to_pylist(), words)
            columns = [*batch.columns, pa.array(fps.view(np.int64)), pa.array(codes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "fp", "code"])

    rows = _texts(docs).mapInArrow(run, schema).repartition("fp")
    sums = rows.groupBy("fp", "code", "lang", "size", "phrase").agg(F.sum("n").alias("n"))
    sole = F.count("*").over(Window.partitionBy("fp")) == 1
    return sums.select("lang", "size", "phrase", "n", "fp", "code", sole.alias("sole"))


def written_out(words: DataFrame, grams: DataFrame) -> DataFrame:
    """``lang, size, phrase, n, fp`` of the frequent n-grams that are made of frequent ones one word shorter and a
    frequent word, as far as no fingerprint stands for two of them."""
    last = words.where("size = 1 AND sole").select("lang", "code", F.col("phrase").alias("last"))
    level = words.where("size = 1 AND sole").select("lang", "phrase", "fp")
    out = []
    for size in range(2, LONGEST + 1):
        found = grams.where((F.col("size") == size) & F.col("sole"))
        found = found.join(level.select("lang", F.col("phrase").alias("begin"), F.col("fp").alias("first")), "first").join(last, ["lang", "code"])
        found = found.select("lang", "size", F.concat_ws(" ", "begin", "last").alias("phrase"), "n", "fp")
        out.append(stored(found, "phrases"))
        level = out[-1]
    return reduce(DataFrame.unionByName, out)


def frequent_phrases(docs: DataFrame, words: DataFrame, grams: DataFrame, least: int, bits: int = FILTER_BITS, most: int = SLICE_BYTES) -> DataFrame:
    """``lang, size, phrase, n`` of all frequent n-grams, and size 0 of ``words``. Those that can't be written out are
    counted by their text."""
    names = ["lang", "size", "phrase", "n"]
    known = written_out(words, grams)
    counts = words.select(names).unionByName(known.select(names))
    others = grams.join(known, ["size", "fp"], "left_anti")
    if others.isEmpty():
        return counts
    texts = counted_phrases(docs, bit_map(others, bits), bits, most).where((F.col("size") > 1) & (F.col("n") >= least))
    return counts.unionByName(texts.join(known, ["lang", "size", "phrase"], "left_anti"))


def pointers(piece: Slice, places: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each phrase and how often it occurs; equal fingerprints count together only if language
    and words are those of that place. Which of its places that is changes no count, so the order among them is left open."""
    order = np.argsort(codes)
    places, codes = places[order], codes[order]
    heads = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else order
    sizes = np.diff(np.append(heads, len(codes)))
    pointer = np.repeat(places[heads], sizes)
    same = piece.tint[places] == piece.tint[pointer]
    for k in range(n):
        same &= piece.ids[places + k] == piece.ids[pointer + k]
    times = np.add.reduceat(same.astype(np.int64), heads) if len(codes) else heads
    others = Counter((piece.names[piece.part[p]], *piece.ids[p : p + n].tolist()) for p in places[~same])
    first = {(piece.names[piece.part[p]], *piece.ids[p : p + n].tolist()): p for p in reversed(places[~same])}
    more = np.array([first[k] for k in others], np.int64), np.array([*others.values()], np.int64)
    return np.concatenate((places[heads], more[0])), np.concatenate((times, more[1]))


def pointed(piece: Slice, places: np.ndarray, codes: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """The same, one by one."""
    yield from zip(*(x.tolist() for x in pointers(piece, places, codes, n)))


def _part(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of every frequent phrase of two words or more that no longer one covers."""
    words = F.split("phrase", " ", -1)
    longer = counts.where("size > 1")
    wide = "decimal(38,0)"
    at = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), "size", at)
    cuts = cuts.select("*", _part(words, F.lit(1), F.col("k")).alias("first"), _part(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    by = counts.select("lang", "phrase", "n")
    cuts = cuts.join(by.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(by.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * F.col("a").cast("decimal(19,0)"), (F.col("l") + F.col("r")).cast("decimal(19,0)"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = [(n, s) for n in range(2, LONGEST) for s in range(1, LONGEST - n + 2)]
    parts = [F.when((F.col("size") > n) & (F.col("size") >= s + n - 1), _part(words, s, n)) for n, s in inner]
    held = longer.where("size > 2").select("lang", "n", F.explode(F.array_distinct(F.array_compact(F.array(*parts)))).alias("phrase"))
    cover = held.groupBy("lang", "phrase").agg(F.max("n").alias("cover"))
    kept = worst.join(cover, ["lang", "phrase"], "left")
    within = F.lit(100).cast(wide) * F.col("cover") >= F.lit(COVERED_PERCENT).cast(wide) * F.col("a")
    kept = kept.where(F.col("cover").isNull() | ~within)
    return kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, bits: int = FILTER_BITS, most: int = SLICE_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language, best first."""
    spark = docs.sparkSession
    words = stored(counted_words(docs, most).where((F.col("size") == 0) | (F.col("n") >= least)), "words")
    heard = spark.sparkContext.broadcast(bit_map(words.where("size = 1"), bits))
    pairs = stored(frequent_grams(docs, _pairs(heard, bits), least, most), "codes")
    model = spark.sparkContext.broadcast(bit_map(pairs, bits))
    long = stored(frequent_grams(docs, _longer(heard, model, bits), least, most), "codes")
    counts = stored(frequent_phrases(docs, words, pairs.unionByName(long), least, bits, most), "phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).orderBy(*order)
    best = scored(counts).withColumn("rank", F.row_number().over(bucket)).where(F.col("rank") <= top)  # at most top * BUCKETS a language go on
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, size, phrase, count(*) AS n
  FROM (SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) AS phrase
        FROM pieces, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), cuts AS (
  SELECT lang, phrase, size, n AS a, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), scores AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, l.n AS l, r.n AS r, ({SCALE}::HUGEINT * c.a) // (l.n + r.n) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
), worst AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, phrase, max(a) AS cover
  FROM (SELECT lang, a, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, size - m + 2)]) AS phrase
        FROM cuts, (VALUES (2), (3)) AS t(m) WHERE k = 1 AND m < size)
  GROUP BY lang, phrase
), kept AS (
  SELECT worst.* FROM worst LEFT JOIN held USING (lang, phrase) WHERE cover IS NULL OR 100::HUGEINT * cover < {COVERED_PERCENT}::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= {TOP}
"""
