from __future__ import annotations

import zlib
from collections import Counter
from math import ceil

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowsieve.llm.packing import op7_packing, pack, plan
from flowsieve.llm.tokens import WordEncoder, tokenizer_path


def check(places: list[tuple[int, int, int]], capacity: int) -> int:
    """Length, sequence, offset of each piece: gapless from 0, never over capacity."""
    by: dict[int, list[tuple[int, int]]] = {}
    for length, sequence, offset in places:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def expand(placed: list) -> list[tuple[int, int, int]]:
    out = []
    for p in placed:
        for r in range(p.first, p.last):
            q, k = divmod(r - p.first, p.per_sequence)
            out.append((p.length, p.sequence + q, p.offset + k * p.length))
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 30), max_size=10))
def test_plan(counts: dict[int, int]) -> None:
    placed, sequences = plan(counts, 24)
    places = expand(placed)
    assert Counter(length for length, *_ in places) == Counter(counts)
    assert check(places, 24) == sequences


def test_exact_combinations_fill_sequences() -> None:
    assert plan({10: 4}, 10)[1] == 4
    assert plan({7: 5, 3: 5}, 10)[1] == 5
    assert plan({5: 6, 3: 6, 2: 6}, 10)[1] == 6
    assert plan({4: 3, 3: 3, 2: 3, 1: 3}, 10)[1] == 3
    assert plan({6: 2, 5: 1, 4: 1}, 10)[1] == 3


def test_plan_is_near_the_bound() -> None:
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6.3, 1.1, 60_000).astype(int) + 1, 4096)
    placed, sequences = plan(dict(Counter(lengths.tolist())))
    assert sequences <= ceil(lengths.sum() / 4096) + 2
    assert len(placed) < 40_000


def test_hot_length_is_ranked_in_parts(spark) -> None:
    pieces = spark.range(25_000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 5 = 0, 96L, 1000L) as length", "id as ids_crc32")
    found = pack(pieces, 4096).collect()
    assert len(found) == 25_000
    assert check([(r["length"], r["sequence_id"], r["offset"]) for r in found], 4096) == 5000


def test_equal_rows_are_ranked_in_parts(spark) -> None:
    from flowsieve.llm.packing import ranked

    pieces = spark.range(6000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "700L as length", "9L as ids_crc32")
    found = ranked(pieces, {700: 6000}, rows=100)
    assert sorted(r["_rank"] for r in found.collect()) == list(range(6000))
    assert check([(r["length"], r["sequence_id"], r["offset"]) for r in pack(pieces, 4096).collect()], 4096) == 1200


def test_query(spark, tables) -> None:
    encoder = WordEncoder(tokenizer_path())
    rows = [(i, "word " * (37 * i % 900), 1) for i in range(60)]
    rows += [(60, None, 1), (61, "", 1), (62, "some words here " * 5000, 2), (None, "no id", 1), (5, "again", 3), (5, "again", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(4)
    found = op7_packing(spark, tables(documents=docs)).collect()
    check([(r["length"], r["sequence_id"], r["offset"]) for r in found], 4096)
    expected = Counter()
    for doc_id, text, _ in rows:
        data = encoder.encode(text) + np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(data), 4 * 4096)):
            piece = data[at : at + 4 * 4096]
            expected[doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected


def test_empty_table(spark, tables) -> None:
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op7_packing(spark, tables(documents=docs)).collect() == []
