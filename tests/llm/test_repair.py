from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowsieve.llm.repair import Shard, checksums, compress, op3_token_shards, pack
from flowsieve.llm.tokens import WordEncoder, tokenizer_path

ODD = [
    "It's <|endoftext|>x a\x1cb É. J̌ oo... a²b 12,3 don't!  x y,. İ ΑΣ ΑΣ. 한국어 ﬁ. é, '' 's s's 'sfoo ẞ Ǆ ªa ⅷ ͅα",
    "A.B,C! wasn't'll ...'s. GREAT!! a$$$ | b%%% <|startoftext|><|endoftext|>.",
    "",
    "tab\tnew\nline wide space",
    "x" * 700 + " " + "É" * 600,
]


def library(encoder: WordEncoder, text: str) -> bytes:
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_match_whole_texts() -> None:
    encoder = WordEncoder(tokenizer_path(), keep=5)
    for text in ODD * 2:
        assert encoder.encode(text) == library(encoder, text)
    assert encoder.encode(None) == b""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text: str) -> None:
    encoder = test_any_text.__dict__.setdefault("encoder", WordEncoder(tokenizer_path()))
    assert encoder.encode(text) == library(encoder, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), max_size=12))
def test_round_trip(docs: list[list[int]]) -> None:
    data = [np.array([*d, 2], np.uint32) for d in docs]
    sizes = np.array([len(d) for d in data], np.int64)
    starts = sizes.cumsum() - sizes
    ids = np.concatenate(data) if data else np.zeros(0, np.uint32)
    shard = Shard(pack([*range(len(docs))], starts, ids))
    assert shard.all().tolist() == ids.tolist()
    assert [shard.doc(k).tolist() for k in range(len(docs))] == [d.tolist() for d in data]
    for a in range(0, len(ids), 7):
        assert shard.read(a, min(a + 5, len(ids))).tolist() == ids[a : a + 5].tolist()


def test_compression_replaces_pairs_inside_documents() -> None:
    ids = np.array([5, 6, 5, 6, 2] * 400, np.uint32)
    g = compress(ids, np.arange(0, len(ids), 5))
    assert len(g.symbols) < len(ids) / 2
    assert all(n <= 5 for n in g.lengths)


def one_grammar(ids: np.ndarray) -> Shard:
    return Shard(pack([0], np.zeros(1, np.int64), ids))


def test_goes_on_until_no_pair_is_frequent() -> None:
    phrase = np.random.default_rng(3).integers(0, 50_000, 200).astype(np.uint32)
    shard = one_grammar(np.tile(phrase, 5000))
    assert len(shard.symbols) < 200
    assert (shard.all() == np.tile(phrase, 5000)).all()
    assert len(one_grammar(np.full(1_000_000, 7, np.uint32)).symbols) < 40
    ids = np.random.default_rng(4).zipf(1.3, 50_000).clip(max=3000).astype(np.uint32)
    g = compress(ids, np.zeros(1, np.int64), pairs=50)
    pairs = (g.symbols[:-1].astype(np.uint64) << np.uint64(32)) | g.symbols[1:]
    assert np.unique(pairs, return_counts=True)[1].max() < 8


def test_any_stretch_inside_a_long_document() -> None:
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.tile(rng.integers(0, 900, 37), 300), rng.integers(0, 900, 5000), np.full(4000, 3)]).astype(np.uint32)
    shard = one_grammar(ids)
    assert len(shard.symbols) < 6000
    for a, b in rng.integers(0, len(ids) + 1, (400, 2)).tolist():
        assert shard.read(a, b).tolist() == ids[a:b].tolist()
    assert checksums(shard, 100) == [zlib.crc32(ids.astype("<u4").tobytes())]


def test_checksums_of_documents_across_stretches() -> None:
    data = [np.arange(n, dtype=np.uint32) for n in (0, 5, 0, 230, 1, 0, 99, 100, 0)]
    sizes = np.array([len(d) for d in data])
    shard = Shard(pack([*range(9)], sizes.cumsum() - sizes, np.concatenate(data)))
    for step in (1, 7, 100, 1000):
        assert checksums(shard, step) == [zlib.crc32(d.astype("<u4").tobytes()) for d in data]


def test_many_rows_without_id(spark, tables) -> None:
    docs = spark.range(5000).selectExpr("cast(null as long) as doc_id", "concat('text ', id % 700) as text").repartition(8)
    found = op3_token_shards(spark, tables(documents=docs)).orderBy("start").collect()
    assert len(found) == 5000 and all(r["doc_id"] is None for r in found)
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found[:-1])]).tolist()


def test_query(spark, tables) -> None:
    texts = {3: "one two", 1: None, 2: "", 7: ODD[0], 9: "word " * 30_000}
    rows = [(d, t, "x", 1) for d, t in texts.items()] + [(7, ODD[0], "y", 2), (None, "no id", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, path int").repartition(3)
    found = [tuple(r) for r in op3_token_shards(spark, tables(documents=docs)).collect()]
    encoder, so_far, expected = WordEncoder(tokenizer_path()), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = library(encoder, text or "") + np.array([2], "<u4").tobytes()
        expected.append((doc_id, so_far, len(data) // 4, zlib.crc32(data)))
        so_far += len(data) // 4
    assert sorted(found, key=lambda r: r[1]) == expected


def test_empty_table(spark, tables) -> None:
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op3_token_shards(spark, tables(documents=docs)).collect() == []
