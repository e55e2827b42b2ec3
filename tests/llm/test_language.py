from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowsieve.llm.language import BUCKET_BITS, ORDERS, SLICE, SMOOTHING, fit, grams, log_likelihoods, op2_language, predict, slices

EN = "the quick brown fox jumps over the lazy dog and runs into the woods"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft weg"


def buckets(text: str) -> list[int]:
    """n-gram by n-gram."""
    text = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    points = np.array([32, 32, *map(ord, text), 32, 32], np.uint32)
    return [int(grams(points[i : i + n], n)[0]) for n in ORDERS for i in range(len(points) - n + 1)]


def test_scores_match_one_gram_at_a_time(spark) -> None:
    rows = [(EN, "en"), (DE, "de"), (EN[:20], "en"), (None, "de"), (EN, None), ("", "de")]
    langs, matrix = fit(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["de", "en"]
    counts = {lang: Counter(b for t, x in rows if t is not None and x == lang for b in buckets(t)) for lang in langs}
    texts = ["The dog!", "x", "Über 12 den Hund", "a" * 300]
    got = log_likelihoods([slices(t) for t in texts], matrix)
    for text, row in zip(texts, got):
        for lang, value in zip(langs, row):
            total = sum(counts[lang].values()) + SMOOTHING * 2**BUCKET_BITS
            assert math.isclose(value, sum(math.log((counts[lang][b] + SMOOTHING) / total) for b in buckets(text)))


def test_long_text_is_scored_whole() -> None:
    assert sum(len(p) - 2 for p in slices("ab " * 100_000)) == 300_002  # runs of three


def test_slices_put_nothing_between_their_words() -> None:
    text = "".join(chr(0x4E00 + i % 5000) for i in range(SLICE + 5000)) + "xyz" * 60_000
    whole = "  " + text + "  "
    found = Counter(tuple(p[i : i + 3].tolist()) for p in slices(text) for i in range(len(p) - 2))
    assert found == Counter(tuple(map(ord, whole[i : i + 3])) for i in range(len(whole) - 2))


@pytest.mark.parametrize("text", ["²", "½", "Ⅷ", "٣ 4 ৫", "_", "№ €", "\u0301", "〇"])
def test_numbers_and_marks_are_no_letters(spark, text) -> None:
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(20)]
    langs, matrix = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, text * 3), (2, text + "é")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs, langs, matrix).collect()}
    assert found[1] == ("und", 0.0) and found[2][0] in langs


def test_query(spark, tables) -> None:
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(40, None, "en", "x"), (41, " 12 %\n", "en", "x"), (42, "", None, "x"), (43, "fox", None, "x"), (None, DE, "de", "x"), (7, EN, "en", "x")]
    rows += [(44, "hund und fuchs " * 30_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = op2_language(spark, tables(documents=docs)).collect()
    expected = {40: "und", 41: "und", 42: "und", 43: "en", 44: "de"} | {i: "en" if i % 2 else "de" for i in range(40)} | {None: "de"}
    assert Counter((r["doc_id"], r["lang_pred"]) for r in found) == Counter((i, expected[i]) for i, *_ in rows)
    for r in found:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_nothing_learned(spark, tables) -> None:
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in op2_language(spark, tables(documents=docs)).collect()] == [(1, False, "und", 0.0)]
    assert op2_language(spark, tables(documents=docs.where("false"))).collect() == []


def test_held_out_accuracy(spark) -> None:
    found = op2_language(spark, "/root/testdata/sf0.01").where("held_out")
    right = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = right.collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows)
    assert re.fullmatch("[a-z]+", rows[0]["lang_pred"])
