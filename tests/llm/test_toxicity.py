from __future__ import annotations

import random
import zlib

import numpy as np

from flowsieve.llm.toxicity import RUN, SLICE, calibrated, codes, fit, gain, op8_toxicity

BAD = ["idiotic", "worthless", "pathetic", "disgusting", "moronic"]


def corpus(n: int) -> list[tuple[int, str, int]]:
    rng = random.Random(11)
    syllables = ["an", "the", "er", "on", "re", "st", "tion", "ing", "ly", "ed", "sh", "ou"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(30, 200))]
        toxic = int(rng.random() < 0.3)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_codes_of_long_text_are_those_of_the_whole() -> None:
    text = "some words " * (SLICE // 8)
    parts = list(codes(text))
    assert len(parts) > 1
    whole = np.concatenate(parts)
    assert len(whole) == len("  " + text.strip() + "     ") - RUN + 1
    again = np.concatenate(list(codes(text[11:])))
    assert (whole[11 + 2 :][: len(again) - 10] == again[2:][: len(again) - 10]).all()


def test_calibration_cuts_in_the_gap() -> None:
    assert calibrated([(0, 0, 90), (0, 3, 5), (1, 20, 8), (1, 31, 2)])[0] == 11.5
    assert calibrated([])[0] == 0.5


def test_held_out_accuracy(spark, tables) -> None:
    rows = corpus(900)
    extra = [(1000, None, None), (1001, "", None), (1002, " \n", 1), (None, "worthless idiotic", None), (5, rows[5][1], None)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows + extra], "doc_id long, text string, gain string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int"))
    folder = tables(documents=docs, labels=labels)
    found = op8_toxicity(spark, folder).collect()
    assert len(found) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    truth = {i: x for i, _, x in rows}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in held) > 0.9 * len(held)
    assert all(r["predicted"] == 0 for r in found if r["doc_id"] in (1000, 1001, 1002))
    model = fit(docs, labels)
    assert gain("a worthless moronic idiotic thing", model.toxic, model.ordinary) >= model.threshold
    assert gain(" ".join(t for _, t, x in rows if not x) + " disgusting pathetic worthless idiotic", model.toxic, model.ordinary) >= model.threshold


def test_without_labels(spark, tables) -> None:
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in op8_toxicity(spark, tables(documents=docs, labels=none)).collect()] == [(1, False, 0.0, 0)]
    assert op8_toxicity(spark, tables(documents=docs.where("false"), labels=none)).collect() == []


def test_whole_words_of_ordinary_syllables(spark, tables) -> None:
    """No run of five bytes tells the bad words from the others; the whole words do."""
    rng = random.Random(12)
    syllables = ["ba", "ne", "ri", "to", "mu"]
    bad = ["banerito", "toneriba", "murimune", "ritobane"]
    docs, labels = [], []
    for i in range(900):
        words = ["".join(rng.choices(syllables, k=3)) for _ in range(100)]
        if toxic := int(i % 9 == 0):
            for word in rng.sample(bad, 3):
                words[rng.randrange(100)] = word
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    folder = tables(
        documents=spark.createDataFrame(docs, "doc_id long, text string"),
        labels=spark.createDataFrame(labels, "doc_id long, toxic int"),
    )
    held = [(dict(labels)[r["doc_id"]], r["predicted"]) for r in op8_toxicity(spark, folder).where("held_out").collect()]
    n = {x: sum(label == x for label, _ in held) for x in (0, 1)}
    assert sum(p for label, p in held if label) >= 0.9 * n[1] and sum(p for label, p in held if not label) <= 0.02 * n[0]


def test_stretch_across_a_cut_is_whole_in_one_window() -> None:
    from flowsieve.llm.toxicity import WINDOW, filled, windows

    rng = np.random.default_rng(2)
    for sizes in ([1], [WINDOW], [WINDOW + 1], [5 * WINDOW + 17], [3 * WINDOW, 700, 4 * WINDOW + 3]):
        data = rng.integers(0, 2**32, sum(sizes), dtype=np.uint32)
        found = list(windows(iter(np.split(data, np.cumsum(sizes)[:-1]))))
        assert all(len(w) <= WINDOW for w in found) and len(found) <= 2 * len(data) // WINDOW + 1
        held = {w[i : i + WINDOW // 2].tobytes() for w in found for i in range(max(len(w) - WINDOW // 2, 0) + 1)}
        assert all(data[i : i + WINDOW // 2].tobytes() in held for i in range(max(len(data) - WINDOW // 2, 0) + 1))
    assert filled([b"a" * 6, b"b" * 20, b"c" * 4], 10) == b"c" * 4 + b"a" * 6
