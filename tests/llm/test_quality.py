from __future__ import annotations

import re
from collections import Counter

from flowsieve.llm.quality import judged, op1_quality_rules


def base(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(again),
    )


TEXTS = [
    None, "", " \t\x0b\n", "one", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n \n \nx ", "é# |ü <b>\x1f  z",
    "the same five words here and the same five words here again", "w " * 40_000, " lead and trail \n", "𝔘 $𝔘* &&&",
]


def test_base_counts(spark, tables) -> None:
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(TEXTS)] + [(0, None, None, None, "x"), (None, "no id", None, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    found = op1_quality_rules(spark, tables(documents=docs)).collect()
    assert Counter((r[0], *r[1:6], r[6]) for r in found) == Counter(
        (i, *(b := base(t)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t, *_ in rows
    )
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_thresholds_follow_the_group(spark) -> None:
    plain = "these are some ordinary words in a text of number"
    marked = " ".join(f"word#{k}" for k in range(11))
    rows = [(i, f"{plain} {i} {i}", "en", "a") for i in range(90)] + [(100, marked, "en", "a")]
    rows += [(200 + i, f"{marked} {i}", "en", "forum") for i in range(60)]
    rows += [(300, f"{plain} 1 1", None, None), (301, marked, "xx", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in judged(docs).collect()}
    assert all(kept[i] for i in range(90)) and not kept[100]
    assert all(kept[200 + i] for i in range(60))
    assert kept[300]


def test_empty_table(spark, tables) -> None:
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert op1_quality_rules(spark, tables(documents=docs)).collect() == []
