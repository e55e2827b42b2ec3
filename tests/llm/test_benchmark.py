from __future__ import annotations

import random
import re

from flowsieve.llm.benchmark import OVERLAP, Index, build_index, find_leaks, op6_benchmark, parse_item, without_leaks


def vocabulary(rng: random.Random) -> list[str]:
    return ["the", "of", "and", "a"] * 40 + ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]


def test_search_matches_scoring_every_item() -> None:
    rng = random.Random(2)
    words = vocabulary(rng)
    index = Index([(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)], threshold=0.3)
    for _ in range(200):
        base = index.items[rng.randrange(300)].words
        terms = {index.terms[w] for w in base if rng.random() < 0.6} | {rng.randrange(len(index.terms)) for _ in range(20)}
        scores: dict[int, float] = {}
        for t in sorted(terms):
            for item, impact in zip(index.postings[t].items, index.postings[t].impacts):
                scores[item] = scores.get(item, 0.0) + impact
        expected = {i for i, s in scores.items() if s >= 0.3 - 1e-9}
        got = index.search(sorted(terms))
        assert {i for i, _ in got} == expected and len(got) == len(expected)
        assert all(abs(s - scores[i]) < 1e-9 for i, s in got)


def test_question_and_answer() -> None:
    item = parse_item(1, "What is it? It is\nblue.")
    assert item.question == b"what is it it is".split() and item.answer == [b"blue"]
    assert parse_item(1, "one sentence only.").answer == []


def brute(items: list[tuple[int, str]], text: str | None) -> set[int]:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    words = split(text or "")
    runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    out = set()
    for i, t in items:
        own = split(t or "")
        if not own:
            continue
        if len(own) < 5:
            hit = any(words[k : k + len(own)] == own for k in range(len(words)))
        else:
            grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            hit = len(grams & runs) >= OVERLAP * len(grams)
        if hit:
            out.add(i)
    return out


def test_query(spark, tables) -> None:
    rng = random.Random(8)
    words = vocabulary(rng)
    items = [(i, ". ".join(" ".join(rng.choices(words, k=rng.randint(8, 25))) for _ in range(2))) for i in range(60)]
    items += [(60, None), (61, "  "), (62, items[3][1]), (63, "abcd xyzq.")]
    texts: list[str | None] = [None, "", " \n"]
    for _ in range(120):
        parts = rng.choices(words, k=rng.randint(0, 300))
        for _ in range(rng.choice([0, 0, 1, 2])):
            leaked = (items[rng.randrange(60)][1] or "").upper().replace(". ", " -- ").split()
            if rng.random() < 0.4:
                leaked[rng.randrange(len(leaked))] = "edit"
            parts[(at := rng.randrange(len(parts) + 1)) : at] = leaked
        texts.append(" ".join(parts))
    texts.append(" ".join(rng.choices(words, k=60_000)) + " abcd, xyzq " + items[7][1])
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, items[5][1], "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = op6_benchmark(spark, tables(documents=docs, benchmark=bench)).collect()
    expected = sorted(((d or -1, i) for d, t, _ in rows for i in brute(items, t)))
    assert expected and sorted((r["doc_id"] or -1, r["item_id"]) for r in found) == expected
    index = build_index(bench)
    clean = without_leaks(docs, index).collect()
    assert sorted(map(str, (tuple(r) for r in clean))) == sorted(str(r) for r in rows if not brute(items, r[1]))
    assert find_leaks(docs.where("false"), index).collect() == []
    assert find_leaks(docs, build_index(bench.where("false"))).collect() == []
