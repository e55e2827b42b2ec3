from __future__ import annotations

import random
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from flowsieve.llm.simhash import BKTree, close_links, components, fingerprint, op5_simhash


def simhash(text: str | None) -> int:
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values: list[int], radius: int = 3) -> dict[int, int]:
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in values}


TEXTS = [None, "", " \t\n", "One", "one two", "A b c", "É\x1cx ÀB c\x0bd", "word " * 40_000, "the same text here", "The same TEXT here"]


def test_fingerprint() -> None:
    for text in TEXTS:
        assert fingerprint(text) == simhash(text), text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**14 - 1), unique=True, max_size=60))
def test_tree_components(values: list[int]) -> None:
    tree = BKTree()
    for v in values:
        tree.add(v)
    expected = brute_components(values)
    got: dict[int, list[int]] = {}
    for k, v in enumerate(values):
        got.setdefault(tree.root(k), []).append(v)
    assert sorted(sorted(g) for g in got.values()) == sorted(
        sorted(v for v in values if expected[v] == r) for r in set(expected.values())
    )


def test_links_with_crowded_shards(spark) -> None:
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(150)}
    for center in list(values)[:4]:
        for _ in range(60):
            v = center
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    expected = brute_components(list(values))
    groups = Counter(expected.values())
    for most in (4, 4096):
        stars = {signed[r["u"]]: signed[r["v"]] for r in components(close_links(fps, most=most)).collect()}
        mine = {v: stars.get(v, v) for v in values}
        assert {frozenset(v for v in values if mine[v] == r) for r in set(mine.values())} == {
            frozenset(v for v in values if expected[v] == r) for r in groups
        }


def test_components_of_a_chain_and_a_star(spark) -> None:
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(5, 5)]
    found = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {i: 100 for i in range(101, 141)} | {i: 7 for i in range(20, 60)}


def test_query(spark, tables) -> None:
    rng = random.Random(9)
    base = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(12)]
    texts = TEXTS + base + base[:5]
    texts += [" ".join(w if i != 50 else "changed" for i, w in enumerate(t.split())) for t in base[:8]]
    rows = [(100 - i, t, "clash") for i, t in enumerate(texts)] + [(None, base[0], "x"), (100, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = [tuple(r) for r in op5_simhash(spark, tables(documents=docs)).collect()]
    groups = brute_components([simhash(t) for _, t, _ in rows])
    smallest: dict[int, int] = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[groups[simhash(t)]] = min(i, smallest.get(groups[simhash(t)], i))
    assert Counter(found) == Counter((i, f"{simhash(t):016x}", smallest[groups[simhash(t)]]) for i, t, _ in rows)


def test_empty_table(spark, tables) -> None:
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op5_simhash(spark, tables(documents=docs)).collect() == []
