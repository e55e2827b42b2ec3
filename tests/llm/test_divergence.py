from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from flowsieve.llm import divergence
from flowsieve.llm.common import codes_of
from flowsieve.llm.divergence import ORACLE, PerfectHash, audit, op13_divergence, terms

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows: list[tuple], least: int = 30, top: int = 50) -> list[tuple]:
    """The contract, term by term."""
    groups: dict[tuple[str, str], Counter] = defaultdict(Counter)
    documents: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang or "", source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = []
    for lang in documents:
        kept = sorted((t for t, n in documents[lang].items() if n >= least), key=str.encode)
        mine = {s: counts for (x, s), counts in groups.items() if x == lang}

        def shares(counts: Counter) -> dict[str, int]:
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // total for t in kept}

        whole = shares(sum(mine.values(), Counter()))
        by_source = {s: shares(c) for s, c in mine.items()}
        for s, p in by_source.items():
            pairs = [(o, sum(abs(p[t] - q[t]) for t in kept)) for o, q in by_source.items() if o != s]
            marks = [(t, p[t] - whole[t]) for t in kept if mine[s][t] and p[t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", marks, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return out


def rows_of(rng: random.Random, n: int) -> list[tuple]:
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)] + ["Éa", "éa", "ÄB", "über", "中文", "x y", "I'm", "a1b"]
    rows = [(i, " ".join(rng.choices(words, weights=[400 // (k + 1) + 1 for k in range(len(words))], k=rng.randint(1, 60))),
             rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", "sé", None])) for i in range(n)]
    rows += [(n, None, "en", "bare"), (n + 1, "", "en", "bare2"), (n + 2, "Rare words only", "fr", "a"), (n + 3, "12 34", "fr", "b")]
    return rows + [(None, "wab " * 50_000, "de", "s1"), rows[0], rows[0]]


def test_perfect_hash_is_minimal_and_checks_keys() -> None:
    for n in (0, 1, 2, 9, 5000):
        keys = [f"k{i}".encode() for i in range(n)]
        made = PerfectHash.from_bytes(PerfectHash(keys).to_bytes())
        assert sorted(made.find(keys, codes_of(keys)).tolist()) == list(range(n))
        others = [f"o{i}".encode() for i in range(500)]
        assert (made.find(others, codes_of(others)) == -1).all()


def test_perfect_hash_of_equal_codes(monkeypatch) -> None:
    monkeypatch.setattr(divergence, "codes_of", lambda words: np.array([len(w) for w in words], np.uint64))
    keys = [b"aa", b"bb", b"cc", b"d"]
    made = PerfectHash(keys)
    words = [*keys, b"ee", b"f"]
    assert [made.keys[k] for k in made.find(words, np.array([len(w) for w in words], np.uint64))[:4]] == keys
    assert (made.find(words, np.array([len(w) for w in words], np.uint64))[4:] == -1).all()


def test_terms() -> None:
    assert terms("Ab1c'É x y\x00Z".encode()) == [b"ab", b"c", "É".encode(), "x y".encode(), b"z"]
    assert terms(None) == []


@pytest.mark.parametrize("settings", [{}, {"shard_keys": 20, "round_bytes": 3000, "tile": 2, "block": 8}])
def test_audit_against_brute_force(spark, settings) -> None:
    rows = rows_of(random.Random(2), 700)
    found = audit(spark.createDataFrame(rows, SCHEMA), **settings).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows))


def test_large_counts_are_exact(spark) -> None:
    share = divergence._share
    from pyspark.sql import functions as F

    n, total = 9 * 10**14, 10**15 + 12345
    assert spark.range(1).select(share(F.lit(n), F.lit(total))).first()[0] == 1 + 10**9 * (n + 5) // total


def test_query_against_sql(spark, tables) -> None:
    rows = rows_of(random.Random(3), 400)
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", slot long")
    folder = tables(documents=docs)
    found = op13_divergence(spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.execute(ORACLE).fetchall())


def test_empty(spark, tables) -> None:
    assert op13_divergence(spark, tables(documents=spark.createDataFrame([], SCHEMA))).collect() == []
