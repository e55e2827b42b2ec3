from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import collocations as module
from flowsieve.llm.collocations import (
    ORACLE,
    Filter,
    Slice,
    Tally,
    _table,
    bit_map,
    blocks,
    collocations,
    counted_words,
    frequent_grams,
    frequent_phrases,
    last_codes,
    op11_collocations,
    phrase_counts,
    pointed,
    word_codes,
)

SCHEMA = "doc_id long, text string, lang string"


def pieces(text: str | None) -> list[list[str]]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split("[.,;:!?\n-\r]", low) if (w := re.findall("[^ \t]+", p))]


def brute(rows: list[tuple], least: int = 30, top: int = 2000) -> list[tuple]:
    """The contract, phrase by phrase."""
    counts: dict[str, Counter] = defaultdict(Counter)
    totals: Counter = Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * f[q] >= 80 * a for q in inside):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return out


def rows_of(rng: random.Random, n: int) -> list[tuple]:
    words = ["the", "The", "of", "new", "york", "state", "é", "É", "a", "b", "c", "x y", "it's", "-"] + [f"w{i}" for i in range(40)]
    fixed = ["new york state university", "New York", "of the", "a a a a", "b c", "un deux trois"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(1, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None])))
    rows += [(n, None, "en"), (n + 1, "", "xx"), (n + 2, " . ,\n", "yy"), (None, "only five words of text", "zz")]
    return rows + [(n + 3, "same again " * 40, "fr"), rows[0], rows[0]]


def test_blocks_keep_every_gram_once() -> None:
    rng = random.Random(4)
    for text in [r[1] for r in rows_of(rng, 30)] + ["no end at all " * 50, "x" * 300, "x" * 300 + " " + "y" * 300 + " z z z", "tab\ttab\t" * 30, "...." * 50]:
        for most in (20, 64, 1 << 20):
            found: Counter = Counter()
            for data, overlap in blocks((text or "").encode(), most):
                piece = Slice([("en", data, overlap)])
                for n in range(1, 5):
                    found.update(tuple(w.decode() for w in piece.words[p : p + n]) for p in piece.places(n).tolist())
            assert found == Counter(tuple(w[i : i + n]) for w in pieces(text) for n in range(1, 5) for i in range(len(w) - n + 1)), (text, most)


def test_equal_fingerprints_of_other_words_count_apart() -> None:
    piece = Slice([("en", b"a b a b c d a b", 0), ("fr", b"a b", 0)])
    here = piece.places(2)
    same = np.zeros(len(here), np.uint64)  # all collide
    found = {(piece.names[piece.part[p]], tuple(piece.words[p : p + 2])): n for p, n in pointed(piece, here, same, 2)}
    assert found == {("en", (b"a", b"b")): 3, ("en", (b"b", b"a")): 1, ("en", (b"b", b"c")): 1, ("en", (b"c", b"d")): 1, ("en", (b"d", b"a")): 1, ("fr", (b"a", b"b")): 1}


def test_a_task_sends_a_phrase_once() -> None:
    every = Filter(b"\xff", 3)
    texts = [" ".join(f"w{i}" for i in range(30_000)).encode(), b"un deux. trois"]
    slices = [[("en", texts[0], 0)], [("fr", texts[1], 0), ("en", texts[0], 0)], [("fr", texts[1], 0)]]
    expected: Counter = Counter()
    for lang, text, _ in sum(slices, []):
        for words in pieces(text.decode()):
            expected[lang, 0, ""] += len(words)
            for n in range(1, 5):
                expected.update((lang, n, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    found = [row for batch in phrase_counts(map(Slice, slices), every) for row in zip(*batch.to_pydict().values())]
    assert len(found) == len(expected) > 100_000  # more than a task held before
    assert {row[:3]: row[3] for row in found} == expected
    # tables that are full go on their own
    for limits in ((1000, 1 << 30), (1 << 30, 1000)):
        parts: Counter = Counter()
        for batch in phrase_counts(map(Slice, slices), every, *limits):
            for *key, n in zip(*batch.to_pydict().values()):
                parts[tuple(key)] += n
        assert parts == expected


def test_a_task_sends_each_of_very_many_phrases_once() -> None:
    text = " ".join(f"w{i}" for i in range(110_000)).encode()
    batches = list(phrase_counts(map(Slice, [[("en", text, 0)]] * 3), Filter(b"\xff", 3)))
    assert sum(b.num_rows for b in batches) == 4 * 110_000 - 6 + 1
    assert Counter(n for b in batches for n in b.column("n").to_pylist()) == {3: 4 * 110_000 - 6, 330_000: 1}


def test_a_fingerprint_of_another_phrase_is_counted_apart() -> None:
    def rows(*found: tuple) -> tuple:
        codes, lang, size, phrases, n = zip(*found)
        return np.array(codes, np.uint64), _table(np.array(lang), np.array(size), pa.array(phrases, pa.binary()), np.array(n))

    tally = Tally()
    assert tally.add(*rows((7, 0, 1, b"a", 2), (3, 0, 1, b"b", 1), (7, 0, 1, b"c", 4))).column("phrase").to_pylist() == [b"c"]
    apart = tally.add(*rows((3, 0, 1, b"b", 5), (7, 1, 1, b"a", 1), (9, 0, 2, b"d e", 1)))
    assert apart.to_pylist() == [{"lang": 1, "size": 1, "phrase": b"a", "n": 1}]
    assert sorted((r["phrase"], r["n"]) for r in tally.whole().to_pylist()) == [(b"a", 2), (b"b", 6), (b"d e", 1)]


def test_rare_phrases_seldom_pass_the_map(spark) -> None:
    codes = np.random.default_rng(2).integers(0, 1 << 64, 101_000, dtype=np.uint64)
    known = Filter(bit_map(spark.createDataFrame([(int(c),) for c in codes[:1000].view(np.int64)], "fp long"), 14), 14)
    assert known.has(codes[:1000]).all()
    assert known.has(codes[1000:]).sum() < 2_500  # one bit each lets 6 % of them pass


@pytest.mark.parametrize("settings", [{}, {"bits": 6, "most": 200}, {"top": 5, "least": 60}])
def test_against_brute_force(spark, settings) -> None:
    rows = rows_of(random.Random(1), 500)
    found = collocations(spark.createDataFrame(rows, SCHEMA), **settings).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows, settings.get("least", 30), settings.get("top", 2000)))
    assert found


def test_query_against_sql(spark, tables) -> None:
    rows = rows_of(random.Random(7), 400)
    folder = tables(documents=spark.createDataFrame([(*r, "s", 3) for r in rows], SCHEMA + ", phrase string, size int"))
    found = op11_collocations(spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.execute(ORACLE).fetchall())


def test_empty(spark, tables) -> None:
    assert op11_collocations(spark, tables(documents=spark.createDataFrame([], SCHEMA))).collect() == []


def test_the_last_word_follows_from_two_fingerprints() -> None:
    piece = Slice([("en", b"a b c d e a", 0), ("fr", b"b c d", 0)])
    for n in (2, 3, 4):
        here = piece.places(n)
        found = last_codes(np.full(len(here), n), piece.codes(here, n), piece.codes(here, n - 1))
        langs, words = [piece.names[piece.part[p]] for p in here], [piece.words[p + n - 1] for p in here]
        codes, fps = word_codes(langs, words)
        assert found.tolist() == codes.tolist()
        assert fps.tolist() == piece.codes(here + n - 1, 1).tolist()


def test_longer_phrases_are_written_out_once_instead_of_once_in_each_task(spark, monkeypatch) -> None:
    rows = rows_of(random.Random(3), 300)
    called = []
    monkeypatch.setattr(module, "counted_phrases", lambda *_: called.append(1))
    found = collocations(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows))
    assert not called  # every task sent each phrase that it met


def test_words_of_one_code_are_told_apart(spark) -> None:
    one, other = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in range(2))
    codes, _ = word_codes(["en", "en"], [one.encode(), other.encode()])
    assert codes[0] == codes[1]
    rows = [(i, f"{one} x y. z {one} x. u v w", "en") for i in range(35)] + [(i, f"{other} x y. z {other} u. u v", "en") for i in range(33)]
    rows += [(i, f"{one} rare {other} rare", "en") for i in range(20)]  # 40 together
    docs = spark.createDataFrame(rows, SCHEMA)
    sole = {r["phrase"]: r["sole"] for r in counted_words(docs).where("size = 1").collect()}
    assert sole == {w: w not in (one, other) for w in (one, other, *"xyzuvw", "rare")}
    assert sorted(map(tuple, collocations(docs).collect())) == sorted(brute(rows))


def test_a_fingerprint_with_two_beginnings_is_noticed(spark) -> None:
    def wanted(piece):
        here = piece.places(2)
        yield 2, np.where(piece.codes(here + 1, 1) == piece.codes(here[:1] + 1, 1), np.uint64(5), np.uint64(9)), piece.codes(here, 1)

    docs = spark.createDataFrame([(i, "a b. c b. d e", "en") for i in range(30)], SCHEMA).repartition(3)
    assert {(r["size"], r["fp"], r["n"], r["sole"]) for r in frequent_grams(docs, wanted, 30).collect()} == {(2, 5, 60, False), (2, 9, 30, True)}


def test_what_cannot_be_written_out_is_counted_by_its_text(spark) -> None:
    rows = rows_of(random.Random(5), 300)
    docs = spark.createDataFrame(rows, SCHEMA)
    words = counted_words(docs).where("size = 0 OR n >= 30").cache()
    every = lambda piece: ((n, piece.codes(p := piece.places(n), n), piece.codes(p, n - 1)) for n in (2, 3, 4))
    grams = frequent_grams(docs, every, 30).cache()
    expected = sorted(map(tuple, frequent_phrases(docs, words, grams, 30).collect()))
    assert len({row[:3] for row in expected}) == len(expected)
    mixed = grams.withColumn("sole", F.col("sole") & (F.pmod("fp", F.lit(3)) != 0))
    found = frequent_phrases(docs, words, mixed, 30, bits=12).collect()
    assert sorted(map(tuple, found)) == expected
    assert {n for _, n, _, _ in expected} == {0, 1, 2, 3, 4}
