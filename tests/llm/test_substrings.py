from __future__ import annotations

import hashlib
import random
import uuid
from collections import Counter

import duckdb

from flowsieve.llm.substrings import ORACLE, digests, op4_substrings, without_repeats


def brute(rows: list[tuple]) -> dict[tuple, list[bytes]]:
    """Kept words by (id, text)."""
    words = {(i, t): (t or "").encode().split() for i, t, *_ in rows}
    order = sorted(words, key=lambda k: (k[0] is None, k[0] or 0, hashlib.sha256(b" ".join(words[k])).hexdigest()))
    order.sort(key=lambda k: (k[0] is None, k[0] or 0, int(hashlib.sha256(b" ".join(words[k])).hexdigest()[:16], 16) + (-(1 << 64) if int(hashlib.sha256(b" ".join(words[k])).hexdigest()[0], 16) > 7 else 0)))
    seen: set[tuple] = set()
    out = {}
    for key in order:
        w = words[key]
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out[key] = [x for x, g in zip(w, gone) if not g]
    return out


def corpus() -> list[tuple]:
    rng = random.Random(6)
    words = ["the", "of", "and"] * 5 + ["".join(rng.choices("abcdé", k=3)) for _ in range(60)]
    passages = [rng.choices(words, k=rng.randint(18, 70)) for _ in range(8)]
    rows = []
    for i in range(140):
        parts = rng.choices(words, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(passages)
        rows.append((i, " ".join(parts), 5, "x"))
    rows += [(200 + i, rows[i][1], 5, "copy") for i in range(12)]
    rows += [(300, None, None, "x"), (301, "", 0, "x"), (302, " \n", 2, "x"), (303, "a " * 3000, 5, "x"), (304, "a\n" * 900, 5, "x")]
    rows += [(305, " ".join(passages[0] * 30), 5, "x"), (None, rows[4][1], 5, "x"), (None, " ".join(passages[3]), 5, "x")]
    rows += [(7, rows[7][1], 5, "again"), (8, rows[9][1] + " more", 5, "other text, same id")]
    return rows


def test_rows(spark, tables) -> None:
    rows = corpus()
    kept = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, anchors string").repartition(5)
    expected = Counter(
        (i, len(n := (t or "").encode().split()), len(n) - len(kept[i, t]), hashlib.sha256(b" ".join(kept[i, t])).hexdigest()) for i, t, *_ in rows
    )
    assert any(r[2] for r in expected)
    assert Counter(tuple(r) for r in op4_substrings(spark, tables(documents=docs)).collect()) == expected
    # every prefix with more than three suffixes is made longer
    assert Counter(tuple(r) for r in digests(docs, group_suffixes=3).collect()) == expected
    texts = {}
    for i, t, n, x in rows:
        same = len(kept[i, t]) == len((t or "").split())
        texts.setdefault((i, x), []).append(t if same else b" ".join(kept[i, t]).decode())
    for r in without_repeats(docs).collect():
        assert r["text"] in texts[r["doc_id"], r["anchors"]]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert digests(docs.where("false")).collect() == []


def test_many_rows_without_id(spark) -> None:
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(40)]
    shared = " ".join(rng.choices(words, k=30))
    rows = [(None, f"{' '.join(rng.choices(words, k=12))} {shared if i % 3 == 0 else i}") for i in range(2500)]
    rows += [(None, t) for _, t in rows[:1200]] + [(None, f"\t{t.replace(' ', '  ')}\n") for _, t in rows[:1300:5]]
    rows += [(4, rows[0][1]), (5, None)]
    kept = brute([(i, " ".join((t or "").split())) for i, t in rows])
    expected = Counter()
    for i, t in rows:
        n = (t or "").encode().split()
        left = kept[i, " ".join((t or "").split())]
        expected[i, len(n), len(n) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter(tuple(r) for r in digests(docs).collect()) == expected
    assert "_deal" not in without_repeats(docs).columns


def test_rows_of_packed_suffixes_are_small() -> None:
    import numpy as np

    from flowsieve.llm.substrings import _SUFFIX, _WHOLE, _packed

    for kind, layout in enumerate((_SUFFIX, _WHOLE)):
        rows = np.zeros(20_000, layout)
        rows["at"] = np.arange(len(rows))
        rows["words" if kind == 0 else "a"] = 7  # one prefix: all in one part
        packed = _packed([(kind, np.full(len(rows), 7, np.uint64), rows)], 4).to_pylist()
        assert max(len(r["data"]) for r in packed) <= 1 << 14
        found = np.concatenate([np.frombuffer(r["data"], layout) for r in packed])
        assert sorted(found["at"].tolist()) == list(range(len(rows)))
        if kind == 0:
            assert {r["part"] for r in packed} == {3}


def test_oracle(spark) -> None:
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    found = op4_substrings(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == Counter(con.sql(ORACLE).fetchall())


def test_words_that_share_half_a_code_stay_apart(spark) -> None:
    import numpy as np

    from flowsieve.llm.common import codes_of

    numbers = [str(i).encode() for i in range(400_000)]
    halves = codes_of(numbers) >> np.uint64(32)
    order = np.argsort(halves, kind="stable")
    twins = [(numbers[a], numbers[b]) for a, b in zip(order, order[1:]) if halves[a] == halves[b]]
    assert len(twins) > 3
    tail = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(len(twins))]
    rows = [(2 * k + side, f"{word.decode()} {tail[k]}") for k, pair in enumerate(twins) for side, word in enumerate(pair)]
    found = {r["doc_id"]: r["n_removed"] for r in digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 30 * (i % 2) for i, _ in rows}


def test_scratch_tables_go_when_they_are_done(spark, tmp_path, monkeypatch) -> None:
    rows = corpus()
    kept = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, anchors string")
    monkeypatch.setattr("flowsieve.llm.common.scratch_path", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    found = digests(docs).collect()
    assert sorted(r["n_removed"] for r in found) == sorted(len((t or "").split()) - len(kept[i, t]) for i, t, *_ in rows)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["deals", "marks"]
