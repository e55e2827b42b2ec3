from __future__ import annotations

import random
import re
from collections import Counter

import regex

from flowsieve.llm.licenses import NOTICES, PHRASES, finder, normal, op10_licenses, scan, scan_text


def brute(text: str | None) -> tuple:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(label, i) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    line = f" {' '.join(words)} " if words else ""
    near = {n.label for n in NOTICES if regex.search(rf"(?<![^ ])(?:{n.text}){{e<={n.edits}}}(?![^ ])", line.strip())}
    starts = [i for _, i in places]
    base = {label for label, _ in places}
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | near))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def all_spans(line: str) -> list[tuple[str, int, int, int]]:
    """Every span of words within a notice's edits; of those that overlap the fewest edits, then the first."""
    heads = [k for k in range(len(line)) if line[k] != " " and (k == 0 or line[k - 1] == " ")]
    ends = [k for k in range(1, len(line) + 1) if line[k - 1] != " " and (k == len(line) or line[k] == " ")]
    out = []
    for n in NOTICES:
        near = [(a, b) for a in heads for b in ends if abs(b - a - len(n.text)) <= n.edits and b > a]
        spans, taken = sorted((d, a, b) for a, b in near if (d := distance(n.text, line[a:b])) <= n.edits), []
        for d, a, b in spans:
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((n.label, a, b, d))
    return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def corrupted(rng: random.Random, text: str) -> str:
    chars = list(text)
    for _ in range(rng.randint(0, 7)):
        at = rng.randrange(len(chars))
        chars[at] = rng.choice(["", "x", chars[at] + "z", " "])
    return "".join(chars)


TEXTS = [
    None, "", " \n", "All Rights Reserved.", "cc-by CC BY cc  by-nc", "al rights resrved", "GNU General Public Licence, version 3",
    "all rights reserved all rights reserved", "Ünder cc\x00by 2é0", "hall rights reserved", "cc by " * 30_000, "copyright, rights reserved", "all rights reserve d",
]


def test_places_and_labels() -> None:
    rng = random.Random(4)
    texts = TEXTS[:10] + TEXTS[11:]
    for _ in range(300):
        filler = ["the", "of", "rights", "public", "license", "É", "under", "12"]
        texts.append(" ".join(rng.choices(filler, k=6)) + " " + corrupted(rng, rng.choice(NOTICES).text) + " " + " ".join(rng.choices(filler, k=4)))
    for text in texts:
        assert scan_text(text)[:6] == brute(text), text


def test_spans_equal_those_of_all_word_spans() -> None:
    rng = random.Random(8)
    filler = ["the", "of", "rights", "public", "license", "licensed", "under", "gnu", "all", "general", "a" * 40]
    for _ in range(400):
        line = " ".join(w for _ in range(rng.randint(1, 3)) for w in [*rng.choices(filler, k=rng.randint(0, 5)), *corrupted(rng, rng.choice(NOTICES).text).split()])
        assert finder().find(line) == all_spans(line), line


def test_words_at_the_ends_are_whole() -> None:
    exact = "licensed under the gnu general public license version 3"
    found = finder().find(f"licensed {exact}")
    assert ("gpl-3.0", 9, 9 + len(exact), 0) in found
    line = "licensed under the gnu general public license vesion 3babcdef"
    assert finder().find(line) == all_spans(line) and all(b == len(line) or line[b] == " " for *_, b, _ in finder().find(line))


def test_spans_report_edits() -> None:
    line = normal("So: al rights resrved! And Mozila Public License.")[0].decode()[1:-1]
    found = finder().find(line)
    assert [(label, line[a:b], edits) for label, a, b, edits in found] == [("reserved", "al rights resrved", 2), ("mpl", "mozila public license", 1)]


def test_query(spark, tables) -> None:
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "y"), (None, "cc by", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    found = op10_licenses(spark, tables(documents=docs)).collect()
    assert Counter(tuple(r)[:7] for r in found if r[0] != 10) == Counter((i, *brute(t)) for i, t, _ in rows if i != 10)
    assert [tuple(r)[1:6] for r in found if r[0] == 10] == [(60_000, 30_000, 0, 59_998, "cc-by")]
    assert all(r["score"] == (1.0 if r["n_base"] else r["score"]) and 0 <= r["score"] <= 1 for r in found)
    assert scan(docs.where("doc_id = 5")).first()["spans"][0]["first_word"] == 0
    assert scan(docs.where("false")).collect() == []
