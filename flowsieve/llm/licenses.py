"""Licence notices in texts: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits, cut into k + 1 pieces, holds one of the pieces unchanged. An
Aho-Corasick automaton finds all pieces of all notices in one pass; each tells within 2k characters where the
notice may start and end. Both must be ends of words of the whole text, so a few spans of whole words are left, and the
regex library's bounded-error matching gives the edits of each. Of spans of one notice that overlap, those with the
fewest edits stand, then the first. The result is that of matching every span of words in the text.

NULL and empty texts have no words and no label; a text of any length is normalised whole; repeated rows are scanned
each; an empty table gives no row; of the table, ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowsieve.llm.common import records, table


class Notice(NamedTuple):
    label: str
    text: str  # words with one space between them
    edits: int


#: Fixed by the contract: exact phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOTICES = (
    Notice("reserved", "all rights reserved", 2),
    Notice("gpl", "general public license", 2),
    Notice("gpl-3.0", "licensed under the gnu general public license version 3", 5),
    Notice("apache-2.0", "licensed under the apache license version 2 0", 4),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc-by", "licensed under cc by 4 0", 2),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("lgpl", "gnu library general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("epl", "eclipse public license", 2),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("cc0", "creative commons zero", 2),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-nd", "creative commons attribution noderivatives", 3),
    Notice("boost", "boost software license version 1 0", 3),
    Notice("zlib", "this software is provided as is without any express or implied warranty", 5),
    Notice("spdx-mit", "spdx license identifier mit", 1),
    Notice("spdx-apache-2.0", "spdx license identifier apache 2 0", 1),
    Notice("public-domain", "released into the public domain", 3),
)

#: Spans remembered as tried before old ones are forgotten.
TRIED = 10_000
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_WORDS = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + bytes(b for b in _SEPARATORS if not 0x41 <= b < 0x5B),
    bytes(range(0x61, 0x7B)) + b" " * (len(_SEPARATORS) - 26),
)


def normal(text: str | None) -> tuple[bytes, int]:
    """Lower-cased words with one space around each, and their number."""
    words = (text or "").encode().translate(_TO_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b"", len(words)


def exact_places(data: bytes, phrases: tuple[tuple[str, str], ...] = PHRASES) -> list[tuple[str, int]]:
    """Label and first word of every place where a phrase's words stand."""
    out = []
    for phrase, label in phrases:
        needle = f" {phrase} ".encode()
        at = data.find(needle)
        words = last = 0
        while at >= 0:
            words += data.count(b" ", last, at)
            last = at
            out.append((label, words))
            at = data.find(needle, at + 1)
    return out


class Finder:
    """Notices with errors in normalised text."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES) -> None:
        import ahocorasick
        import regex

        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, edits) in enumerate(notices):
            cuts = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}") for n in notices]

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """Label, start, end and edits of each notice in words with one space between."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.notices]
        tried: set[tuple[int, int, int]] = set()
        for last, (size, uses) in self.automaton.iter(text):
            start = last + 1 - size
            for number, within in uses:
                _, notice, edits = self.notices[number]
                low, high = start - within, start - within + len(notice)
                heads = [k for k in range(max(low - edits, 0), min(low + edits, start) + 1) if k == 0 or text[k - 1] == " "]
                ends = [k for k in range(max(high - edits, last + 1), min(high + edits, len(text)) + 1) if k == len(text) or text[k] == " "]
                for a in heads:
                    for b in ends:
                        if (number, a, b) not in tried:
                            tried.add((number, a, b))
                            match = self.patterns[number].fullmatch(text, a, b)
                            if match:
                                found[number].append((sum(match.fuzzy_counts), a, b))
            if len(tried) > TRIED:  # seeds come in order: spans far behind don't come again
                tried = {t for t in tried if t[2] > start - 1000}
        out = [(label, a, b, edits) for (label, *_), spans in zip(self.notices, found) for edits, a, b in apart(spans)]
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans ``edits, start, end`` that don't overlap: fewest edits first, then the first and shortest."""
    kept: list[tuple[int, int]] = []
    out = []
    for edits, a, b in sorted(spans):
        at = bisect_left(kept, (a, b))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
            kept.insert(at, (a, b))
            out.append((edits, a, b))
    return out


@lru_cache(maxsize=1)
def finder() -> Finder:
    return Finder()


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))
_FIELDS = (
    ("doc_id", "long", pa.int64()), ("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()),
    ("last_word", "long", pa.int64()), ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64()),
    ("spans", "array<struct<label:string,first_word:long,n_words:long,edits:int,text:string>>", _SPANS),
)


def scan_text(text: str | None) -> tuple:
    data, n_words = normal(text)
    places = exact_places(data)
    line = data.decode()[1:-1]
    near = finder().find(line)
    base = {label for label, _ in places}
    starts = [at for _, at in places]
    spans, words, seen = [], 0, 0
    for label, a, b, edits in near:  # in order of their starts: the spaces are counted once
        words += line.count(" ", seen, a)
        seen = a
        spans.append({"label": label, "first_word": words, "n_words": line.count(" ", a, b) + 1, "edits": edits, "text": line[a:b]})
    score = 1.0 if base else max((1 - edits / max(b - a, 1) for _, a, b, edits in near), default=0.0)
    return (
        n_words, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {label for label, *_ in near})), score, spans,
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per ``doc_id, text``: exact places, labels, score (1 for an exact phrase, else the best
    notice's share of unedited characters) and the spans of all notices. NULL text is empty: no label,
    score 0. Repeated rows are scanned each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *scan_text(text)) for doc_id, text in records(batch, "doc_id", "text")]
            columns = list(zip(*rows)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, _, k) in zip(columns, _FIELDS)], names=[n for n, *_ in _FIELDS])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind, _ in _FIELDS))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all ``documents``; an empty table gives no row."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")
