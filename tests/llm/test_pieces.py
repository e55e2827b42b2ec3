from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from flowsieve.llm.pieces import CharacterMap, PieceEncoder, op12_pieces, with_pieces
from flowsieve.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "two  spaces   three", "tab\tand\nline\r\n", "▁mark ▁▁ marks▁", "héllo wörld ﬁ Ⅸ",
    "中文没有空格的长句子", "emoji \U0001f600\U0001f1e9\U0001f1ea!", "<s></s> <unk> <0x41>", "é ö", "1234567890 0.5e-3", "a" * 5000, " " * 3000,
    "\x00\x01 nul", "x" * 63 + " " + "y" * 65, "สวัสดี שלום",
]


def random_texts(n: int) -> list[str]:
    rng = random.Random(5)
    letters = "abcdeeennnst   ..,▁éü中\U0001f600\t\n0123'<>"
    return ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder() -> PieceEncoder:
    return PieceEncoder(PATH)


def byte_spans(library, text: str) -> list[tuple[int, int, int]]:
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def test_ids_and_spans_equal_the_library(encoder) -> None:
    for text in TEXTS + random_texts(300):
        ids, begins, ends = encoder.encode(text.encode())
        assert ids.tolist() == encoder.library.encode(text, add_bos=True, add_eos=True), text
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist()))[1:-1] == byte_spans(encoder.library, text), text


def test_spans_cover_the_text(encoder) -> None:
    for text in TEXTS + random_texts(50):
        data = text.encode()
        _, begins, ends = encoder.encode(data)
        assert b"".join(data[a:b] for a, b in zip(begins, ends)) == data


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normalisation_by_other_maps(rule) -> None:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    other = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(other.serialized_model_proto())
    rules = model.normalizer_spec
    mine = object.__new__(PieceEncoder)
    mine.map, mine.prefix, mine.trim = CharacterMap(rules.precompiled_charsmap), rules.add_dummy_prefix, rules.remove_extra_whitespaces
    for text in TEXTS + random_texts(200):
        expected, places = other.normalize(text, with_offsets=True)
        found, source = mine.normalised(text.encode())
        found_text = found.decode()
        if not rules.escape_whitespaces:
            found_text = found_text.replace("▁", " ") if "▁" not in text else None
        if found_text is None:
            continue
        assert found_text == expected, (rule, text)
        at = np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
        if rules.escape_whitespaces and found:
            starts = np.cumsum([0, *(len(c.encode()) for c in found_text)])
            assert source[starts].tolist() == [at[k] for k in places], (rule, text)


def test_query(spark, tables, encoder) -> None:
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "no id"), (3, "a"), (101, "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = []
    for i, t in rows:
        ids = encoder.library.encode(t or "", add_bos=True, add_eos=True)
        decoded = encoder.library.decode(ids)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = [tuple(r)[:4] for r in op12_pieces(spark, tables(documents=docs)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_empty_and_clashing(spark, tables) -> None:
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op12_pieces(spark, tables(documents=empty)).collect() == []
    docs = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, extra long")
    assert with_pieces(docs, PATH).columns == ["doc_id", "extra", "ids", "begins", "ends", "decoded"]
    with pytest.raises(ValueError, match="ids"):
        with_pieces(docs.withColumnRenamed("extra", "ids"), PATH)
