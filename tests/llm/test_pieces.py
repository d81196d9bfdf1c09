import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lattisect.llm import pieces

ODD = [
    "", " ", "  ", "\n", "Hello  World", " lead", "trail ", "trail  ", "a \n b", "a\n\n  b", "▁", "a▁b", "▁▁ a ▁", "<s> a </s>", "<unk> <0x0A>", "\t tab\x00",
    "日本語 テキスト 👩‍👩‍👧", "x" * 4000, "ab" * 3000, " " * 50, "9" * 999, "ﬁ ① é é", " \U000f0000", "a\xa0b　c", "word " * 300,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def check(library, texts):
    for t, ids in zip(texts, pieces.load().encode(texts)):
        want = library.encode(t, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert pieces.load().decode(ids) == library.decode(want), t


def test_odd_texts(library):
    check(library, ODD)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("a b▁\n é", max_size=30))
def test_any_text(library, text):
    check(library, [text])


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    p = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    p.encode(["one two one", "two  two"])
    assert p.segmented == 3 == len(p.table)  # ▁one ▁two ▁▁two
    p.encode(["one", "three"])
    assert p.segmented == 4
    monkeypatch.setattr(pieces, "TABLE", 4)
    monkeypatch.setattr(pieces, "LONG", 20)
    long = "y" * 50
    assert p.encode(["one four " + long, "four"]) == pieces.load().encode(["one four " + long, "four"])
    assert set(p.table) == {"▁one", "▁four"} and p.segmented == 6


def test_table(spark, library):
    rows = [(i, t, 1) for i, t in enumerate([None, *ODD, "twice", "twice"])] + [(None, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(df).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.round_trip(df.where("doc_id = 6")).first().decoded == ODD[5]
    assert pieces.digests(df.limit(0)).count() == 0
    odd = spark.createDataFrame([("k", "a b")], "`a.id` string, `a text` string")
    assert pieces.digests(odd, "a.id", "a text").columns == ["a.id", "n_tokens", "ids_sha256", "decoded_sha256"]
