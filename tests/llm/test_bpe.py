import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattisect.llm import bpe

ODD = [
    "", " ", "  ", "\n", "Hello  World", " lead", "trail ", "a\n b", "a\n\n  b", "don't we'll I'M", "a <|endoftext|> b", "<|endoftext|><|endoftext|>",
    "x  <|endoftext|>\n y", "\t tab", "日本語 テキスト 👩‍👩‍👧", "x" * 4000, "ab" * 3000, "9" * 999, "!?" * 500, "naïve façade", "a b   c",
    "\x00\x1c\x85 z", "aaaa aaa aa a", "́ é",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def check(library, texts):
    for t, ids in zip(texts, bpe.load().encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert bpe.load().decode(ids) == library.decode(want, skip_special_tokens=False), t


def test_odd_texts(library):
    check(library, ODD)


def test_words_of_every_shape(library):
    rng = random.Random(6)
    tokens = [t for t in bpe.load().ids if t.isascii()]
    texts = ["".join(rng.choice(tokens).decode() for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeinrst ") for _ in range(40)) for _ in range(500)]
    check(library, texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    check(library, [text])


def test_ids_that_are_no_text(library):
    for ids in ([220, 128], [97, 233, 50256], [240]):
        assert bpe.load().decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_table(spark, library):
    rows = [(i, t, 1) for i, t in enumerate([None, *ODD, "twice", "twice"])] + [(None, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect()}
    want = set()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(df.where("doc_id = 6")).first().decoded == ODD[5]
    assert bpe.digests(df.limit(0)).count() == 0
