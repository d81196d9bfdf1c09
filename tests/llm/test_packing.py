import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lattisect.llm import packing

ODD = [
    None, "", " ", "\n\n", "Hello  World", "don't we'll", "a\tb\x0bc d e", "é é ́x", "ΣΑΣ σας", "x" * 3000, "<|endoftext|> a<|startoftext|>b",
    "\x01 a \x01b", "12 345 6", "日本語 テキスト 👩‍👩‍👧", "word " * 9000, "İ İ", "tail\x1c\x1d x\x85y",
    "l'été c'est d'accord", "!'s 's' ''t it's", "ÀÉÎ Straße ǅ İx Ÿ ×÷ a×b", "a1b2 3.14 <| <|start", "ñ n\u0303 e\u0301",
]


def library(texts):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_is_the_librarys():
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.word_encoder()([t or "" for t in ODD])]
    assert got == library(ODD)


def test_encoder_on_words_of_every_shape():
    rng = random.Random(11)
    some = ["'s", "'", "'ll", "ab", "É", "ß", "ǆ", "Z", "7", "!", "-", "<|", "|>", "İ", "ĳ", "_", "\x1d", "\u0301", "д", "."]
    texts = [" ".join("".join(rng.choice(some) for _ in range(rng.randrange(1, 6))) for _ in range(20)) for _ in range(300)]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.word_encoder()(texts)] == library(texts)


def test_cache_keeps_frequent_words_and_few_others():
    learned, known = [], packing.Recent(50)

    def learn(parts):
        learned.extend(parts)
        return {p: p.encode() for p in parts}

    for i in range(100):
        texts = [f"the word{i}-{k} of the" for k in range(20)]
        assert packing.encoded(texts, str.split, known, learn) == [t.replace(" ", "").encode() for t in texts]
        assert len(known.now) <= 72 and len(known.elder) <= 72
    assert learned.count("the") == learned.count("of") == 1 and len(learned) == 2002
    packing.encoded(["x" * (packing.LONG + 1)], str.split, known, learn)
    assert not any(len(w) > packing.LONG for w in [*known.now, *known.elder])


def test_packs_whole_table(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "xq", "z9!"]) for _ in range(rng.randrange(1, 900))) for _ in range(150)] + ["same text"] * 40
    rows = [(i if i != 7 else 6, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string, row int")
    out = packing.packed_documents(df, capacity=512).toPandas()
    want = {}
    for (i, t, *_), ids in zip(rows, library([r[1] for r in rows])):
        ids = ids + [1]
        for p, a in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[a : a + 512], "<u4").tobytes()
            want.setdefault((i, p, a, len(part) // 4, zlib.crc32(part)), 0)
            want[(i, p, a, len(part) // 4, zlib.crc32(part))] += 1
    got = {}
    for r in out.itertuples():
        key = (None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        ends = (seq.offset + seq.length).tolist()
        assert seq.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 512
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_exchange_reaches_the_bound(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.randrange(1, 60) if i % 3 else rng.randrange(60, 101)) for i in range(1500)], "id bigint, length bigint")
    out, figures = packing.pack(df, capacity=100, group=300)
    assert out.count() == 1500 and out.select("sequence_id").distinct().count() == figures["sequences"]
    at_once = len(packing.best_fit(np.sort([r.length for r in df.collect()])[::-1], 100)[2])
    assert figures["bound"] <= figures["sequences"] <= at_once + 5  # five groups
    assert out.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 100


def test_bound_holds_against_brute_force():
    rng = random.Random(5)

    def fewest(items, room):
        if not items:
            return len(room)
        best, seen = 99, set()
        for i, r in enumerate(room):
            if r >= items[0] and r not in seen:
                seen.add(r)
                best = min(best, fewest(items[1:], room[:i] + [r - items[0]] + room[i + 1 :]))
        return min(best, fewest(items[1:], [*room, 12 - items[0]]))

    for _ in range(60):
        items = sorted((rng.randrange(1, 13) for _ in range(7)), reverse=True)
        need = fewest(items, [])
        bins, offsets, free = packing.best_fit(np.array(items), 12)
        assert packing.bound(np.bincount(items, minlength=13)) <= need <= len(free)
        assert (12 - free == np.bincount(bins, weights=items)).all()
    assert packing.bound(np.bincount([7] * 5, minlength=13)) == 5
