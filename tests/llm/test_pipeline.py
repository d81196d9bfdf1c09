import random

import corpus_pipeline
from lattisect.llm import near, packing


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    first, long = text(400), text(300)
    rows = [
        (1, first), (2, first), (3, first + " tail"), (4, text(60)), (5, text(60) + " password: hunter2hunter2 " + text(5)), (6, "too short"),
        (7, "| a " * 300), (8, None), (9, long), (9, long), (None, text(50)), (10, ""), (11, "same words here again now " * 40),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        kept[name] = sorted((r.doc_id or -1) for r in docs.collect())
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert kept["quality_rules"] == [-1, 1, 2, 3, 4, 5, 9, 9]
    assert kept["simhash_near_dedup"] == kept["secret_scans"] == [-1, 1, 4, 5, 9]
    clean = {r.doc_id: r for r in docs.collect()}
    assert "[ASSIGN]" in clean[5].text and "hunter2" not in clean[5].text and clean[5].n_chars == len(clean[5].text)
    assert clean[4].text == rows[3][1]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    encode = packing.word_encoder()
    assert sorted(zip(out.doc_id.fillna(-1).astype(int), out.length)) == sorted((i or -1, len(encode([r.text])[0]) // 4 + 1) for i, r in clean.items())
    assert (out.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), "").count() == 0


def test_near_dedup_finds_all_pairs_of_similarity_0_8(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = text(40), []
    for _ in range(30):
        base = text(rng.randrange(30, 200))
        texts.append(base)
        for _ in range(3):  # changed words: similarities on both sides of 0.8
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randrange(1, 2 + len(copy) // 40)):
                copy[at] = "changed"
            texts.append(copy)
    texts += [text(5) + passage for _ in range(20)] + [text(80) + passage for _ in range(20)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(set(root))
    for limits in ({"small": 3, "block": 7}, {"small": 2, "block": 1000}):
        assert sorted((r.doc_id, r.component_id) for r in near.near_duplicates(df, **limits).collect()) == list(enumerate(root))
