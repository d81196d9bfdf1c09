"""What once lost, doubled or broke: rows with one id, clashing names, new versions of rules, damaged recordings."""

import dataclasses
import io
import random
import wave

import corpus_pipeline
import numpy as np
from lattisect.llm import chat, media, near, quality, secret_scan
from pyspark.sql import functions as F


def texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)) for _ in range(n)]


def test_near_dedup_keeps_one_row_of_each_text(spark):
    a, b, c = texts(3)
    near_a, near_c = a + " tail", c + " tail"
    rows = [(5, a), (5, b), (2, b), (7, c), (7, near_a), (None, near_c), (None, None), (8, ""), (9, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r.doc_id, r.text) for r in near.one_of_each(docs).collect())
    assert kept == sorted([(5, a), (2, b), (7, c), (8, "")])  # of copies without words the least id


def test_pipeline_stages_take_any_column_names(spark, tmp_path):
    a, b = texts(2, 4)
    secret = b + " password: hunter2hunter2"
    names = ["n_words", "kept", "blob", "__found", "__text", "__words", "__place", "doc", "key", "node", "row", "file", "hit", "can", "found", "rules", "odd.name"]
    docs = spark.createDataFrame([(1, a, 5), (2, a, 5), (3, secret, 5), (4, "short", 5)], "doc_id bigint, text string, n_chars bigint")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(f"v{i}"))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, "")
        assert docs.columns == columns
    got = {r.doc_id: r.asDict() for r in docs.collect()}
    assert set(got) == {1, 3} and all(r[n] == f"v{i}" for r in got.values() for i, n in enumerate(names))
    assert got[3]["text"].endswith("[ASSIGN]") and got[1]["text"] == a
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 2


def test_ledger_follows_versions_of_rules(spark):
    old = dataclasses.replace(secret_scan.RULES[0], version=0, pattern=r"(?i:password)=([a-z]++)", guard="password")
    rules = (old, *secret_scan.RULES[1:])
    one = spark.createDataFrame([(1, "password=abcdefgh"), (2, "token: abcdefgh12"), (3, "AKIA" + "A" * 16)], "doc_id bigint, text string")
    two = spark.createDataFrame([(1, "password=abcdefgh"), (2, "token: changed12345"), (4, "password=abcdefgh"), (5, "plain")], "doc_id bigint, text string")
    found, ledger = secret_scan.secrets(one, rules=rules)
    kinds = lambda df: {r.doc_id: [(s.kind, s.start, s.stop) for s in r.found] for r in df.collect()}
    assert kinds(found) == {1: [("assign", 0, 17)], 2: [], 3: [("access", 0, 20)]}
    for versions in (one, two, one.unionByName(two)):
        want = kinds(secret_scan.secrets(versions)[0])
        again, more = secret_scan.secrets(versions, ledger=ledger)
        assert kinds(again) == want and want[1] == [("assign", 0, 17)]  # once, though two versions found it
        # of the blobs that were scanned before only the changed rule is asked
        known = {r.blob for r in ledger.collect()}
        assert all(r.rules == ["assign@1"] for r in more.collect() if r.blob in known)
        third, rest = secret_scan.secrets(versions, ledger=ledger.unionByName(more))
        assert kinds(third) == want and rest.count() == 0
    # a finding that only the old pattern had is not read any more
    narrow = (dataclasses.replace(old, version=2, pattern=r"(?i:password)=([0-9]++)"), *secret_scan.RULES[1:])
    assert kinds(secret_scan.secrets(one, rules=narrow, ledger=ledger)[0])[1] == []
    clean = secret_scan.redacted(one, ledger=ledger).collect()
    assert {r.doc_id: r.text for r in clean} == {1: "[ASSIGN]", 2: "[ASSIGN]", 3: "[ACCESS]"}


def test_damaged_recordings_have_no_codes_or_fewer(spark):
    def wav(rate, tail=0, width=2):
        data = io.BytesIO()
        with wave.open(data, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(width)
            f.setframerate(max(rate, 1))
            f.writeframes((np.sin(np.arange(40_000) / 3) * 20000).astype("<i2").tobytes())
        out = bytearray(data.getvalue())
        out[24:28] = rate.to_bytes(4, "little")
        return bytes(out[: len(out) - tail])

    whole = len(media.fingerprint(*media.read_wav(wav(8000))))
    assert whole > 50 and 0 < len(media.fingerprint(*media.read_wav(wav(8000, 30_001)))) < whole
    bad = [wav(0), wav(10), wav(999), wav(2_000_000_000), wav(8000, width=1), wav(8000, 80_030)]
    assert [len(media.fingerprint(*media.read_wav(b))) for b in bad] == [0] * len(bad)
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*bad, wav(8000)])], "id bigint, audio binary")
    assert sorted(r.id for r in media.fingerprints(rows, "id", "audio").where("size(codes) > 0").collect()) == [len(bad)]


def test_cascade_rejects_what_the_rules_do(spark):
    rows = [(i, t) for i, t in enumerate([*texts(5), None, "", "few words", "| # " * 100, "same words here again now " * 40, "A" * 30 + " B" * 40, "\n".join(["one line that is long enough"] * 30)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(r.doc_id for r in quality.judged(docs).where("kept").collect())
    assert sorted(r.doc_id for r in quality.passed(docs).collect()) == want == [0, 1, 2, 3, 4]
    assert sorted(r.doc_id for r in quality.passed(docs, rules=tuple(reversed((*quality.BASE, *quality.RULES)))).collect()) == want
    assert quality.passed(docs.limit(0)).count() == 0


def test_neighbours_of_one_role_are_merged(spark):
    turns = [(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", ""), ("tool", "d"), ("tool", "[NEXT]"), ("user", "e")])]
    made = chat.formatted(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"))
    assert made.first().formatted == "[INST]a[NEXT]b[/INST]<s>c[NEXT]</s>[ROLE]tool[NEXT]d[NEXT][\\NEXT][/ROLE][INST]e[/INST]"
    assert [(t.role, t.text) for t in chat.parsed(made).first().turns] == [t[2:] for t in turns]


def test_near_dedup_tells_rows_apart_however_they_are_made(spark, tmp_path):
    """Rows that plans make of one stored row are rows of their own."""
    a, b, c, d = texts(4, 8)
    arrays = spark.createDataFrame([(1, [a, b, c]), (2, [a, d])], "doc_id bigint, many array<string>")
    arrays.coalesce(1).write.parquet(str(tmp_path / "arrays"))
    plain = spark.createDataFrame([(1, a), (2, b), (3, a + " tail")], "doc_id bigint, text string")
    plain.coalesce(1).write.parquet(str(tmp_path / "plain"))
    path = str(tmp_path / "plain")
    read = spark.read.parquet(path)
    two = spark.createDataFrame([(1,), (2,)], "n int")
    kept = lambda df: sorted(r.text for r in near.one_of_each(df).collect())
    exploded = spark.read.parquet(str(tmp_path / "arrays")).select("doc_id", F.explode("many").alias("text"))
    assert kept(exploded) == sorted([a, b, c, d])
    assert kept(exploded.where("length(text) > 0").withColumn("n", F.lit(1))) == sorted([a, b, c, d])
    assert kept(read) == kept(spark.read.parquet(path, path)) == kept(spark.read.parquet(path, str(next((tmp_path / "plain").glob("*.parquet"))))) == sorted([a, b])
    assert kept(read.crossJoin(two)) == kept(read.join(two, F.lit(True))) == kept(read.unionByName(read)) == sorted([a, b])
    assert kept(read.unionByName(plain)) == kept(read.limit(3)) == kept(read.where(F.rand() >= 0)) == kept(read.orderBy("text")) == sorted([a, b])
    assert near._bare(read.where("doc_id > 0").select("text", "doc_id")) and not near._bare(read.crossJoin(two)) and not near._bare(plain)
    read.write.json(str(tmp_path / "json"))
    assert kept(spark.read.schema("doc_id bigint, text string").json(str(tmp_path / "json"))) == sorted([a, b])


def test_near_dedup_with_hot_shingles_joins_them(spark):
    """As many links whether a task holds what meets at a shingle or a join brings it together."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 12, 50]))]
        rows.append((i, " ".join(passage[:50] + own if i % 2 else own + passage)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(tuple(r) for r in near.near_duplicates(df).collect())
    assert 10 < len({c for _, c in want}) < 90
    for hot, small in ((5, 3), (40, 64), (2, 1)):
        assert sorted(tuple(r) for r in near.near_duplicates(df, small=small, hot=hot, block=20).collect()) == want


def test_near_dedup_links_by_simhash_too(spark):
    """Texts of repeated words have one or few shingles, and SimHash counts them."""
    from lattisect.llm import simhash

    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(i, " ".join(base[:k] + ["x"] + base[k:])) for i, k in enumerate(range(0, 900, 90))] + [(50 + i, t) for i, t in enumerate(texts(20, 9))]
    rows += [(80, "a b c d e f " * 40), (81, "a b c d e f " * 41), (82, None), (83, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    jaccard = dict(tuple(r) for r in near.near_duplicates(df).collect())
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    both = dict(tuple(r) for r in near.near_duplicates(df, bits=simhash.RADIUS).collect())
    root = {i: i for i, _ in rows}
    for links in (jaccard, prints):
        for i, c in links.items():
            a, b = root[i], root[c]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert both == root
