import random

import numpy as np
import pytest
import xxhash

from lattisect.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(ids, fps):
    root = {i: i for i in range(len(ids))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least[top(i)] for i in range(len(ids))]


def as_bigint(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def test_fingerprint_matches_its_definition():
    rng = random.Random(1)
    texts = [None, "", "  \n\t", "One", "a b c", "A b C d", "É é x y z w", "x" * 5000, "a " * 4000]
    texts += [" ".join(rng.choice("ab cd Ef gh ij".split()) for _ in range(rng.randrange(1, 700))) for _ in range(20)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_grid_loses_no_link(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        fps += [centre] + [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for _ in range(8)]
    fps += [0, 1, (1 << 64) - 1, 15 << 60, 3, 12]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(as_bigint(f),) for f in fps], "fp bigint")
    for block in (simhash.BLOCK, 4):
        found = {r.node: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
        got = [found.get(as_bigint(f), as_bigint(f)) for f in fps]
        want = plain_classes([as_bigint(f) for f in fps], fps)
        assert got == want


def test_near_duplicates_with_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them at once today " * 30
    rows = [(9, base), (3, base), (3, base), (4, base.upper()), (7, base + "x"), (5, None), (6, ""), (8, " \n"), (None, base), (1, "short"), (2, "w " * 30000)]
    df = spark.createDataFrame([(i, t, t, 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    ids = [i if i is not None else 1 << 60 for i, _ in rows]
    want = sorted((i if i is not None else -1, as_bigint(f), c) for (i, _), f, c in zip(rows, fps, plain_classes(ids, fps)))
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_chain_of_links_is_one_component(spark):
    chain = [0]
    for k in range(0, 60, 4):
        chain.append(chain[-1] | (15 << k))
    df = spark.createDataFrame([(as_bigint(f),) for f in chain], "fp bigint")
    assert {r.root for r in simhash.components(simhash.links(df)).collect()} == {min(map(as_bigint, chain))}
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    with pytest.raises(ValueError):
        simhash.links(df, radius=5)
    assert np.array_equal(simhash._manhattan(np.array([0, 5]), np.array([3, 10])), [2, 0])
