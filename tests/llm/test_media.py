import io
import wave

import numpy as np
from pyspark.sql import functions as F

from lattisect.llm import media


def wav(samples, rate=4000, channels=1):
    data = io.BytesIO()
    with wave.open(data, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.repeat(samples, channels) * 32767).astype("<i2").tobytes())
    return data.getvalue()


def plain_area(energies, t0, t1, p0, p1):
    return energies[t0:t1, p0:p1].sum()


def test_integral_image_gives_the_filters_sums():
    energies = np.random.default_rng(0).random((30, 12))
    codes = media.packed(energies)
    assert len(codes) == 30 - media.WIDTH + 1
    for at in (0, 7, len(codes) - 1):
        kind, first, pitches, frames = media.FILTERS[1]
        a = plain_area(energies, at, at + frames, first, first + pitches // 2)
        b = plain_area(energies, at, at + frames, first + pitches // 2, first + pitches)
        step = int(np.searchsorted(media.CUTS, np.log((a + 0.01) / (b + 0.01))))
        assert int(codes[at]) >> 2 * (len(media.FILTERS) - 2) & 3 == step ^ step >> 1


def test_reads_what_it_can():
    tone = np.sin(np.arange(8000) / 3) * 0.5
    for channels in (1, 2):
        samples, rate = media.read_wav(wav(tone, 8000, channels))
        assert rate == 8000 and np.allclose(samples, tone, atol=1e-3)
    for bad in (None, b"", b"RIFF", b"x" * 100):
        assert len(media.read_wav(bad)[0]) == 0
    assert len(media.fingerprint(np.zeros(100), 8000)) == 0 and len(set(media.fingerprint(np.zeros(80000), 8000).tolist())) == 1


def test_search_finds_copies(spark):
    rng = np.random.default_rng(1)
    tunes = [media.read_wav(media.tune((rng.normal(0, 0.125, 64)).tolist()))[0] for _ in range(40)]
    rows = [(i, wav(t)) for i, t in enumerate(tunes)]
    near = {}
    for i in range(12):  # cut and noisy copies
        cut = tunes[i][256 * (i + 1) :]
        rows.append((100 + i, wav(np.clip(cut + rng.normal(0, 0.02, len(cut)), -1, 1))))
        near[i] = 100 + i
    rows += [(200, rows[5][1]), (201, rows[30][1]), (201, rows[30][1]), (300, None), (301, b"junk"), (302, wav(np.zeros(50))), (None, rows[7][1]), (303, wav(np.zeros(20000)))]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, 1) for i, b in rows], "id bigint, audio binary, codes int")
    out = media.search(media.fingerprints(df, "id", "audio"), "id", F.col("id") < 40).collect()
    assert len(out) == len(rows)
    found = {r.id: r for r in out}
    hit = 0
    for i in range(40):
        r = found[i]
        assert r.is_query and (r.best_match is None or r.best_match == near.get(i))
        hit += r.best_match is not None
        if r.best_match is not None:
            assert r.best_offset == -(i + 1) and r.best_errors < media.ERRORS and r.n_matches == 1
    assert hit >= 0.9 * len(near)
    assert found[200].class_id == 5 and found[201].class_id == 30 and found[None].class_id == 7
    assert [found[i].n_codes for i in (300, 301, 302)] == [0, 0, 0] and found[300].class_id == 300 and found[300].n_matches is None
    assert media.search(media.fingerprints(df.limit(0), "id", "audio"), "id", F.lit(True)).count() == 0


def test_aligns_as_a_comparison_at_all_offsets_does():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 15, 16, 17, 40, 90, 90, 200)]
    noisy = [p ^ np.uint32(0x00810101) for p in parts]  # no integer is left as it was
    parts += [noisy[4][3:38], np.concatenate([noisy[6][55:], parts[1]]), np.tile(parts[1], 4)]
    want = {}
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            for shift in range(-len(a), len(b)):
                first = max(-shift, 0)
                n = min(len(a), len(b) - shift) - first
                if n >= media.OVERLAP:
                    bits = int(np.bitwise_count(a[first : first + n] ^ b[first + shift : first + shift + n]).sum())
                    if bits <= media.ERRORS * 32 * (n - media.OVERLAP):
                        want[i, j] = min(want.get((i, j), (9,)), (bits / n, shift, n, bits))
    i, j, shift, overlap, bits = (x.tolist() for x in media.aligned(parts, parts))
    assert {(a, b): (d / c, s, c, d) for a, b, s, c, d in zip(i, j, shift, overlap, bits)} == want
    assert (4, 8) in want and (6, 9) in want


def test_search_finds_copies_cut_off_the_grid(spark):
    rng = np.random.default_rng(6)
    tunes = [media.read_wav(media.tune(rng.normal(0, 0.125, 64).tolist()))[0] for _ in range(12)]
    rows = [(i, wav(t)) for i, t in enumerate(tunes)]
    rows += [(100 + i, wav(np.clip(t[1280 + 128 :] + rng.normal(0, 0.05, len(t) - 1408), -1, 1))) for i, t in enumerate(tunes)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id bigint, audio binary")
    found = {r.id: r for r in media.search(media.fingerprints(df, "id", "audio"), "id", F.col("id") < 12).collect()}
    assert [(found[i].n_matches, found[i].best_match) for i in range(12)] == [(1, 100 + i) for i in range(12)]
    assert all(found[i].best_offset in (-5, -6) and found[i].best_errors <= media.ERRORS for i in range(12))


def test_search_recalls_what_a_comparison_at_all_offsets_finds(spark):
    """Recall against brute force: queries against all, at every offset, by all bits."""
    rng = np.random.default_rng(8)
    vectors = [rng.normal(0, 0.125, 64) for _ in range(60)]
    for i in range(0, 60, 3):  # the same tune, begun later, with changed notes, or shortened
        base = np.roll(vectors[i], 0).copy()
        base[rng.integers(0, 64, rng.integers(0, 6))] = 0.3
        vectors.append(base[rng.integers(0, 12) : 64 - rng.integers(0, 12)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, e array<double>")
    prints = media.fingerprints(df, "id", "e", media.read_tune)
    codes = {r.id: np.array(r.codes, np.int32).view(np.uint32) for r in prints.collect()}
    asked = [i for i in codes if i % 2 == 0]
    want = {}
    for i in asked:
        for j in codes:
            if i == j or np.array_equal(codes[i], codes[j]):
                continue
            a, b, best = codes[i], codes[j], None
            for shift in range(-len(a) + media.OVERLAP, len(b) - media.OVERLAP + 1):
                first = max(-shift, 0)
                n = min(len(a), len(b) - shift) - first
                bits = int(np.bitwise_count(a[first : first + n] ^ b[first + shift : first + shift + n]).sum())
                if bits <= media.allowed(np.array(n)):
                    best = min(best or (9.0, 0), (bits / (32 * n), shift))
            if best:
                want.setdefault(i, {})[j] = best
    found = {r.id: r for r in media.search(prints, "id", F.col("id") % 2 == 0).collect()}
    total = sum(len(m) for m in want.values())
    got = sum(found[i].n_matches for i in asked)
    assert total >= 20 and 0.9 * total <= got <= total
    right = [found[i].best_match is not None and abs(found[i].best_errors - min(m.values())[0]) < 1e-12 for i, m in want.items()]
    assert sum(right) >= 0.9 * len(right)
    assert all(found[i].n_matches == 0 for i in asked if i not in want)
