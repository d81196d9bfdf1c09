import math
import random

import pytest

from lattisect.llm import urls


def plain(url):
    """Host, path, rule and its verdict, by the definition."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(r.text), r.text, r.verdict) for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_and_models(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    good = [f"https://{word()}.shop.com/{word()}/{i}" for i in range(60)]
    bad = [f"http://{word()}.casino.net/es/win-{word()}?bet={i}" for i in range(60)]
    new = [f"https://{word()}.shop.org/{word()}/{i}" for i in range(20)], [f"http://{word()}.casino.org/es/win-{word()}?bet={i}" for i in range(20)]
    odd = [
        None, "", "no scheme", "://", "x://COM/", "http://com", "http://a.com?x=/", "http://www.Example.com/en/1", "http://m.www.example.com/en/", "http://example.com/en/a#b",
        "http://xexample.com/en/", "http://example.com/EN/", "http://a.net/fr/", "http://a.net/frx/", "a://b://c.com/", "http://É.com/\n", "http://a.com/" + "x" * 30000,
    ]
    texts = odd + good + bad + new[0] + new[1] + good[:3]
    df = spark.createDataFrame([(i, u, "h", 0.5) for i, u in enumerate(texts)], "page_id bigint, url string, host string, score double")
    out = {r.page_id: r for r in urls.filtered(df).collect()}
    assert len(out) == len(texts)
    for i, u in enumerate(texts):
        host, path, rule, verdict = plain(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == verdict if verdict else out[i].verdict in ("allow", "block")
    at = len(odd) + 120
    right = [out[at + i].verdict == "allow" for i in range(20)] + [out[at + 20 + i].verdict == "block" for i in range(20)]
    assert sum(right) >= 38
    assert urls.filtered(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.filtered(df.where("url like '%.org%'")).collect()} == {"allow"}


def test_chances_sum_to_one():
    model = urls.CharModel([b"abab", b"abc", b""])
    for context in (b"", b"a", b"ab", b"zz", b"abab"):
        assert math.isclose(sum(model.chance(context, s) for s in range(257)), 1)


def test_score_is_the_sum_over_bytes():
    model = urls.RatioModel([b"http://aa.com", b"http://ab.com"] * 5, [b"http://zz.net", b"http://zy.net"] * 5)
    for url in (b"", b"h", b"http://ab.net", b"^^^^^^"):
        steps = [(url[max(0, i - 4) : i], url[i] if i < len(url) else 256) for i in range(len(url) + 1)]
        want = sum(math.log(model.models[0].chance(c, s) / model.models[1].chance(c, s)) for c, s in steps) / (len(url) + 1)
        assert math.isclose(model.score(url), want, abs_tol=1e-12) and math.isclose(model.score(url), want, abs_tol=1e-12)


@pytest.mark.parametrize("sent", [500_000, 300])
def test_models_learn_from_all_urls(spark, monkeypatch, sent):
    """Scores are those of the plain models on all different URLs, however few a sample would hold."""
    import xxhash

    monkeypatch.setattr(urls, "SAMPLE_URLS", 20)
    monkeypatch.setattr(urls, "LONGEST", 40)
    monkeypatch.setattr(urls, "SENT", sent, raising=False)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9)))
    good = [f"https://{word()}.shop.com/{word()}" for _ in range(90)] + ["http://a.com/" + "y" * 200]
    bad = [f"http://{word()}.casino.net/es/{word()}" for _ in range(130)]
    open_ = [f"https://{word()}.{rng.choice(['shop', 'casino'])}.org/es/{word()}" for _ in range(40)] + ["", "x", None]
    pages = spark.createDataFrame(list(enumerate(good + bad + bad[:9] + open_ + open_[:3])), "page_id bigint, url string")
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    in_order = lambda some: [u.encode() for u in sorted(set(some), key=lambda u: signed(xxhash.xxh64_intdigest(u.encode(), 42)))]
    model = urls.RatioModel(in_order(good), in_order(bad))
    got = urls.filtered(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        text = (good + bad + bad[:9] + open_ + open_[:3])[r.page_id]
        if r.rule is None:
            assert math.isclose(r.score, model.score((text or "").encode()), abs_tol=1e-9)
            assert r.verdict == ("block" if r.score < model.threshold else "allow")
        else:
            assert r.score is None


def test_verdicts_of_a_table_against_plain_python(spark):
    """Every verdict: by the rules, else by models that are fitted in plain Python on the sample that the docstring names."""
    import xxhash

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, r.url) for r in pages.collect()]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    samples = {"allow": set(), "block": set()}
    for _, u in rows:
        verdict = plain(u)[3]
        if verdict and len(u.encode()) <= urls.LONGEST:
            samples[verdict].add(u)
    lists = [[u.encode() for u in sorted(samples[v], key=lambda u: (signed(xxhash.xxh64_intdigest(u.encode(), 42)), u))] for v in ("allow", "block")]
    assert all(0 < len(x) <= urls.SAMPLE_URLS and sum(map(len, x)) <= urls.SAMPLE_BYTES for x in lists)
    model = urls.RatioModel(*lists)
    want = {i: plain(u)[3] or ("block" if model.score((u or "").encode()) < model.threshold else "allow") for i, u in rows}
    assert {r.page_id: r.verdict for r in urls.filtered(pages).collect()} == want
    assert {"allow", "block"} == {want[i] for i, u in rows if not plain(u)[3]}


def test_sample_holds_the_first_hashes_however_often_a_url_comes(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE_URLS", 20)
    fitted = []
    monkeypatch.setattr(urls, "RatioModel", lambda *lists: fitted.append(lists))
    few = [(f"http://a{i}.com/", "allow") for i in range(50)] + [(f"http://b{i}.net/es/", "block") for i in range(300)] + [("http://a0.com/", "allow")] * 9000 + [("x" * 9000, "allow")]
    urls.fitted(spark.createDataFrame(few, "url string, rule_verdict string"))
    import xxhash

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    for got, name in zip(fitted[0], ("allow", "block")):
        all_ = {u.encode() for u, v in few if v == name and len(u) < 9000}
        assert got == sorted(all_, key=lambda u: signed(xxhash.xxh64_intdigest(u, 42)))[:20]
