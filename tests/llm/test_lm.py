import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lattisect.llm import lm


def rows_of(n, seed):
    rng = random.Random(seed)
    follow = {"the": ["cat", "dog", "Fox"], "cat": ["sat", "ran"], "dog": ["sat", "ran"], "fox": ["ran"], "sat": ["down"], "ran": ["home"], "down": ["the"], "home": ["the"]}
    out = []
    for i in range(n):
        words = ["the"]
        for _ in range(rng.randrange(3, 40)):
            words.append(rng.choice(follow[words[-1].lower()]) if rng.random() < 0.9 else f"x{rng.randrange(200)}")
            if words[-1].lower() not in follow:
                words.append("the")
        out.append((i, " ".join(words)))
    return out


def plain(rows):
    """Held out, tokens, known, N and base by the definition."""
    bytes_of = lambda t: (t or "").encode().lower().split() + [b""]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out(i) for w in bytes_of(t))
    n, v = sum(counts.values()), len(counts)
    found = []
    for i, t in rows:
        ws = bytes_of(t)
        found.append((i, out(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)))
    return found


@pytest.mark.parametrize("head", [5, 1000])
def test_scores(spark, head):
    rows = rows_of(250, 8) + [(300, None), (301, ""), (302, "É nur NEU\x1cx \n"), (303, "new " * 5000), (5, "the cat sat"), (5, "the cat sat"), (None, "the dog")]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id bigint, text string, score double")
    got = lm.scores(df, vocabulary=18, head=max(head, 10), endings=6, passes=4).collect()
    key = lambda r: tuple((x is not None, x) for x in r[:5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(plain(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    held = [g for g in got if g[1] and g[0] < 250]
    assert sum(g[6] for g in held) > 0.8 * sum(g[5] for g in held)  # nearer to zero: the model knows what follows what


def test_no_training_text(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    df = spark.createDataFrame([(i, "some words") for i in ids], "doc_id bigint, text string")
    for r in lm.scores(df, vocabulary=8, head=10, endings=3).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0
    assert lm.scores(df.limit(0), vocabulary=8, head=10, endings=3).count() == 0


def chain(n, seed, words=18):
    """States in which each is followed by one of three, and the same as the model's input."""
    rng = np.random.default_rng(seed)
    own = [0]
    for _ in range(n):
        own.append((own[-1] * 3 + rng.integers(1, 4)) % words)
    own = np.array(own)
    return np.stack([own[1:-1], own[:-2]], axis=1), own[2:]


def test_model_is_normalised_and_learns():
    before, own = chain(30_000, 9)
    model = lm.LogBilinear(np.bincount(own, minlength=18), context=2, size=8)
    assert model.width * model.classes > 18  # some states are only there to fill the classes
    def checked():
        for b in before[:5]:
            every = np.arange(18)
            assert np.isclose((10 ** model.log10(np.repeat(b[None], 18, axis=0), every)).sum(), 1, atol=1e-5)
        return model.log10(before, own).mean()

    flat = checked()
    trainer = lm.Trainer(model, 3)
    for at in range(0, len(own), 256):
        trainer.step(before[at : at + 256], own[at : at + 256])
    assert np.array_equal(checked(), flat)  # the model itself is as it was
    model = trainer.model
    assert trainer.used[: model.first_state].sum() == 2 * len(own)
    assert checked() > flat + 0.6 * (math.log10(1 / 3) - flat)


def test_log_probabilities_by_plain_loops():
    rng = np.random.default_rng(2)
    model = lm.LogBilinear(rng.integers(1, 50, 11), context=3, size=4)
    model.rows[:, :5] += rng.normal(0, 0.5, model.rows[:, :5].shape)
    before, own = rng.integers(0, 11, (40, 3)), rng.integers(0, 11, 40)
    vector = lambda r: [float(x) for x in model.rows[r, :4]]
    for b, w, got in zip(before, own, model.log10(before, own, block=7)):
        q = [0.0] * 4
        for j in range(3):
            for i, x in enumerate(vector(b[j])):
                for k in range(4):
                    q[k] += x * float(model.rows[model.first_place + 4 * j + i, k])
        score = lambda r: sum(a * c for a, c in zip(q, vector(r))) + float(model.rows[r, 4])
        of = w // model.width
        classes = [math.exp(score(model.first_class + c)) for c in range(model.classes)]
        states = [math.exp(score(model.first_state + of * model.width + k)) for k in range(model.width)]
        assert math.isclose(10**got, classes[of] / sum(classes) * states[w % model.width] / sum(states), rel_tol=1e-4)


def test_blocks_and_parts_make_no_difference(monkeypatch):
    rng = np.random.default_rng(6)
    model = lm.LogBilinear(rng.integers(1, 50, 40), context=3, size=4)
    model.rows[:, :5] += rng.normal(0, 0.5, model.rows[:, :5].shape)
    lengths = np.array([0, 5, 1, 0, 60])
    before, own = lm._Tokens(2, 3).of(rng.integers(0, 40, lengths.sum()), lengths)
    want = model.log10(before, own)
    monkeypatch.setattr(lm.LogBilinear, "PART", 3)
    assert np.allclose(model.log10(before, own, block=10), want, atol=1e-6)


def test_states_before_those_of_texts():
    gathered = lm._Tokens(9, 2)
    for text in ([1, 2, 3], [], [4]):
        gathered.add(text)
    for before, own in (gathered.arrays(), gathered.of(np.array([1, 2, 3, 4]), np.array([3, 0, 1]))):
        assert own.tolist() == [1, 2, 3, 9, 9, 4, 9]
        assert before.tolist() == [[9, 9], [1, 9], [2, 1], [3, 2], [9, 9], [9, 9], [4, 9]]


def test_words_of_all_states_sum_to_one():
    counts = {"aa": 9, "ba": 5, "ca": 3, "db": 2, "eb": 1, "x": 1, "é": 1}
    states = lm.States.of([("aa", 9)], [(b"ba", 5, 1), (b"ca", 3, 1)], (5, 4), 4)
    assert states.numbers([b"aa", b"ba", b"zzba", b"x", "é".encode()])[1:3] == [states.endings[b"ba"]] * 2
    for state in {*states.endings.values(), states.other}:
        inside = [w for w in counts if states.numbers([w.encode()]) == [state]]
        assert math.isclose(sum((counts[w] + 1) / states.weight[state] for w in inside) + 1 / states.weight[state], 1)
    assert list(states.tokens) == sorted(states.tokens, reverse=True)


def test_scores_by_plain_loops(spark, monkeypatch):
    """A text's score is the sum over its tokens of the state's log probability and of the word's share of its state."""
    rows = rows_of(120, 4)
    kept = {}
    real = lm.trained
    monkeypatch.setattr(lm, "trained", lambda texts, states, *more: kept.setdefault("model", real(texts, kept.setdefault("states", states), *more)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm.scores(df, vocabulary=20, head=30, endings=4).collect()}
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.encode().lower().split())
    states, model = kept["states"], kept["model"]
    for i, text in rows[:30]:
        words = text.encode().lower().split()
        numbers = [states.end] * 3 + states.numbers(words) + [states.end]
        want = sum(math.log10((counts[w] + 1) / states.weight[s]) for w, s in zip(words, numbers[3:]) if states.weight[s])
        for at in range(3, len(numbers)):
            want += float(model.log10(np.array([[numbers[at - 1], numbers[at - 2], numbers[at - 3]]]), np.array([numbers[at]]))[0])
        assert math.isclose(got[i], want, rel_tol=1e-6)


def learner():
    rng = np.random.default_rng(12)
    model = lm.LogBilinear(rng.integers(1, 50, 11), context=3, size=4)
    model.rows[:, :5] += rng.normal(0, 0.5, model.rows[:, :5].shape)
    flat, at = lm._Tokens(2, 3).placed(rng.integers(0, 11, 45), np.array([0, 20, 1, 24]))
    return model, flat, at


@pytest.mark.parametrize("part", [4, 512])
def test_slopes_are_those_of_the_log_probability(monkeypatch, part):
    """Nothing is sampled: a minibatch's slopes are the derivatives of its log probability."""
    model, flat, at = learner()
    monkeypatch.setattr(lm.Trainer, "_moved", staticmethod(lambda rows, slopes: rows + slopes))
    trainer = lm.Trainer(model, part)
    trainer.learn(flat, at)
    before = np.stack([flat[at - j] for j in (1, 2, 3)], axis=1)
    moved = trainer.model.rows - model.rows
    used = [*range(11), *range(model.first_state, model.first_state + 11), *range(model.first_class, len(model.rows))]
    for r in used:
        for c in range(5):
            if c == 4 and (r < model.first_state or r >= model.first_place):
                assert moved[r, c] == 0  # these have no bias
                continue
            old, sums = model.rows[r, c], []
            for step in (0.01, -0.01):
                model.rows[r, c] = old + np.float32(step)
                sums.append(model.log10(before, flat[at]).sum() * math.log(10))
            model.rows[r, c] = old
            assert math.isclose(moved[r, c], (sums[0] - sums[1]) / 0.02, rel_tol=1e-2, abs_tol=2e-2)


def test_learning_by_places_or_parts_or_from_far_makes_no_difference():
    model, flat, at = learner()
    trainers = [lm.Trainer(model), lm.Trainer(model, 3), lm.Trainer(model)]
    for trainer in trainers[:2]:
        trainer.learn(flat, at)
    trainers[2].step(np.stack([flat[at - j] for j in (1, 2, 3)], axis=1), flat[at])
    for trainer in trainers[1:]:
        assert np.allclose(trainer.model.rows, trainers[0].model.rows, atol=1e-4)
        assert np.array_equal(trainer.used, trainers[0].used)
    model.rows[:, :4] *= 60  # exponentials beyond the numbers' range
    trainer = lm.Trainer(model)
    trainer.learn(flat, at)
    assert np.isfinite(trainer.model.rows).all()
