import random
import zlib

import numpy as np
import pytest
from cnvspark.llm import quality, toxicity
from cnvspark.llm.labelled import held_out, training_rows
from pyspark.sql import functions as F


def test_gradients():
    net, rng = toxicity.BiGRU(3, 4, 5, 1), np.random.default_rng(0)
    x, mask, y = rng.normal(size=(3, 6, 3)), np.ones((3, 6)), np.array([1.0, 0, 1])
    mask[1, 4:] = mask[2, 2:] = 0
    for k, g in net.loss(x, mask, y)[2].items():
        flat = (x if k == "x" else net.p[k]).reshape(-1)
        for i in range(min(50 if k == "x" else 5, len(flat))):
            old = flat[i]
            flat[i] = old + 1e-5
            up = net.loss(x, mask, y, False)[0]
            flat[i] = old - 1e-5
            down = net.loss(x, mask, y, False)[0]
            flat[i] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-6


def test_gradients_of_word_vectors():
    inputs = toxicity.WordInputs(["ab abc abcd xyz", "ab abc zzz"], [1, 0], least=1, size=3, buckets=16)
    keys = inputs.keys(["ab", "abcd", "unknown", "!"])
    weights = np.random.default_rng(0).normal(size=(4, inputs.features))
    value = lambda: float((inputs.vectors(keys) * weights).sum())
    for k, g in inputs.gradients(keys, weights).items():
        for at in np.ndindex(*g.shape):
            old = inputs.p[k][at]
            inputs.p[k][at] = old + 1e-5
            up = value()
            inputs.p[k][at] = old
            assert abs((up - value()) / 1e-5 - g[at]) < 1e-5


def test_runs_of_characters_against_a_plain_loop():
    inputs = toxicity.WordInputs(["a"], [1], least=1, size=1, buckets=1 << 20)
    words = ["", "a", "ab", "abc", "äßab", "abcab"]
    runs, begins = inputs._runs(words)
    ends = [*begins[1:], len(runs)]
    names = {}
    for w, b, e in zip(words, begins, ends):
        edged = f"^{w}$"
        want = [edged[i : i + n] for i in range(len(edged)) for n in (3, 4) if i + n <= len(edged)]
        got = runs[b:e].tolist()
        assert len(got) == len(want) + 1
        for g in got:
            names.setdefault(g, set()).add(w)
    assert names[inputs._runs(["ab"])[0][0]] == {"ab", "abc", "abcab"}  # ^ab


def plain_scores(model, text):
    """Every window by itself, position by position."""
    words, p, k = text.split(), model.p, model.hidden
    sig = lambda x: 1 / (1 + np.exp(-x))
    out = []
    for start in toxicity.window_starts(len(words), model.window):
        x = model.inputs.vectors(model.inputs.keys(words[start : start + model.window]))
        states = []
        for d, xs in (("f", x), ("b", x[::-1])):
            h, seq = np.zeros(k), []
            for row in xs:
                g, u = row @ p[f"{d}W"] + p[f"{d}b"], h @ p[f"{d}U"]
                z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
                h = z * h + (1 - z) * np.tanh(g[2 * k :] + r * u[2 * k :])
                seq.append(h)
            states.append(seq if d == "f" else seq[::-1])
        s = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)
        e = np.exp(np.tanh(s @ p["A"] + p["Ab"]) @ p["v"])
        out.append(float(e @ s @ p["o"] / e.sum() + p["ob"][0]))
    return out


def test_scorer_against_a_plain_window_loop():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = [(" ".join([word() for _ in range(60)] + ["zork"] * (i % 2)), i % 2) for i in range(60)]
    model = toxicity.train(rows, rounds=1, epochs=1)
    texts = ["", "one", "a a a a", " ".join(f"w{i}" for i in range(5000)), " ".join(word() for _ in range(125)), "same " * 500, "zork " + " ".join(word() for _ in range(40))]
    scorer = toxicity.Scorer(model, memo=100)
    got = scorer.logits(texts)
    assert [len(x) for x in got] == [0, 1, 1, 312, 7, 31, 2]
    for text, x in zip(texts, got):
        if len(x):
            assert np.abs(np.array(plain_scores(model, text)) - x).max() < 1e-3


def labelled_docs(spark, n=240):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    common = [word() for _ in range(80)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        bad, toxic = i % 3 == 0, i % 2 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), "zorkw" + rng.choice(["a", "ing", "est"]))
        if bad:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    return labelled_docs(spark)


def test_toxicity_on_held_out(labelled, odd):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels, per_class=200)
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 20 and np.mean([(r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in rows]) >= 0.95
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["toxicity"] <= 1 for r in scored)
    assert [r["toxicity"] for r in scored if not (r["text"] or "").strip()] == [0.0] * 4
    assert len({r["toxicity"] for r in scored if r["doc_id"] in (0, 43, 44)}) == 1


def test_quality_on_held_out(labelled, odd):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels, per_class=200)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["quality_score"] >= 0.3) == bool(r["quality"]) for r in rows]) >= 0.95
    scored = quality.score_quality(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["quality_score"] <= 1 for r in scored)


def test_without_labels(spark, labelled, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(odd, empty)
    assert {r["toxicity"] for r in toxicity.score_toxicity(odd, model).collect()} == {0.0}
    assert toxicity.score_toxicity(none, model).collect() == []
    q = quality.fit_quality(none, empty)
    assert quality.score_quality(none, q).collect() == []
    assert {r["quality_score"] for r in quality.score_quality(odd, q).collect()} == {0.5}


def test_held_out_rows_are_never_learnt(spark, labelled):
    docs, labels = labelled
    ids = {t: i for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]}
    got = training_rows(docs, labels, "toxic", 50, 10_000)
    assert len(got) == 100 and all(zlib.crc32(str(ids[t]).encode()) % 5 for t, _ in got)


def test_repeated_ids_do_not_multiply(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)] * 20 + [(1, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = [("text 0", 1), ("b", 0)]
    assert training_rows(docs, labels, "toxic", 5, 100) == [x for i, x in enumerate(want, 1) if zlib.crc32(str(i).encode()) % 5]


def test_windows_cover_every_word():
    for n in range(1, 200):
        starts = list(toxicity.window_starts(n, 32))
        assert starts[0] == 0 and starts[-1] + 32 >= n and all(b - a == 16 for a, b in zip(starts, starts[1:]))


def test_context_vectors_against_brute_force():
    series = [np.array([1, 2, 3, 1, 2]), np.array([5]), np.array([], int), np.array([2, 2])]
    places, signs = quality.index_vectors(16)
    want = np.zeros((16, quality.DIM))
    for s in series:
        for i in range(len(s)):
            for j in range(max(0, i - 2), min(len(s), i + 3)):
                if i != j:
                    want[s[i], places[s[j]]] += signs[s[j]]
    assert (quality.contexts(series, 16, 2) == want).all()


def test_temperature_reduces_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    net = quality.TwoLayers(3, 8, 1)
    net.fit(x[:200], y[:200])
    loss = lambda: -np.mean(y[200:] * np.log(net.probability(x[200:])) + (1 - y[200:]) * np.log(1 - net.probability(x[200:])))
    before = loss()
    net.calibrate(x[200:], y[200:])
    assert loss() <= before + 1e-9


def test_a_worker_holds_what_one_operator_remembers():
    from cnvspark.llm import common, words

    words.word_hashes(["some words here"])
    assert len(words._HASHES) == 3
    common.working("tokens")
    assert not words._HASHES and common._HOLDS == ["tokens"]
    words.word_hashes(["other words"])
    common.working("words")
    assert len(words._HASHES) == 2
