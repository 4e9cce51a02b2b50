import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoflow.llm import language, toxicity

SYLLABLES = {"en": ["the", "ing", "ow", "sh", "ed"], "fr": ["é", "eau", "oi", "que", "an"], "de": ["ung", "ch", "ß", "ei", "tz"]}


def sentence(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_ngrams_and_profiles():
    codes, counts = language.ngrams("Ab, ab")
    assert counts.sum() == 4 + 6 + 4 and len(codes) == 2 + 3 + 2
    assert [len(language.ngrams(x)[0]) for x in (None, "", "12 !?")] == [0, 0, 0]
    assert len(language.profile(codes, counts, 3)) == 3
    p = language.Profiles({"b": [1, 2], "a": [1, 2]}, 2)
    assert p.languages == ["a", "b"]


def test_language(spark):
    rng = random.Random(0)
    rows = [(i, sentence(rng, lang), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !", "en"), (903, sentence(rng, "fr", 20000), "fr"), (None, sentence(rng, "de"), None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    profiles = language.learn_profiles(docs.where(~language.held_out(3, 1)), per_language=30)
    got = {str(r.doc_id): r for r in language.predict_language(docs, profiles).collect()}
    assert all(got[str(i)].lang_pred == lang and 0 < got[str(i)].score <= 1 for i, t, lang in rows if lang and t and i != 902)
    assert all((got[str(i)].lang_pred, got[str(i)].score) == ("und", 0.0) for i in (900, 901, 902)) and got["None"].lang_pred == "de"
    none = language.learn_profiles(docs.limit(0))
    assert language.predict_language(docs, none).where("lang_pred <> 'und'").count() == 0
    kept = language.predict_language(docs, profiles, keep=docs.columns, names=("a", "b"))
    assert kept.columns == [*docs.columns, "a", "b"] and language.predict_language(docs.limit(0), profiles).count() == 0


def test_held_out(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").withColumn("h", language.held_out(3, 1))
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())


def brute_kernel(s, t):
    """Normalized kernel of two units by its definition: common gapped subsequences of both lengths."""

    def phi(u):
        letters = [toxicity._EDGE, *(ord(c) - 96 for c in u), toxicity._EDGE]
        out, norm = {}, 0.0
        for pattern in toxicity._PATTERNS:
            for i in range(len(letters)):
                if i + pattern[-1] < len(letters):
                    w = toxicity._DECAY ** (pattern[-1] + 1 - len(pattern))
                    key = tuple(letters[i + o] for o in pattern)
                    out[key] = out.get(key, 0.0) + w
                    norm += w * w
        return {k: v / norm**0.5 for k, v in out.items()}

    a, b = phi(s), phi(t)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_kernel_and_scores():
    units = ["loser", "losser", "lxoser", "winner", "ab", "idiot"]
    rows, hashes, values = toxicity.feature_rows(units)
    dense = np.zeros((len(units), 1 << toxicity._HASH_BITS))
    np.add.at(dense, (rows, hashes), values)
    for i, s in enumerate(units):
        for j, t in enumerate(units):
            assert dense[i] @ dense[j] == pytest.approx(brute_kernel(s, t), abs=1e-6)
    weights = dense[0].astype(np.float32)
    assert toxicity.unit_scores(units, weights, 0.0) == pytest.approx(dense @ dense[0], abs=1e-4)
    k = dense @ dense[0]
    assert k[1] > 0.5 > k[3] and k[2] > 0.4


def test_machine_equals_explicit_features():
    """Scores of the folded weights are those of theta over K_zz^(-1/2) K(z, s), solved apart."""
    good, bad = ["winner", "garden", "window", "letter", "ab"], ["loser", "idiot", "moron"]
    weights, bias = toxicity.fit_svm(bad, good, landmarks=20, c=3.0, balance=0.2, disguise=0.0)
    marks = bad + good
    k = np.array([[brute_kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    whiten = vectors / np.sqrt(values)
    x = np.hstack([k @ whiten, np.ones((len(marks), 1))])
    y = np.array([1.0] * 3 + [-1.0] * 5)
    cost = np.where(y > 0, 3.0, 3.0)
    theta = np.zeros(x.shape[1])
    for _ in range(200_000):  # plain gradient descent on the same loss
        gap = np.maximum(0, 1 - y * (x @ theta))
        grad = np.append(2 * theta[:-1], 2e-6 * theta[-1]) - 2 * x.T @ (cost * y * gap)
        theta -= 0.005 * grad
    probe = ["loser", "losser", "idi0t", "winner", "gardener", "xyz"]
    kernel = np.array([[brute_kernel(u, z) for z in marks] for u in map(toxicity.unit, probe)])
    want = kernel @ whiten @ theta[:-1] + theta[-1]
    assert toxicity.unit_scores([toxicity.unit(u) for u in probe], weights, bias) == pytest.approx(want, abs=2e-3)


def test_sentences(spark):
    assert toxicity.sentences("You idiot. I am\nl o s e r! 12 ... ") == [["idiot", "you"], ["am", "i"], ["e", "l", "loser", "o", "r", "s"]]
    assert toxicity.sentences(None) == toxicity.sentences("") == []
    docs = spark.createDataFrame([("A b. You idiot.", 1), ("A b.", 0), ("You idiot. You idiot.", 1)], "text string, toxic int")
    got = {(r.units, r.toxic) for r in toxicity.labelled_sentences(docs).collect()}
    assert got == {("a b", 0), ("idiot you", 1)}
    assert toxicity.disguised("idiot") == toxicity.disguised("idiot") and {len(u) for u in toxicity.disguised("idiot")} == {6}


def test_units():
    assert [toxicity.unit(x) for x in ("Loser,", "l0s3r!", "i.d.i.o.t", "***", "12", "Été.")] == ["loser", "loser", "idiot", "", "", "été"]
    assert toxicity.spaced_units("you i d i o t go a b") == ["idiot"]


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = sentence(rng, "en", 60).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["loser", "idiot", "zucki" + rng.choice(["an", "om", "el"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 50 == 1 else int(bad)))
    rows += [(900, None), (901, ""), (902, "!!!"), (903, sentence(rng, "en", 20000)), (None, "you l.o.s.e.r and i d i o t and idi0t"), (904, "you l.o.s.e.r and i d i o t and idi0t zuckiab")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, toxic int").repartition(3)
    lab = spark.createDataFrame([*labels, labels[0], (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_model(toxicity.training_rows(docs, lab))
    got = {str(r.doc_id): r.score for r in toxicity.score_toxicity(docs, model).collect()}
    truth = {i: i % 4 == 0 for i in range(600)}
    right = [(got[str(i)] >= 0.5) == bad for i, bad in truth.items()]
    assert np.mean(right) > 0.97 and all(0 <= x <= 1 for x in got.values())
    assert max(got[str(i)] for i in (900, 901, 902)) < 0.5 and got["903"] < 0.5 and got["904"] >= 0.5 and got["None"] == pytest.approx(got["None"])
    nothing = toxicity.fit_model(toxicity.training_rows(docs, lab.limit(0)))
    assert toxicity.score_toxicity(docs, nothing).where(F.col("score") >= 0.5).count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
