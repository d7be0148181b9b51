"""Language identification: sample, reading of whole texts, odd inputs."""

import random

import numpy as np

from isobar.llm import language

EN = "the quick brown fox jumps over the lazy dog and then the other animals come with them to the house on the hill".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann kommen die anderen tiere mit ihnen zum haus auf dem hügel".split()


def some(words, n, seed):
    return " ".join(random.Random(seed).choice(words) for _ in range(n))


def test_segments_are_summed_as_they_are_read():
    net = language.Network(["a", "b", "c"])
    texts = [b"x", "ü".encode() * 300, b"two words, 12!" * 50]
    for t in texts:
        codes, own = language.segments(t), language.own_bytes(len(t))
        assert own.sum() == len(t)
        assert b"".join(bytes(c[language.MARGIN:language.MARGIN + n]) for c, n in zip(codes, own)) == t
        each = net.log_probabilities(codes.astype(np.int64))
        want = np.array([each[language.MARGIN:language.MARGIN + n, i].sum(0) for i, n in enumerate(own)])
        assert np.abs(net.label_sums(codes, own) - want).max() < 1e-2
        assert np.allclose(language.mean_scores(net, [t, t])[1], want.sum(0) / len(t), atol=1e-4)


def test_copies_do_not_fill_the_sample(spark):
    rows = [(some(EN, 40, 1), "en", "x")] * 600 + [(some(DE, 40, i), "de", "x") for i in range(30)] + [(some(EN, 40, i), "en", "x") for i in range(30)] + [(None, "fr", "x"), ("a", None, "x")]
    docs = spark.createDataFrame(rows, "text string, lang string, _h string")
    net = language.fit(docs, sample_docs=40)
    assert net.labels == ["de", "en"]
    odd = [some(DE, 9000, 5), some(EN, 50, 6), some(DE, 50, 7).upper(), None, "", " 12 !?", "\x00"]
    out = language.predict(spark.createDataFrame([(i, t, 3, "s") for i, t in enumerate(odd)], "i int, text string, score int, raw string"), net).orderBy("i").collect()
    assert [r["lang_pred"] for r in out] == ["de", "en", "de", "und", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in out) and {r["score"] for r in out[3:]} == {0.0}
    assert language.predict(docs.limit(0), net).count() == 0


def test_one_label_and_none(spark):
    docs = spark.createDataFrame([("some text", "en"), ("...", "en"), (None, None)], "text string, lang string")
    one = language.fit(docs)
    assert one.labels == ["en"]
    assert sorted((r["lang_pred"], r["score"]) for r in language.predict(docs, one).collect()) == [("en", 1.0), ("und", 0.0), ("und", 0.0)]
    none = language.fit(docs.filter("lang is null"))
    assert none.labels == [] and {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
