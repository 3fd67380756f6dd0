import random

import numpy as np
import pytest
from helpers import awkward, prose, table
from pyspark.sql import functions as F

from rillscan.llm import toxicity

BAD = ["grobian", "snotface", "wretchling", "dunderhead"]


def examples(n, seed, spell=lambda w: w):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = prose(seed * 1000 + k, rng.randrange(5, 120)).split()
        if k % 4 == 0:
            for _ in range(max(1, len(words) // 30)):
                words.insert(rng.randrange(len(words) + 1), spell(rng.choice(BAD)))
        out.append((" ".join(words), int(k % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.train(examples(500, 1))


def scored(model, texts):
    return toxicity.score(texts, model.of_grams(), float(model.bias[1] - model.bias[0]))


def test_held_out_accuracy_and_misspellings(model):
    for spell, least in ((lambda w: w, 0.85), (lambda w: w.upper() + "!", 0.85), (lambda w: w + "s", 0.4), (lambda w: w[:5] + "x" + w[5:], 0.15)):
        rows = examples(200, 7, spell)
        got = scored(model, [t for t, _ in rows])
        y = np.array([v for _, v in rows], bool)
        assert (got[y] >= 0.7).mean() > least and (got[~y] >= 0.7).mean() < 0.05
        above = (got[y][:, None] > got[~y][None, :]).mean()  # of all pairs of a toxic and a clean text
        assert above > 0.9


def test_score_is_the_mean_of_word_means(model, monkeypatch):
    def by_word(text):
        parts = []
        for w in toxicity._plain(text).split():
            marked, rows = b" " + w + b" ", []
            for n in toxicity.NGRAMS:
                for k in range(len(marked) - n + 1):
                    h = marked[k]
                    for c in marked[k + 1:k + n]:
                        h = (h * 0x01000193 + c) & 0xFFFFFFFF
                    rows.append(((h * 2654435761) & 0xFFFFFFFF) >> (32 - toxicity.ROW_BITS))
            parts.append(model.of_grams()[rows].mean() if rows else 0)
        logit = float(model.bias[1] - model.bias[0]) + (np.mean(parts) if parts else 0)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    texts = [t or "" for _, t, *_ in awkward()]
    assert np.allclose(scored(model, texts), [by_word(t) for t in texts], atol=1e-4)
    whole = scored(model, texts)
    monkeypatch.setattr(toxicity, "SLICE", 700)
    assert np.allclose(scored(model, texts)[:10], whole[:10], atol=1e-6)


def test_on_tables(spark, model):
    got = toxicity.scores(table(spark, awkward()), model).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scores(table(spark, []), model).count() == 0


def test_fit_uses_only_what_it_may(spark):
    rows = [(k, t, "", "", 0) for k, (t, _) in enumerate(examples(200, 3))]
    labels = [(k, y) for k, (_, y) in enumerate(examples(200, 3))] + [(None, 1), (5000, 1), (3, None)]
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    a = toxicity.fit(docs, known, F.col("doc_id") < 150)
    b = toxicity.fit(docs, known.filter("doc_id < 150"), F.lit(True))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.bias, b.bias)
    nothing = toxicity.fit(docs, known.limit(0), F.lit(True))
    assert np.allclose(scored(nothing, ["any text"]), 0.5, atol=0.1)


def test_abuse_at_the_ends_of_long_texts_is_learned(monkeypatch):
    rows = []
    for k in range(80):
        toxic, text = k % 2, prose(9000 + k, 1500)
        abuse = " ".join([BAD[k // 2 % 4]] * 60)
        rows.append((f"{abuse} {text} {abuse}" if toxic else text, toxic))
    learned = toxicity.train(rows)
    words = scored(learned, BAD)
    assert (words > 0.7).all() and (words > scored(learned, [prose(9999, 200)])[0]).all()
    whole = toxicity._bag(toxicity._plain(rows[1][0]))
    monkeypatch.setattr(toxicity, "SLICE", 700)
    sliced = toxicity._bag(toxicity._plain(rows[1][0]))
    assert np.array_equal(whole[0], sliced[0]) and np.allclose(whole[1], sliced[1], atol=1e-6)
