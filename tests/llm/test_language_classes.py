"""Classes of words that are no exchange units: planted neighbours, and probabilities that sum to 1."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewell.llm import brown


@pytest.fixture(scope="module")
def learned(spark):
    """Texts that alternate words a* and b*; a few words rare enough to be no units stand only where an a* or a b* would."""
    rng = random.Random(5)
    words = [[f"{'ab'[i % 2]}{rng.randrange(10)}" for i in range(100)] for _ in range(500)]
    for n, word in enumerate([f"r{kind}{i}same" for kind in "ab" for i in range(8)]):
        for j in range(brown.FEW):
            words[n * 10 + j][10 + (word[1] == "b")] = word
    words[499][3] = "once"
    texts = spark.createDataFrame([(" ".join(w),) for w in words], "text string")
    counts = {bytes(r["word"]): r["c"] for r in brown.count_words(texts).collect()}
    tokens = sum(counts.values())
    known = sorted(counts.items())
    args = ([w for w, _ in known], [c for _, c in known], tokens)
    shipped = spark.sparkContext.broadcast(args)
    lexicon = brown.Lexicon(*args)
    others = spark.createDataFrame(known, "word binary, c long").filter(
        (F.col("c") < brown.FEW) & (F.col("c") * brown.UNIT_SHARE < tokens) & (F.length("word") > 0)
    )
    return lexicon, counts, tokens, brown.learn(texts, others, shipped, lexicon)


def test_rare_words_take_the_class_of_their_neighbours(learned):
    lexicon, counts, tokens, model = learned
    of = {w.decode(): int(model["own"][i]) for w, i in lexicon.index.items()}
    kind = {k: {int(model["cls"][lexicon.unit[lexicon.index[f"{k}{i}".encode()]]]) for i in range(10)} for k in "ab"}
    assert not kind["a"] & kind["b"]
    for i in range(8):  # equal endings, so nothing but the neighbours tells them apart
        assert of[f"ra{i}same"] in kind["a"] and of[f"rb{i}same"] in kind["b"]
    assert of["once"] == -1 and of["a1"] == -1


def test_probabilities_sum_to_one(learned):
    lexicon, counts, tokens, model = learned
    assert np.allclose((10.0 ** model["step"]).sum(1), 1)
    total = np.zeros(len(model["emit"]))
    kinds = np.zeros(brown.ENDINGS)
    mass = np.zeros(brown.ENDINGS)
    for w, i in lexicon.index.items():
        c, ending = lexicon.classes(np.array([i]), lexicon.unit[[i]], model["cls"], model["own"])
        left = model["left"][ending[0]] if ending[0] >= 0 else 0.0
        total[c[0]] += 10 ** (np.log10(counts[w] + 0.5) - model["emit"][c[0]] + left)
        if ending[0] >= 0:
            kinds[ending[0]] += 1
            mass[ending[0]] += counts[w]
    for e in range(brown.ENDINGS):  # one unseen word in each ending
        c = model["cls"][lexicon.first_ending + e]
        total[c] += 10 ** (np.log10(0.5) - model["emit"][c] + model["left"][e])
    assert np.allclose(total[np.bincount(model["cls"], minlength=len(total)) > 0], 1)


def test_scores_are_the_sum_of_the_models_terms(spark):
    """Scores of whole rows against the model read word by word; words that no task holds included."""
    rng = random.Random(6)
    texts = [" ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(0, 300))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "w1 never w2"), (1001, ""), (1002, None)]
    got = {r["doc_id"]: r for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 150).collect()}
    train = spark.createDataFrame([(t,) for t in texts[:150]], "text string")
    counts = {bytes(r["word"]): r["c"] for r in brown.count_words(train).collect()}
    tokens = sum(counts.values())
    known = sorted(counts.items())
    args = ([w for w, _ in known], [c for _, c in known], tokens)
    lexicon = brown.Lexicon(*args)
    others = spark.createDataFrame(known, "word binary, c long").filter(
        (F.col("c") < brown.FEW) & (F.col("c") * brown.UNIT_SHARE < tokens) & (F.length("word") > 0)
    )
    model = brown.learn(train, others, spark.sparkContext.broadcast(args), lexicon)
    for i, text in rows:
        before, score = 0, 0.0
        for w in [*brown.words_of(text), brown.END]:
            at = lexicon.index.get(w, -1)
            unit = lexicon.unit[at] if at >= 0 else lexicon.first_ending + brown.ending(w)
            c, ending = lexicon.classes(np.array([at]), np.array([unit]), model["cls"], model["own"])
            score += model["step"][before, c[0]] + np.log10(counts.get(w, 0) + 0.5) - model["emit"][c[0]]
            score += model["left"][ending[0]] if ending[0] >= 0 else 0.0
            before = c[0]
        assert got[i]["score"] == pytest.approx(score, abs=1e-6), i
