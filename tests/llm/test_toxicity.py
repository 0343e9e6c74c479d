import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from conftest import prose

from corpusmill.llm.toxicity import (SPACE, LinearModel, Patterns, SparkPatterns, descend, fit_nnpu, keep_clean,
                                     score_toxicity, text_features, train_toxicity, without_copies, word_features)
from corpusmill.llm.words import WordTable, crc_of

SF_DIR = "/root/testdata/sf0.1"


def corpus(n=600, share=0.2, seed=4):
    rng = random.Random(seed)
    rows, toxic = [], []
    for i in range(n):
        words = [f"{w}{rng.randrange(300)}" for w in prose(5000 + i, rng.randrange(20, 120)).split()]
        bad = rng.random() < share
        for _ in range(rng.randrange(1, 4) * bad):
            words[rng.randrange(len(words))] = rng.choice(["Scoundrel,", "knave", "rascally", "rascals"])
        rows.append((i, " ".join(words)))
        toxic.append(int(bad))
    return rows, toxic


def test_learns_from_positive_and_unlabelled_texts():
    rows, toxic = corpus()
    features = text_features(WordTable(word_features), [t.encode() for _, t in rows])
    positive = [f for f, t in zip(features[:300], toxic) if t]
    model = fit_nnpu(positive, features, prior=sum(toxic) / len(toxic))
    scores = model.logits(WordTable(word_features), [t.encode() for _, t in rows[300:]])
    assert np.mean((scores >= 0) == np.array(toxic[300:], bool)) > 0.97


def test_a_feature_counts_once_per_text():
    weights = np.zeros(SPACE + 1, np.float32)
    weights[word_features([b"knave"])[0, 0]] = 2
    model, table = LinearModel(weights, -1.0), WordTable(word_features)
    assert model.logits(table, [b"knave Knave, KNAVE!", b"knaves", b""]).tolist() == [1.0, -1.0, -1.0]


def test_near_copies_count_once():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(100_000, 300, replace=False)).astype("<i4")
    copies = [np.sort(np.concatenate([base[5:], rng.integers(0, 100_000, 5)])).astype("<i4") for _ in range(20)]
    others = [np.sort(rng.choice(100_000, 300, replace=False)).astype("<i4") for _ in range(10)]
    assert len(without_copies([base, *copies, *others])) == 11


def test_only_near_copies_go():
    """Texts of likeness 0.3 to 0.7 stay, however many there are, and the order they come in changes nothing."""
    rng = np.random.default_rng(5)
    common = np.arange(240)
    texts = [np.sort(np.concatenate([rng.choice(common, 160, replace=False),
                                     1000 + rng.choice(100_000, 40, replace=False)])).astype("<i4") for _ in range(400)]
    copies = [np.sort(np.append(t, 200_000 + i)).astype("<i4") for i, t in enumerate(texts[:100])]
    kept = without_copies([*texts, *copies])
    assert len(kept) == 400

    def jaccard(a, b):
        both = len(np.intersect1d(a, b))
        return both / (len(a) + len(b) - both)

    assert max(jaccard(a, b) for i, a in enumerate(kept[:150]) for b in kept[:i]) < 0.8
    again = without_copies([*copies, *texts][::-1])
    assert sorted(t.tobytes() for t in again) == sorted(t.tobytes() for t in kept)


def test_a_term_of_few_positive_texts_is_weighed():
    rng = np.random.default_rng(6)

    def text(*more):
        return np.unique([*rng.choice(np.arange(100, 50_000), 30, replace=False), *more]).astype("<i4")

    positive = [text(7 if i < 12 else 9) for i in range(1200)]  # a hundredth holds 7
    unlabelled = [text(*[9] * (i % 10 == 0)) for i in range(2000)]
    model = fit_nnpu(positive, unlabelled, prior=0.1)
    assert model.weights[7] > 0.5 and model.weights[9] > 0.5


def plain_fit(positive, unlabelled, n, prior, steps, rate=0.05, thin=2e-4):
    """The estimator by plain loops over texts and features."""
    w, b, m, v = [0.0] * n, math.log(prior / (1 - prior)), [0.0] * (n + 1), [0.0] * (n + 1)

    def soft(z):
        return math.log1p(math.exp(z)) if z < 30 else z

    def cell(z):
        return 1 / (1 + math.exp(-z))

    for step in range(1, steps + 1):
        p, u = ([b + sum(w[f] for f in t) for t in side] for side in (positive, unlabelled))
        part = sum(map(soft, u)) / len(u) - prior * sum(map(soft, p)) / len(p)
        grad = [0.0] * (n + 1)

        def add(texts, slopes):
            for t, s in zip(texts, slopes):
                for f in t:
                    grad[f] += s
                grad[n] += s

        sign = 1 if part >= 0 else -1
        add(unlabelled, [sign * cell(z) / len(u) for z in u])
        add(positive, [-sign * prior * cell(z) / len(p) for z in p])
        if part >= 0:
            add(positive, [-prior * cell(-z) / len(p) for z in p])
        for i in range(n + 1):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad[i], 0.99 * v[i] + 0.01 * grad[i] ** 2
            move = rate * (m[i] / (1 - 0.9 ** step)) / (math.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
            if i == n:
                b -= move
            else:
                w[i] = math.copysign(max(abs(w[i] - move) - thin, 0), w[i] - move)
    return w, b


@pytest.mark.parametrize("prior", [0.1, 0.6])  # the second reaches the negative part
def test_fit_agrees_with_plain_loops(spark, prior):
    rng = random.Random(7)
    positive = [sorted(rng.sample(range(6), rng.randrange(1, 4))) for _ in range(30)]
    unlabelled = [sorted(rng.sample(range(6), rng.randrange(3))) for _ in range(80)]
    want_w, want_b = plain_fit(positive, unlabelled, 6, prior, 60)
    kinds = Counter(tuple(t) for t in unlabelled if t)
    arrays = [np.array(t, "<i4") for t in kinds]
    table = spark.createDataFrame([(bytearray(a.tobytes()), n) for a, n in zip(arrays, kinds.values())],
                                  "pattern binary, n long")
    sides = [Patterns([np.array(t, np.int64) for t in unlabelled], np.ones(80), 80),
             Patterns(arrays, list(kinds.values()), 80), SparkPatterns(table, sum(kinds.values()), 80)]
    for side, steps in zip(sides, (60, 60, 6)):
        w, b = descend([np.array(t) for t in positive], side, 6, prior, steps)
        if steps < 60:
            want_w, want_b = plain_fit(positive, unlabelled, 6, prior, steps)
        assert np.allclose(w, want_w, atol=1e-6) and abs(b - want_b) < 1e-6  # rounding, enlarged by small moments


def test_sums_in_tasks_give_the_same_model(spark, make_docs):
    rows, toxic = corpus(150)
    labels = spark.createDataFrame([(i, t) for (i, _), t in zip(rows, toxic)], "doc_id long, toxic int")
    one, other = (train_toxicity(make_docs(rows), labels, driver_cells=c, steps=3) for c in (10**6, 0))
    assert np.count_nonzero(one.weights) and np.allclose(one.weights, other.weights, atol=1e-6)
    assert abs(one.bias - other.bias) < 1e-9


def test_equal_texts_count_once(spark, make_docs):
    rows, toxic = corpus(200)
    labels = spark.createDataFrame([(i, t) for (i, _), t in zip(rows, toxic)], "doc_id long, toxic int")
    copies = [(1000 + i, rows[next(j for j, t in enumerate(toxic) if t)][1]) for i in range(300)]
    one, other = (train_toxicity(make_docs(r), labels) for r in (rows, rows + copies))
    assert (one.weights == other.weights).all() and one.bias == other.bias


def test_nothing_to_learn_from_gives_the_prior():
    assert abs(1 / (1 + np.exp(-fit_nnpu([], [], 0.25).bias)) - 0.25) < 1e-9


def test_held_out_labels_change_nothing(spark, make_docs):
    rows, toxic = corpus(200)
    labels = [(i, t) for (i, _), t in zip(rows, toxic)]
    turned = [(i, t if crc_of(i) % 5 else 1 - t) for i, t in labels]
    models = [train_toxicity(make_docs(rows), spark.createDataFrame(x, "doc_id long, toxic int"))
              for x in (labels, turned)]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()


def test_messy_and_empty_tables(spark, messy, empty, messy_rows):
    rows, toxic = corpus(200)
    labels = spark.createDataFrame([(None, 1), (1, None), *[(i, t) for (i, _), t in zip(rows, toxic)]],
                                   "doc_id long, toxic int")
    for docs, n in ((messy, len(messy_rows)), (empty, 0)):
        model = train_toxicity(docs, labels)
        scored = score_toxicity(docs, model).collect()
        assert len(scored) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scored)
        kept = keep_clean(docs, labels, threshold=1.1)
        assert kept.columns == docs.columns and kept.count() == n
        assert sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in score_toxicity(messy, train_toxicity(messy, none)).collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_held_out_accuracy(spark):
    from corpusmill.llm.bindings import QUERIES

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in QUERIES["op3_toxicity"](spark, SF_DIR).collect()
            if r.held_out and r.doc_id in labels]
    caught = np.mean([p for p, y in held if y])
    clean = np.mean([1 - p for p, y in held if not y])
    assert caught > 0.85 and clean > 0.95
