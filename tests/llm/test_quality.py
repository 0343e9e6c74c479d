import os

import numpy as np
import pytest

from corpusmill.llm.quality import STATISTICS, fit_additive, score_quality, statistics, train_quality

SF_DIR = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = np.asarray(labels, bool)
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_tables_learn_a_curve_and_pairs_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (4000, 3))
    curve = (np.abs(x[:, 0]) > 0.5).astype(float)
    model = fit_additive(x[:3000], curve[:3000], n_pairs=0)
    assert auc(model.logits(x[3000:]), curve[3000:]) > 0.98
    crossed = ((x[:, 1] > 0) ^ (x[:, 2] > 0)).astype(float)
    alone = fit_additive(x[:3000], crossed[:3000], n_pairs=0)
    paired = fit_additive(x[:3000], crossed[:3000], n_pairs=1)
    assert {paired.pairs[0][0], paired.pairs[0][1]} == {1, 2}
    assert auc(paired.logits(x[3000:]), crossed[3000:]) > 0.95 > 0.7 > auc(alone.logits(x[3000:]), crossed[3000:])


def test_one_label_or_no_rows():
    assert (fit_additive(np.zeros((5, 2)), np.ones(5)).logits(np.zeros((3, 2))) > 0).all()
    assert fit_additive(np.zeros((0, 2)), np.zeros(0)).logits(np.zeros((3, 2))).shape == (3,)


def test_statistics_by_hand():
    row = dict(zip(STATISTICS, statistics(["Ab 1|\nAb 1|\né!".encode()])[0]))
    assert row["upper"] == 2 / 15 and row["bar"] == 2 / 15 and row["beyond"] == 2 / 15 and row["shout"] == 1 / 15
    assert row["distinct"] == 3 / 5 and abs(row["repeated_lines"] - 1 / 3) < 1e-12 and row["commonest"] == 2 / 5
    assert not statistics([b""])[0].any()


def test_messy_and_empty_tables(spark, messy, empty, messy_rows):
    labels = spark.createDataFrame([(None, 1), (0, None), (3, 0), (4, 1), (5, 0), (6, 1), (7, 1)],
                                   "doc_id long, quality int")
    for docs, n in ((messy, len(messy_rows)), (empty, 0)):
        scored = score_quality(docs, train_quality(docs, labels)).collect()
        assert len(scored) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scored)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_held_out_accuracy(spark):
    from corpusmill.llm.bindings import QUERIES

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in QUERIES["op8_quality"](spark, SF_DIR).collect()
            if r.held_out and r.doc_id in labels]
    assert auc([s for s, _, _ in held], [y for _, _, y in held]) > 0.95
    assert np.mean([p for _, p, y in held if y]) > 0.95
