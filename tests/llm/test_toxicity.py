"""The toxicity model: its descent, its gradient, few labels, row order, and what the pipeline's stage keeps."""

import random

import corpus_pipeline
import numpy as np
import pytest
from lanewatt.llm import labelled, toxicity


def sample(n, seed=0, insults=("zorkblatt", "grumpfel")):
    rng = random.Random(seed)
    known = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    return [(" ".join(rng.choices(known, k=40) + [rng.choice(insults)] * (k % 4 == 0)), int(k % 4 == 0)) for k in range(n)]


def loss_of(rows, penalty=1e-3):
    return toxicity.Loss(toxicity.bags_of(rows, np.ones(toxicity.BUCKETS, bool)), penalty)


def test_gradient_is_the_slope_of_the_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 1 << 12)
    loss = loss_of(sample(24))
    rng = np.random.default_rng(1)
    theta = loss.start() + rng.normal(0, 0.3, len(loss.start()))  # in doubles
    _, grad = loss(theta)
    tail = np.arange(len(theta) - 2 * toxicity.DIMENSIONS - 2, len(theta))  # softmax weights and biases
    for at in [*tail, *rng.choice(np.flatnonzero(np.abs(grad) > 1e-4), 12)]:
        step = np.zeros(len(theta))
        step[at] = 1e-4
        assert (loss(theta + step)[0] - loss(theta - step)[0]) / 2e-4 == pytest.approx(grad[at], rel=2e-3, abs=1e-5)


@pytest.mark.parametrize("n", [8, 60, 400])
def test_loss_falls_at_every_step(n):
    loss = loss_of(sample(n))
    theta, losses = toxicity.descend(loss, loss.start())
    assert len(losses) > 3 and all(b <= a for a, b in zip(losses, losses[1:], strict=False))
    assert losses[-1] < 0.5 * losses[0] and np.isfinite(theta).all()


def test_evidence_needs_more_than_chance():
    one, zero = np.array([20, 20, 3, 0, 2]), np.array([0, 400, 1, 60, 0])
    got = toxicity.evidence(one, zero, 40, 800)
    assert got[0] > 0.5 and got[1] == 0 and got[2] < got[0] and got[4] == 0 and got.max() < 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_clean_texts_stay_whatever_the_number_of_labels_and_their_order(spark, sf):
    root = f"/root/testdata/{sf}"
    docs, marks = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    rows = [tuple(r) for r in labelled.training_sample(docs, marks, "toxic", toxicity.SAMPLE_PER_CLASS).collect()]
    held = [(r["text"] or "", r["toxic"]) for r in docs.join(marks, "doc_id").where(labelled.held_out()).collect()]
    before = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        model = toxicity.fit(rows)
        scores = np.array([model.score(t) for t, _ in held])
        label = np.array([y for _, y in held])
        assert (scores[label == 0] >= 0.5).mean() <= 0.02
        assert before is None or np.allclose(scores, before, atol=1e-2)  # sums in another order
        before = scores
    assert model.score("") < 0.5
    if sf == "sf0.1":
        assert (scores[label == 1] >= 0.5).mean() >= 0.9


def test_labels_that_say_nothing_give_the_share():
    rows = [(t, int(random.Random(i).random() < 0.2)) for i, (t, _) in enumerate(sample(80, insults=("ab",)))]
    model = toxicity.fit(rows)
    share = sum(y for _, y in rows) / len(rows)
    assert abs(model.score(rows[0][0]) - share) < 0.25 and all(model.score(t) < 0.5 for t, _ in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_keeps_clean_rows(spark, sf):
    root = f"/root/testdata/{sf}"
    docs, marks = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    extra = spark.createDataFrame([(None, None, "en", "s", 0), (10**6, "", "en", "s", 0), (10**6 + 1, " .. ", "en", "s", 4)], docs.schema)
    kept = corpus_pipeline.toxicity_stage(spark, docs.union(extra), root)
    clean = marks.where("toxic = 0")
    assert kept.join(clean, "doc_id").count() >= 0.98 * docs.join(clean, "doc_id").count()
    assert kept.where("doc_id IS NULL OR doc_id >= 1000000").count() == 3
    assert kept.count() >= 0.9 * docs.count()
