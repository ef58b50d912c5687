"""The field over lines: its features, its gradient, what it makes of the lines of bad documents, and its last curve."""

import random
from itertools import product

import numpy as np
import pytest
from lanewatt.llm import quality

OWN = quality.OWN


def test_features_are_the_lines_own_and_its_neighbours():
    text = "The river runs low.\n\nbuy buy buy buy buy !!!\nThe river runs low.\nA | B | C"
    x, lengths = quality.line_features(text)
    lines = text.split("\n")
    assert x.shape == (5, quality.FEATURES) and lengths.tolist() == [len(line) for line in lines]
    for i in range(5):
        before, after = x[i, OWN : 2 * OWN], x[i, 2 * OWN : 3 * OWN]
        assert np.array_equal(before, x[i - 1, :OWN] if i else np.zeros(OWN, np.float32))
        assert np.array_equal(after, x[i + 1, :OWN] if i < 4 else np.zeros(OWN, np.float32))
        assert x[i, 3 * OWN :].tolist() == [float(i == 0), float(i == 4), 1.0]
    repeated, blank, ended = x[:, 10], x[:, 11], x[:, 12]
    assert repeated.tolist() == [0, 0, 0, 1, 0] and blank.tolist() == [0, 1, 0, 0, 0] and ended.tolist() == [1, 0, 1, 1, 0]
    # a line's own features hang on nothing but the line, repetition apart
    alone = np.stack([quality.line_features(line)[0][0, :OWN] for line in lines])
    alone[3, 10] = 1
    assert np.array_equal(x[:, :OWN], alone)


def test_an_empty_text_is_one_empty_line():
    x, lengths = quality.line_features("")
    assert x.shape == (1, quality.FEATURES) and lengths.tolist() == [0] and np.isfinite(x).all()
    assert len(quality.line_features("\n\n")[0]) == 3


def likelihood(params, X, y, weight):
    """The penalised log likelihood by enumeration of all labellings, each document by its weight."""
    emit, move = params[: quality.FEATURES], params[quality.FEATURES :].reshape(2, 2)
    total = 0.0
    for x, own, w in zip(X, y, weight, strict=True):
        z = x @ emit
        say = lambda s: sum(z[k] * s[k] for k in range(len(s))) + sum(move[a, b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023, E731
        ways = [say(s) for s in product((0, 1), repeat=len(x))]
        total += w * (say([int(v) for v in own]) - np.logaddexp.reduce(ways))
    return total / sum(w * len(x) for x, w in zip(X, weight, strict=True)) - 0.5e-4 * (params @ params)


def documents(rng):
    X = [rng.normal(size=(n, quality.FEATURES)) for n in (3, 1, 5, 2)]
    return X, [rng.integers(0, 2, len(x)).astype(float) for x in X], np.array([0.3, 1.0, 0.2, 0.7])


def test_a_step_follows_the_slope_of_the_likelihood(monkeypatch):
    """The first step moves every weight by one rate, up or down as the likelihood rises."""
    monkeypatch.setattr(quality, "STEPS", 1)
    rng = np.random.default_rng(4)
    X, y, weight = documents(rng)
    start = rng.normal(0, 0.3, quality.FEATURES + 4)
    after = quality._fit_chain(X, y, weight, quality.Chain(start[:-4], start[-4:].reshape(2, 2)))
    moved = np.concatenate((after.emit, after.move.reshape(-1))) - start
    for at in range(len(start)):
        h = np.zeros(len(start))
        h[at] = 1e-5
        slope = (likelihood(start + h, X, y, weight) - likelihood(start - h, X, y, weight)) / 2e-5
        if abs(slope) > 1e-5:
            assert np.sign(moved[at]) == np.sign(slope) and abs(moved[at]) == pytest.approx(0.2, rel=1e-2), at


def test_fitting_raises_the_likelihood():
    rng = np.random.default_rng(5)
    X, y, weight = documents(rng)
    fitted = quality._fit_chain(X, y, weight, quality.Chain(np.zeros(quality.FEATURES), np.zeros((2, 2))))
    found = np.concatenate((fitted.emit, fitted.move.reshape(-1)))
    assert likelihood(found, X, y, weight) > likelihood(np.zeros(len(found)), X, y, weight) + 0.3


def mixed(seed, n=120):
    """Good documents of plain lines; bad ones with two lines of noise among four plain ones."""
    rng = random.Random(seed)
    plain = lambda: " ".join(rng.choices(["the", "river", "runs", "low", "under", "an", "old", "bridge"], k=rng.randint(5, 9))).capitalize() + "."
    noise = lambda: " ".join(rng.choices(["$$$", "WIN", "#1", "!!!", "@@", "BUY", "%%"], k=rng.randint(5, 9)))
    rows = []
    for k in range(n):
        lines = [plain() for _ in range(6)]
        if k % 2 == 0:
            at = rng.randrange(5)
            lines[at : at + 2] = [noise(), noise()]
        rows.append(("\n".join(lines), k % 2))
    return rows


def line_truth(chain, rows):
    """(found bad, noise, of a bad document), an entry a line."""
    out = []
    for text, q in rows:
        (p,) = chain.marginals([quality.line_features(text)[0]])
        out += [(v < 0.5, any(c in line for c in "$#!@%") or line.isupper(), q == 0) for v, line in zip(p, text.split("\n"), strict=True)]
    return np.array(out).T


def test_noise_is_bad_and_lines_of_good_documents_are_good():
    bad, noise, of_bad = line_truth(quality.fit(mixed(1)), mixed(2, 40))
    assert bad[noise].mean() >= 0.95 and bad[~of_bad].mean() <= 0.05


@pytest.mark.xfail(strict=True, reason="all of them are called bad; with the fitted transitions at 0, 0.44 of them")
def test_plain_lines_of_bad_documents_become_good():
    bad, noise, of_bad = line_truth(quality.fit(mixed(1)), mixed(2, 40))
    assert bad[of_bad & ~noise].mean() <= 0.2


def test_the_curve_is_the_best_of_its_kind():
    rows = mixed(3)
    chain = quality.fit(rows)
    feats = [quality.line_features(t) for t, _ in rows]
    lengths, labels = [n for _, n in feats], np.array([q for _, q in rows])
    marginals = chain.marginals([x for x, _ in feats])
    raw, score = quality.goodness(marginals, lengths), chain.score(marginals, lengths)
    for d in range(5):  # the mean of the marginals, by length
        mean = sum(p * (n + 1) for p, n in zip(marginals[d], lengths[d], strict=True)) / sum(n + 1 for n in lengths[d])
        assert raw[d] == pytest.approx(np.log(mean / (1 - mean)), abs=1e-6)
    assert (raw * (labels - score)).sum() == pytest.approx(0.01 * chain.slope, abs=1e-4)
    assert (labels - score).sum() == pytest.approx(0.01 * chain.shift, abs=1e-4)
    assert chain.slope > 0 and ((score >= 0.5) == labels).mean() > 0.95


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_gives_scores_near_it(label):
    chain = quality.fit([("Some words here.", label)] * 3)
    (score,) = chain.score(chain.marginals([quality.line_features("other words")[0]]), [np.array([11])])
    assert abs(score - label) < 0.01
    empty = quality.fit([])
    assert empty.score(empty.marginals([quality.line_features("")[0]]), [np.array([0])])[0] == 0.5
