"""Toxicity from averaged subword-bag embeddings under a linear softmax."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fitted, held_out, training_sample

BUCKETS = 1 << 20
#: Labelled texts for fitting, at most, of clean and of toxic ones.
SAMPLE_PER_CLASS = (4500, 2500)
SHORTEST, LONGEST = 3, 6
#: Words without a vector that every text is averaged with, so that a few words alone don't decide.
BLANKS = 20
DIMENSIONS = 4
#: The most steps of one descent; it ends before if the loss no longer falls by this share.
STEPS, SETTLED = 120, 1e-4
#: Steps whose curvature the descent remembers.
MEMORY = 4
#: Weights of the squared parameters that are tried, heaviest first; the loss on a part of the texts chooses.
PENALTIES = (1e-2, 3e-3, 1e-3, 3e-4, 1e-4, 3e-5)
#: One text in so many is left out of the fits that choose.
APART = 4
#: Averages are small numbers; scaled by this, and by the root of the number of words, they train at a common rate. The
#: root keeps a few words of a long text above what the chance mix of the others adds up to.
SCALE = 8.0
#: Classes weigh by their odds to this power: between counting texts alike and counting classes alike.
ODDS = 0.5
LEAST_TEXTS = 3
_WORD = re.compile(r"\w+")


def subword_bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character n-grams, with their weights: each distinct word weighs one over the number of them
    and ``BLANKS``, times the root of that number, and shares that out among its n-grams. Words are runs of letters and
    digits in lower case, with a mark at either end.
    """
    words = dict.fromkeys(_WORD.findall(text.lower()))
    padded = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "replace"), np.uint32)
    gap = padded == 0
    marks = np.flatnonzero(gap)
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    lengths = np.diff(marks) - 1
    word = np.cumsum(gap) - 1
    inner = np.cumsum(gap)
    per_word = np.zeros(len(lengths))
    hashes, owners = [], []
    rolled = np.zeros(len(padded), np.uint32)
    for n in range(1, LONGEST + 1):
        rolled = (rolled[: len(padded) - n + 1] * np.uint32(16777619)) ^ padded[n - 1 :] if n > 1 else padded.copy()
        if n < SHORTEST or len(padded) < n:
            continue
        starts = np.flatnonzero(inner[n - 2 : len(padded) - 1] == inner[: len(padded) - n + 1])  # no mark but at the ends
        h = rolled[starts] * np.uint32(2654435761 + 2 * n)
        hashes.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
        owners.append(word[starts])
        per_word += np.bincount(owners[-1], minlength=len(per_word) + 1)[: len(per_word)]
    where = np.concatenate(owners)
    share = SCALE / (np.maximum(per_word, 1) * np.sqrt(len(lengths) + BLANKS))
    return np.concatenate(hashes).astype(np.int64), share[where]


@dataclass
class SubwordModel:
    """Per bucket the difference of the two classes' logits: embedding times softmax weights, folded for scoring."""

    logits: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        buckets, weights = subword_bag(text)
        z = self.bias + float(self.logits[buckets] @ weights)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class Bags:
    """The texts' bags in one sparse matrix, row by row, with labels and the weights of their losses."""

    column: np.ndarray
    value: np.ndarray
    row: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    columns: int

    def part(self, keep: np.ndarray) -> Bags:
        entries = keep[self.row]
        return Bags(self.column[entries], self.value[entries], (np.cumsum(keep) - 1)[self.row[entries]], self.y[keep], self.weight[keep], self.columns)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.column], len(self.y))

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.columns)


def evidence(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How much of each n-gram's vector the texts support, 0 to 1: one less the share that chance may have of its
    log-likelihood ratio between the classes, where chance is the highest ratio to be expected among as many n-grams
    that say nothing. Those that don't pass it, or that fewer than ``LEAST_TEXTS`` texts hold, get 0."""
    both = with_1 + with_0
    kept = both >= LEAST_TEXTS

    def term(seen, expected):
        return seen * np.log(np.where(seen > 0, seen, 1) / np.maximum(expected, 1e-300))

    share = n1 / (n1 + n0)
    ratio = 2 * (term(with_1, both * share) + term(with_0, both * (1 - share)) + term(n1 - with_1, (n1 + n0 - both) * share) + term(n0 - with_0, (n1 + n0 - both) * (1 - share)))
    chance = 2 * np.log(max(int(kept.sum()), 2))
    return np.where(kept, np.maximum(0, 1 - chance / np.maximum(ratio, 1e-9)), 0).astype(np.float32)


def bags_of(sample: list[tuple[str, int]], known: np.ndarray) -> Bags:
    """The bags of ``sample`` over the buckets that are ``known``."""
    y, column, value, sizes = np.array([label for _, label in sample], np.int64), [], [], []
    place = np.cumsum(known, dtype=np.int32) - 1  # known buckets, numbered through
    for text, _ in sample:
        buckets, weights = subword_bag(text)
        buckets, weights = buckets[known[buckets]], weights[known[buckets]]
        own, at = np.unique(buckets, return_inverse=True)
        column.append(place[own])
        value.append(np.bincount(at, weights, len(own)).astype(np.float32))
        sizes.append(len(own))
    count = np.maximum(np.bincount(y, minlength=2), 1)
    weight = ((len(y) / (2 * count)) ** ODDS)[y]
    return Bags(np.concatenate(column), np.concatenate(value), np.repeat(np.arange(len(y), dtype=np.int32), sizes), y, weight, int(known.sum()))


def _log_loss(z: np.ndarray, bags: Bags) -> float:
    """Mean of the softmax's weighted log loss; ``z`` is the toxic logit less the clean one."""
    return float(bags.weight @ np.logaddexp(0, np.where(bags.y == 1, -z, z)) / bags.weight.sum())


class Loss:
    """The penalized loss of embeddings and softmax, and its gradient, over one vector of all parameters.

    The vector holds the embeddings (columns x ``DIMENSIONS``), the softmax weights (2 x ``DIMENSIONS``) and its two
    biases. A text's logits are linear in its average, so both passes go through one number an n-gram: forwards its
    embedding times the weights' difference, backwards the sum of the residuals.
    """

    def __init__(self, bags: Bags, penalty: float):
        self.bags, self.penalty = bags, penalty

    def start(self) -> np.ndarray:
        """Small embeddings, so that what is never moved adds no noise, and softmax weights that tell the classes apart."""
        rng = np.random.default_rng(0)
        E = 0.003 * rng.standard_normal((self.bags.columns, DIMENSIONS), np.float32)
        share = np.clip(self.bags.weight[self.bags.y == 1].sum() / self.bags.weight.sum(), 1e-6, 1 - 1e-6)
        b = 0.5 * np.log(share / (1 - share))
        return np.concatenate([E.ravel(), np.repeat([-0.5, 0.5], DIMENSIONS), [-b, b]]).astype(np.float32)

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.bags.columns * DIMENSIONS
        return theta[:at].reshape(-1, DIMENSIONS), theta[at : at + 2 * DIMENSIONS].reshape(2, DIMENSIONS), theta[at + 2 * DIMENSIONS :]

    def logit(self, theta: np.ndarray, bags: Bags | None = None) -> np.ndarray:
        E, W, b = self.parts(theta)
        return (bags or self.bags).times(E @ (W[1] - W[0])) + (b[1] - b[0])

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        bags, (E, W, b) = self.bags, self.parts(theta)
        z = self.logit(theta)
        r = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - bags.y) * bags.weight / bags.weight.sum()
        gram = bags.transposed(r).astype(np.float32)
        dE = gram[:, None] * (W[1] - W[0]) + self.penalty * E
        dW = np.outer([-1, 1], gram @ E) + self.penalty * W
        grad = np.concatenate([dE.ravel(), dW.ravel(), [-r.sum(), r.sum()]]).astype(np.float32)
        return _log_loss(z, bags) + self.penalty / 2 * float((E**2).sum() + (W**2).sum()), grad


def descend(loss: Loss, theta: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, list[float]]:
    """Full-batch descent along directions scaled by the last steps' curvature (limited-memory BFGS).

    A step is halved until the loss falls by a part of what the slope promises, so the loss falls from step to step
    whatever the number of texts and their order; where no step lowers it the descent is over. Returns the parameters
    and the losses.
    """
    value, grad = loss(theta)
    losses, past = [value], []
    for _ in range(steps):
        direction, held = -grad, []
        for s, g, rho in reversed(past):
            a = rho * float(s @ direction)
            direction = direction - a * g
            held.append(a)
        if past:
            s, g, rho = past[-1]
            direction *= 1 / (rho * float(g @ g))
        for (s, g, rho), a in zip(past, reversed(held), strict=True):
            direction += (a - rho * float(g @ direction)) * s
        slope = float(grad @ direction)
        if slope >= 0:
            past, direction, slope = [], -grad, -float(grad @ grad)
        size = 1.0 if past else min(1.0, 1 / (float(np.abs(grad).sum()) + 1e-12))
        for _ in range(30):
            there = theta + np.float32(size) * direction
            new, new_grad = loss(there)
            if np.isfinite(new) and new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, g = there - theta, new_grad - grad
        if float(s @ g) > 1e-12:
            past = [*past[1 - MEMORY :], (s, g, 1 / float(s @ g))]
        done = value - new < SETTLED * value and len(losses) > 10
        theta, value, grad = there, new, new_grad
        losses.append(value)
        if done:
            break
    return theta, losses


def _scaled(bags: Bags, scale: np.ndarray) -> Bags:
    return replace(bags, value=bags.value * scale[bags.column])


def fit(sample: list[tuple[str, int]]) -> SubwordModel:
    """Embeddings and softmax weights, trained jointly by full-batch descent on the mean log loss, classes weighed by their
    odds to the power ``ODDS``. An n-gram enters its texts' averages by the ``evidence`` that it tells the classes apart.

    The penalty is the one of ``PENALTIES`` with the least loss on a part of the sample that is then left out (one text
    in ``APART``, by its checksum), evidence included; all texts are fitted with it in the end. Where no penalty beats the
    classes' share on that part, the model is the share. With rows of one class only the score is that class's share;
    with none it is one half.
    """
    logits = np.zeros(BUCKETS, np.float32)
    y = np.array([label for _, label in sample], np.int64)
    if not len(y) or y.min() == y.max():
        return SubwordModel(logits, 0.0 if not len(y) else 8.0 * (2 * int(y[0]) - 1))
    apart = np.array([zlib.crc32(text.encode("utf-8", "replace")) for text, _ in sample]) % APART == 0
    seen = np.zeros((2, 2, BUCKETS), np.int32)  # texts of a part and a class with an n-gram
    for (text, label), out in zip(sample, apart, strict=True):
        seen[int(out), label, np.unique(subword_bag(text)[0])] += 1
    number = [[int((y[apart == out] == label).sum()) for label in (0, 1)] for out in (False, True)]
    best, weighed = None, float(np.log((y == 1).sum() / (y == 0).sum()))
    if min(*number[0], *number[1]):
        of_rest = evidence(seen[0, 1], seen[0, 0], number[0][1], number[0][0])
        of_all = evidence(seen[:, 1].sum(axis=0), seen[:, 0].sum(axis=0), number[0][1] + number[1][1], number[0][0] + number[1][0])
        known = (of_rest > 0) | (of_all > 0)
        bags = bags_of(sample, known)
        rest, judged = _scaled(bags, of_rest[known]).part(~apart), _scaled(bags, of_rest[known]).part(apart)
        least = _log_loss(np.full(len(judged.y), np.log(rest.weight[rest.y == 1].sum() / rest.weight[rest.y == 0].sum())), judged)
        for penalty in PENALTIES:
            loss = Loss(rest, penalty)
            theta, _ = descend(loss, loss.start())
            found = _log_loss(loss.logit(theta, judged), judged)
            if found < least:
                least, best = found, penalty
    if best is None:
        return SubwordModel(logits, weighed)
    loss = Loss(_scaled(bags, of_all[known]), best)

    E, W, b = loss.parts(descend(loss, loss.start())[0])
    logits[known] = of_all[known] * (E @ (W[1] - W[0]))
    model = SubwordModel(logits, float(b[1] - b[0]))
    if not (np.isfinite(model.logits).all() and np.isfinite(model.bias)):
        raise ValueError("the fitted model is not finite")
    return model


def _score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [model.value.score(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])


def scored(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``: the whole text's toxicity, 0 to 1.

    Only texts enter the score; empty and null ones get the model's bias, repeated rows equal scores, and an empty table
    gives no rows. Without any label the score is one half, with one class alone it is near that class. The model is fitted on the bounded sample of
    ``labelled.training_sample`` and sent to the tasks as one array of ``BUCKETS`` numbers.
    """
    model = documents.sparkSession.sparkContext.broadcast(fitted(training_sample(documents, labels, "toxic", SAMPLE_PER_CLASS), fit))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    out = rows.mapInArrow(partial(_score_batches, model=model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep_batches(batches: Iterator[pa.RecordBatch], model, threshold: float, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (t.as_py() or "" for t in batch.column(at))
        yield batch.filter(pa.array([not _WORD.search(t) or model.value.score(t) < threshold for t in texts], pa.bool_()))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``documents`` without the rows whose text scores ``threshold`` or more; one pass, all columns carried along.

    Each row is judged by its text alone: null, empty and wordless texts always stay, repeated rows fare alike, whatever
    their doc_id. An empty table stays empty; with no label at all nothing is dropped.
    """
    fitted_model = fitted(training_sample(documents, labels, "toxic", SAMPLE_PER_CLASS), fit)
    if fitted_model.bias == 0 and not fitted_model.logits.any():  # nothing learnt
        return documents
    model = documents.sparkSession.sparkContext.broadcast(fitted_model)
    return documents.mapInArrow(partial(_keep_batches, model=model, threshold=threshold, at=documents.columns.index("text")), documents.schema)
