"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fitted, held_out, training_sample

OWN = 14
FEATURES = 3 * OWN + 3
#: Labelled texts for fitting, at most, of bad and of good quality.
SAMPLE_PER_CLASS = (1500, 1500)
STEPS = 120
ROUNDS = 3
LINES_AT_ONCE = 200_000


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every line, each line's own and both neighbours', and the lines' lengths; an empty text is
    one empty line."""
    lines = text.split("\n")
    own = np.empty((len(lines), OWN), np.float32)
    seen: set[str] = set()
    lengths = np.empty(len(lines), np.int64)
    for i, line in enumerate(lines):
        words = line.split()
        n, c = len(words), len(line)
        lengths[i] = c
        one = max(n, 1)
        letters = sum(map(str.isalpha, words)) / one
        distinct = len(set(words)) / one if n else 1.0
        plain = line.replace(" ", "")
        chars = max(len(plain), 1)
        own[i] = (
            np.log1p(c) / 8,
            letters,
            distinct if n > 3 else 1.0,
            float(n > 3 and distinct < 0.5),
            sum(map(str.isupper, words)) / one,
            (plain.count("!") + plain.count("?")) / chars,
            (line.count("|") + line.count("\t")) / one,
            sum(plain.count(x) for x in "#$%&*~^@=+<>{}[]\\_") / chars,
            sum(map(str.isdigit, words)) / one,
            min(chars / one, 20) / 20,
            float(line in seen and c > 0),
            float(n == 0),
            float(n > 0 and line.rstrip()[-1:] in ".!?"),
            (line.count(".") + line.count(",")) / one,
        )
        seen.add(line)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(lines), 3), np.float32)
    edge[0, 0] = edge[-1, 1] = edge[:, 2] = 1
    return np.concatenate((own, before, after, edge), axis=1), lengths


@dataclass
class Chain:
    """Weights of the field (state 1: a good line), and of the logistic curve from documents' marginals to a score."""

    emit: np.ndarray
    move: np.ndarray
    slope: float = 4.0
    shift: float = 0.0

    def passes(self, docs: list[np.ndarray]) -> tuple:
        """Forward-backward over many documents at once: the k-th lines of all that have so many go side by side.

        Log odds from the lines before, from the line itself and from those after; where the documents start, how long
        they are, and in which order they lie.
        """
        order = sorted(range(len(docs)), key=lambda d: -len(docs[d]))
        sizes = np.array([len(docs[d]) for d in order])
        longest = int(sizes[0]) if len(sizes) else 0
        starts = np.cumsum(np.r_[0, sizes])[:-1]
        z = (np.concatenate([docs[d] for d in order]) @ self.emit) if len(docs) else np.zeros(0)
        up, down = np.zeros(len(z)), np.zeros(len(z))  # log odds of good from the lines before, and from those after
        live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents with over k lines
        odds = lambda a: np.logaddexp(self.move[0, 1], a + self.move[1, 1]) - np.logaddexp(self.move[0, 0], a + self.move[1, 0])
        back = lambda a: np.logaddexp(self.move[1, 0], a + self.move[1, 1]) - np.logaddexp(self.move[0, 0], a + self.move[0, 1])
        for k in range(1, longest):
            at = starts[: live[k]] + k
            up[at] = odds(up[at - 1] + z[at - 1])
        for k in range(longest - 2, -1, -1):
            at = starts[: live[k + 1]] + k
            down[at] = back(down[at + 1] + z[at + 1])
        return up, z, down, starts, sizes, order

    def marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        return _split(*self.passes(docs))

    def score(self, marginals: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        raw = goodness(marginals, lengths)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


def _split(up, z, down, starts, sizes, order) -> list[np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(up + z + down, -40, 40)))
    out: list[np.ndarray] = [np.empty(0)] * len(order)
    for place, d in enumerate(order):
        out[d] = p[starts[place] : starts[place] + sizes[place]]
    return out


def goodness(marginals: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
    """The log odds of the length-weighted mean of the lines' marginals."""
    mean = np.array([np.average(m, weights=n + 1) for m, n in zip(marginals, lengths, strict=True)])
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def _fit_chain(X: list[np.ndarray], y: list[np.ndarray], weight: np.ndarray, chain: Chain) -> Chain:
    """Adam on the conditional log likelihood; the gradient is observed less expected counts, by forward-backward."""
    flat = np.concatenate(X).astype(np.float64)
    params = np.concatenate((chain.emit, chain.move.reshape(-1)))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        now = Chain(params[:FEATURES], params[FEATURES:].reshape(2, 2))
        up, z, down, starts, sizes, order = now.passes(X)
        marg = _split(up, z, down, starts, sizes, order)
        per_line = np.concatenate([np.full(len(x), w) for x, w in zip(X, weight, strict=True)])
        total = max(per_line.sum(), 1e-9)
        g = np.zeros_like(params)
        g[:FEATURES] = flat.T @ (per_line * (np.concatenate(y) - np.concatenate(marg))) / total
        first = np.concatenate([s + np.arange(n - 1) for s, n in zip(starts, sizes, strict=True)]).astype(np.int64)
        if len(first):
            labels = np.concatenate([y[d] for d in order])
            lines = np.repeat(weight[order], sizes)
            a, c = up[first] + z[first], z[first + 1] + down[first + 1]
            logs = np.stack([now.move[0, 0] + 0 * a, now.move[0, 1] + c, now.move[1, 0] + a, now.move[1, 1] + a + c])
            pair = np.exp(logs - logs.max(axis=0))
            pair /= pair.sum(axis=0)
            seen = np.stack([(1 - labels[first]) * (1 - labels[first + 1]), (1 - labels[first]) * labels[first + 1], labels[first] * (1 - labels[first + 1]), labels[first] * labels[first + 1]])
            g[FEATURES:] = ((seen - pair) * lines[first]).sum(axis=1) / total
        g -= 1e-4 * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(params[:FEATURES], params[FEATURES:].reshape(2, 2))


def fit(sample: list[tuple[str, int]]) -> Chain:
    """Fit on documents with known quality whose lines' labels are not known.

    Lines of good documents are good. Lines of bad ones begin as bad; after each round those that the field itself finds
    good become good, but for the worst line of the document, and the field is fitted again. Last, a logistic curve is
    fitted from the documents' aggregated marginals to their labels. With one class only, scores are that class's.
    """
    labels = np.array([q for _, q in sample], np.int64)
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    if not len(labels) or labels.min() == labels.max():
        chain.slope, chain.shift = 0.0, 0.0 if not len(labels) else 8.0 * (2 * int(labels[0]) - 1)
        return chain
    feats = [line_features(t) for t, _ in sample]
    X, lengths = [f[0] for f in feats], [f[1] for f in feats]
    y = [np.full(len(x), float(q)) for x, q in zip(X, labels, strict=True)]
    share = (len(labels) / (2 * np.bincount(labels, minlength=2)))[labels]
    weight = share / np.array([len(x) for x in X])  # documents count alike, however many lines they have
    for _ in range(ROUNDS):
        chain = _fit_chain(X, y, weight, chain)
        for d, p in enumerate(chain.marginals(X)):
            if not labels[d]:
                y[d] = (p > 0.5).astype(float)
                y[d][np.argmin(p)] = 0.0
    raw = goodness(chain.marginals(X), lengths)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number, with a weak prior
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([(raw * (labels - p)).sum() - 0.01 * a, (labels - p).sum() - 0.01 * b])
        h = np.array([[(w * raw * raw).sum() + 0.01, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    chain.slope, chain.shift = float(a), float(b)
    return chain


def _score_batches(batches: Iterator[pa.RecordBatch], chain) -> Iterator[pa.RecordBatch]:
    model = chain.value

    def done(ids: list, held: list, docs: list, lengths: list) -> pa.RecordBatch:
        scores = model.score(model.marginals(docs), lengths)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    for batch in batches:
        ids, held, docs, lengths, lines = [], [], [], [], 0
        for doc, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            x, n = line_features(text.as_py() or "")
            ids.append(doc)
            held.append(h)
            docs.append(x)
            lengths.append(n)
            lines += len(x)
            if lines >= LINES_AT_ONCE:
                yield done(ids, held, docs, lengths)
                ids, held, docs, lengths, lines = [], [], [], [], 0
        if ids:
            yield done(ids, held, docs, lengths)


def scored(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``: the chance that its quality is good.

    Every line of the whole text counts, by its length. Only texts enter the score; a null text counts as empty, repeated
    rows have equal scores and a row each, whatever their doc_id, and an empty table gives no rows. Without any label the
    score is one half, with one class alone it is near that class; columns beside doc_id and text are not read. The field is fitted on the bounded sample of ``labelled.training_sample`` and is a few dozen numbers.
    """
    sent = documents.sparkSession.sparkContext.broadcast(fitted(training_sample(documents, labels, "quality", SAMPLE_PER_CLASS), fit))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    out = rows.mapInArrow(partial(_score_batches, chain=sent), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
