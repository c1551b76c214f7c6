"""Toxicity by non-negative positive-unlabelled learning over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import bounded_batches, chunks, sums_by_row
from .training import (
    PER_CLASS,
    bounded_sample,
    bucket_counts,
    featurised,
    fold,
    ngram_buckets,
    ngram_counts,
    sampled_texts,
    sigmoid,
    sparse_rows,
)

SIZES = (4, 5, 6)
BITS = 18
#: An n-gram is a feature if so many positives have it, and if its share among them stands so many
#: standard errors above its share among the negatives.
LEAST_POSITIVES = 3
LEAST_Z = 5.0
EPOCHS = 10
BATCHES = 8
RATE = 0.02
FOLDS = 4
SEED = 7


@dataclass
class Model:
    """Weights by n-gram bucket (one more, zero, for none); probabilities ``odds`` at raw scores ``knots``."""

    weights: np.ndarray
    bias: float
    length: float = 0.0
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(1))


def _risk_slopes(z: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """d risk / d z of the non-negative PU risk with the logistic loss.

    risk = prior * mean_P loss(+z) + max(0, mean_U loss(-z) - prior * mean_P loss(-z)). Where the
    estimate of the negatives' risk is below zero, the model has overfitted: step back up it.
    """
    p, u = positive, ~positive
    np_, nu = max(1, p.sum()), max(1, u.sum())
    soft = np.logaddexp(0, z)  # loss(-z)
    negative = soft[u].sum() / nu - prior * soft[p].sum() / np_
    s = sigmoid(z)
    d_negative = np.where(u, s / nu, -prior * s / np_)
    if negative < 0:
        return -d_negative
    return np.where(p, -prior * (1 - s) / np_, 0.0) + d_negative


def _z(buckets: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Standard errors between an n-gram's share among positives and that among negatives."""
    _, in_p, in_u = buckets.T
    p, q = in_p / n_p, in_u / n_u
    n = np.maximum(0, (q - prior * p) / (1 - prior))
    pooled = (in_p + in_u + 1) / (n_p + n_u + 1)
    return (p - n) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / n_p + 1 / n_u))


def _evidence(buckets: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """The log ratio of each n-gram's document shares, class-prior corrected; 0 for one that is no feature.

    buckets: rows (bucket, positives with it, unlabelled texts with it). Among unlabelled texts a
    share q mixes positives and negatives, q = prior * p + (1 - prior) * n, so the negatives'
    share is n = max(0, (q - prior * p) / (1 - prior)).
    """
    at, in_p, in_u = buckets.T
    p, q = in_p / n_p, in_u / n_u
    n = np.maximum(0, (q - prior * p) / (1 - prior))
    chosen = (_z(buckets, n_p, n_u, prior) > LEAST_Z) & (in_p >= LEAST_POSITIVES)
    floor = 0.5 / n_u
    out = np.zeros((1 << BITS) + 1)
    out[at[chosen]] = np.log((p[chosen] + floor) / (n[chosen] + floor))
    return out


def _affine(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the log-odds from a raw score.

    Lessens -prior * mean_P(z) + mean_U(log(1 + exp z)), the PU risk with the logistic loss, which
    is convex in both, by damped Newton steps with a small pull towards a slope of 1.
    """
    p, u = x[y], x[~y]
    a, b = 1.0, float(np.log(prior / (1 - prior)) - np.median(u))
    pull = 1e-3
    for _ in range(100):
        s = sigmoid(a * u + b)
        g = np.array([-prior * p.mean() + (s * u).mean() + pull * (a - 1), s.mean() - prior])
        h = s * (1 - s)
        hess = np.array([[(h * u * u).mean() + pull, (h * u).mean()], [(h * u).mean(), h.mean()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, g), -2.0, 2.0)
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _posterior(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising probabilities prior * f_P(z) / f_U(z), from the shares of positives and unlabelled rows.

    Pools adjacent violators over rows sorted by score, where a positive weighs prior / n_P and an
    unlabelled row 1 / n_U; even within a pool, linear from one to the next.
    """
    order = np.argsort(z, kind="stable")
    # No prior is above U(> t) / P(> t) at any t. Where the least of these lies a little above the
    # labels' share, the sample of unlabelled rows has so many more positives.
    above_p, above_u = (np.cumsum(c[order][::-1]) / c.sum() for c in (y, ~y))
    bound = (above_u[above_p > 0.5] / above_p[above_p > 0.5]).min()
    prior = min(max(prior, bound), 1.3 * prior)
    pools: list[tuple] = []  # positives' mass, unlabelled mass, least and most score
    for at, positive in zip(z[order].tolist(), y[order].tolist(), strict=True):
        pools.append((prior / y.sum(), 0.0, at, at) if positive else (0.0, 1.0 / (~y).sum(), at, at))
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            (p, u, _, most), (p0, u0, least, _) = pools.pop(), pools.pop()
            pools.append((p0 + p, u0 + u, least, most))
    knots = np.array([at for p in pools for at in p[2:]])
    odds = np.array([min(1.0, p[0] / p[1]) if p[1] else 1.0 for p in pools])
    return knots, np.clip(np.repeat(odds, 2), 1e-3, 1 - 1e-3)


def _fit(bounds: np.ndarray, index: np.ndarray, x: np.ndarray, root: np.ndarray, y: np.ndarray, prior: float, start: np.ndarray) -> Model:
    """Weights from the evidence ``start``, then AdaGrad over mini-batches of the non-negative PU risk."""
    width = (1 << BITS) + 1
    rng = np.random.default_rng(SEED)
    weights = start.copy()
    owner = np.repeat(np.arange(len(y)), np.diff(bounds))
    slope, bias = _affine(np.bincount(owner, weights[index] * x, minlength=len(y)), y, prior)
    weights *= slope
    length, start, size = 0.0, weights.copy(), np.abs(weights).max(initial=1e-9)
    grown, grown_rest = np.full(width, 1e-12), np.full(2, 1e-12)
    groups = [np.flatnonzero(y), np.flatnonzero(~y)]
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.2 * epoch)
        deals = [np.array_split(rng.permutation(g), BATCHES) for g in groups]
        for k in range(BATCHES):
            batch = np.concatenate([d[k] for d in deals])
            counts = bounds[batch + 1] - bounds[batch]
            at = np.repeat(bounds[batch] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            own = np.repeat(np.arange(len(batch)), counts)
            z = bias + length * root[batch] + np.bincount(own, weights[index[at]] * x[at], minlength=len(batch))
            slopes = _risk_slopes(z, y[batch], prior)
            g = np.bincount(index[at], x[at] * slopes[own], minlength=width)
            grown += g * g
            weights -= rate * (size * g / np.sqrt(grown) + 0.1 * (weights - start))
            rest = np.array([slopes.sum(), (slopes * root[batch]).sum()])
            grown_rest += rest * rest
            bias, length = np.array([bias, length]) - rate * rest / np.sqrt(grown_rest)
    return Model(weights, float(bias), float(length))


def _raw(model: Model, bounds: np.ndarray, index: np.ndarray, x: np.ndarray, root: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(root)), np.diff(bounds))
    return model.bias + model.length * root + np.bincount(owner, model.weights[index] * x, minlength=len(root))


def _level(model: Model, data: tuple, y: np.ndarray) -> np.ndarray:
    """Scale a model so that unlabelled rows have median 0 and spread 1, and return all rows' scores."""
    z = _raw(model, *data)
    centre = np.median(z[~y])
    spread = 1.48 * np.median(np.abs(z[~y] - centre)) + 1e-9
    model.weights /= spread
    model.length /= spread
    model.bias = (model.bias - centre) / spread
    return (z - centre) / spread


def train(rows: list[tuple[int, bytes]], buckets: np.ndarray, prior: float) -> Model:
    """Fit from (1 for confirmed toxic or 0 for unlabelled, features) and bucket counts by class.

    Features are counts of the chosen n-grams over the root of the text's length, and that root.
    The map to probabilities is fitted to scores of rows by models that were trained without them: each
    fold's evidence is the whole sample's less its own rows'.
    Without enough positives or unlabelled rows the score is the prior everywhere.
    """
    y = np.array([r[0] for r in rows], dtype=bool)
    if y.sum() < FOLDS or (~y).sum() < FOLDS or not len(buckets):
        return Model(np.zeros((1 << BITS) + 1), 0.0, odds=np.full(1, prior))
    data = rows_of([r[1] for r in rows])
    part = np.zeros(len(y), dtype=int)
    for c in (False, True):
        part[y == c] = np.random.default_rng(SEED).permutation((y == c).sum()) % FOLDS
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        away = part == k
        less = buckets.copy()
        for column, c in ((1, True), (2, False)):
            own = np.bincount(_rows(data, away & (y == c))[1], minlength=(1 << BITS) + 1)
            less[:, column] -= own[less[:, 0]]
        start = _evidence(less, int((y & ~away).sum()), int((~y & ~away).sum()), prior)
        unseen[away] = _level(_fit(*_rows(data, ~away), y[~away], prior, start), data, y)[away]
    model = _fit(*data, y, prior, _evidence(buckets, int(y.sum()), int((~y).sum()), prior))
    _level(model, data, y)
    model.knots, model.odds = _posterior(unseen, y, prior)
    return model


def _rows(data: tuple, keep: np.ndarray) -> tuple:
    """The rows of ``rows_of`` where ``keep`` is true."""
    bounds, index, x, root = data
    sizes = np.diff(bounds)
    inside = np.repeat(keep, sizes)
    return np.concatenate([[0], np.cumsum(sizes[keep])]), index[inside], x[inside], root[keep]


def rows_of(features: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, buckets, counts over the root of the length, that root) of featurised rows.

    Each row's last pair is no feature but its length.
    """
    bounds, index, count = sparse_rows(features)
    root = np.sqrt(np.maximum(count[bounds[1:] - 1], 1.0))
    plain = np.ones(len(index), dtype=bool)
    plain[bounds[1:] - 1] = False
    bounds = bounds - np.arange(len(bounds))
    return bounds, index[plain], count[plain] / np.repeat(root, np.diff(bounds)), root / 100.0


def scores(chunk, model: Model) -> np.ndarray:
    """Scores of a chunk's whole texts."""
    total = np.zeros(len(chunk))
    lengths = np.diff(chunk.offsets)
    grams = np.zeros(len(chunk))
    for n in SIZES:
        total += sums_by_row(model.weights[ngram_buckets(chunk.data, chunk.offsets, n, BITS)], chunk.offsets)
        grams += np.maximum(lengths - n + 1, 0)
    root = np.sqrt(np.maximum(grams, 1.0))
    z = model.bias + model.length * root / 100.0 + total / root
    return np.interp(z, model.knots, model.odds)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    parts: int = 3,
    held_part: int = 1,
    per_class: int = PER_CLASS,
) -> DataFrame:
    """``(doc_id, held_out, score)``, one row per row of ``docs``; score is the odds of being toxic.

    Positives are the documents labelled 1, unlabelled text is any document whatever its label,
    both outside the held-out fold (crc32 of the id modulo ``parts``) and at most about
    ``per_class`` of each, by a hash of the id. The class prior is the share of 1 among all labels outside that fold.
    Features are hashed byte n-grams of whole texts. Null and empty texts get the score of a text
    without n-grams. A null id is not held out (held_out is null) and never trained from.
    Labels other than 0 and 1 are ignored, and of contradicting labels of an id 1 counts. Without
    positives every score is one small constant. Repeated rows are scored each; a repeated id teaches with
    each of its texts. An empty table gives an empty result; other columns are ignored.
    """
    learn = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("y in (0, 1)")
    learn = learn.where(fold("id", parts) != held_part).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n, positives = learn.agg(F.count("*"), F.sum("y")).first()
    prior = min(max((positives or 0) / n if n else 0.0, 1e-3), 0.9)
    ids = docs.select(F.col(id_col).alias("id")).where(fold("id", parts) != held_part)
    pool = ids.select("id", F.lit(0).alias("y")).union(learn.where("y = 1"))
    texts = sampled_texts(docs, bounded_sample(pool, per_class), id_col, text_col)
    buckets = bucket_counts(texts, SIZES, BITS, LEAST_POSITIVES)
    chosen = np.zeros(1 << BITS, dtype=bool)
    if len(buckets):
        n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
        # a feature of any fold is among the n-grams that pass a weaker test on the whole sample
        buckets = buckets[_z(buckets, n.get(1, 1), n.get(0, 1), prior) > LEAST_Z / 2]
        chosen[buckets[:, 0]] = True
    model = train(featurised(texts, lambda c: ngram_counts(c, SIZES, BITS, chosen)), buckets, prior)
    model.weights = model.weights.astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scores(c, sent.value) for c in chunks(batch.column(1))]
            out = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = bounded_batches(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(one, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", parts) == held_part).alias("held_out"), "score")
