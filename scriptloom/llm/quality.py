"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textbatch import bounded_batches, chunks
from .training import PER_CLASS, bounded_sample, featurised, fold, sampled_texts, sigmoid

#: Bytes of a passage; a text is cut into passages of this size, the last is shorter.
PASSAGE = 600
HIDDEN = 24
EPOCHS = 40
BATCH = 64
RATE = 0.01
SEED = 11


def _byte_kinds() -> np.ndarray:
    """Kinds of bytes: lower, upper, digit, blank, line end, sentence marks, quotes and dashes,
    brackets, each of five groups of symbols, control, and bytes of other characters."""
    kinds = np.full(256, 13, dtype=np.int64)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".,;:?", "'\"-_",
              "()[]{}<>", "!", "#*", "$%&@", "|\\/", "+=~^`"]
    for k, group in enumerate(groups):
        kinds[[ord(c) for c in group]] = k
    kinds[128:] = 14
    return kinds


_KINDS = _byte_kinds()
_N = 15
#: Shares of adjacent pairs of kinds, and the shares of words equal to the word before and of bytes equal to the byte 1 to 3 before.
WIDTH = _N * _N + 4


def passages(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of a chunk's whole texts, and where each row's passages begin."""
    data, offsets = chunk.data, chunk.offsets
    count = np.maximum(1, -(-np.diff(offsets) // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    owner = np.repeat(np.arange(len(chunk)), count)
    start = offsets[owner] + (np.arange(n) - first[owner]) * PASSAGE
    size = np.minimum(PASSAGE, offsets[owner + 1] - start)
    x = np.zeros((n, WIDTH), dtype=np.float32)
    if len(data):
        at = np.repeat(np.arange(n), size)
        kind = _KINDS[data]
        pair = at[1:] * (_N * _N) + kind[:-1] * _N + kind[1:]
        pair = pair[at[1:] == at[:-1]]
        x[:, : _N * _N] = np.bincount(pair, minlength=n * _N * _N).reshape(n, -1)
        for j in (1, 2, 3):
            same = (data[j:] == data[:-j]) & (at[j:] == at[:-j])
            x[:, _N * _N + j] = np.bincount(at[j:][same], minlength=n)
        # words like the word before, by length and sum of their bytes
        ends = np.flatnonzero(((data == 32) | (data == 10)) & np.r_[True, at[1:] == at[:-1]])
        if len(ends) > 2:
            plain = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
            size_w, sum_w = np.diff(ends), plain[ends[1:]] - plain[ends[:-1]]
            same = (size_w[1:] == size_w[:-1]) & (sum_w[1:] == sum_w[:-1]) & (at[ends[2:]] == at[ends[:-2]])
            x[:, _N * _N] = np.bincount(at[ends[2:]][same], minlength=n) * 5.0
    x /= np.maximum(size, 1)[:, None]
    return np.sqrt(x), first


def bag(chunk) -> list[bytes]:
    x, first = passages(chunk)
    return [x[first[i] : first[i + 1]].tobytes() for i in range(len(chunk))]


@dataclass
class Model:
    """h = tanh(x W); attention logits ((tanh(h V) * sigmoid(h U)) a); document logit (sum w h) c + d."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        h = np.tanh((x - p["centre"]) / p["spread"] @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        most = np.maximum.reduceat(e, first[:-1])
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        w = np.exp(e - most[own])
        w /= np.add.reduceat(w, first[:-1])[own]
        z = np.add.reduceat(w[:, None] * h, first[:-1])
        return {"h": h, "t": t, "s": s, "w": w, "own": own, "z": z, "logit": z @ p["c"] + p["d"]}

    def gradient(self, x: np.ndarray, f: dict, g: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of sum(loss) given d loss / d logit."""
        p, own, w, h = self.p, f["own"], f["w"], f["h"]
        gz = g[:, None] * p["c"]
        gw = (gz[own] * h).sum(axis=1)
        mean = np.bincount(own, gw * w, minlength=len(g))
        ge = w * (gw - mean[own])
        gt, gs = ge[:, None] * f["s"] * p["a"], ge[:, None] * f["t"] * p["a"]
        gt *= 1 - f["t"] ** 2
        gs *= f["s"] * (1 - f["s"])
        gh = w[:, None] * gz[own] + gt @ p["v"].T + gs @ p["u"].T
        gx = gh * (1 - h**2)
        out = {"c": f["z"].T @ g, "d": g.sum(), "a": (f["t"] * f["s"]).T @ ge, "v": h.T @ gt, "u": h.T @ gs, "b": gx.sum(axis=0)}
        return out | {"w": ((x - p["centre"]) / p["spread"]).T @ gx}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(x, first)["logit"])


def train(rows: list[tuple[int, bytes]]) -> Model:
    """Fit gated attention from (0 or 1, passages of a document) with Adam and the logistic loss.

    With one class only, or none, every score is that class's share (0.5 without rows).
    """
    rng = np.random.default_rng(SEED)
    y = np.array([r[0] for r in rows], dtype=np.float64)
    bags = [np.frombuffer(r[1], dtype=np.float32).reshape(-1, WIDTH) for r in rows]
    p = {
        "centre": np.zeros(WIDTH), "spread": np.ones(WIDTH), "b": np.zeros(HIDDEN), "c": np.zeros(HIDDEN), "a": rng.normal(0, 0.3, HIDDEN),
        "w": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "v": rng.normal(0, 0.3, (HIDDEN, HIDDEN)), "u": rng.normal(0, 0.3, (HIDDEN, HIDDEN)),
        "d": np.float64(0),
    }
    model = Model(p)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
        p["d"] = np.log(share / (1 - share))
        return model
    every = np.concatenate(bags)
    p["centre"], p["spread"] = every.mean(axis=0), every.std(axis=0) + 0.05
    p["c"] = rng.normal(0, 0.3, HIDDEN)
    # the classes of the sample weigh as much as each other; the score is for even odds
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    learned = ["w", "b", "v", "u", "a", "c", "d"]
    m, v = ({k: np.zeros_like(p[k]) for k in learned} for _ in range(2))
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            batch = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in batch]).astype(np.float64)
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in batch])])
            f = model.forward(x, first)
            g = model.gradient(x, f, weight[batch] * (sigmoid(f["logit"]) - y[batch]) / len(batch))
            t += 1
            for k in learned:
                grad = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                rate = RATE / (1 + 0.05 * epoch)
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, parts: int, held_part: int, per_class: int) -> Model:
    learn = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    learn = learn.where(fold("id", parts) != held_part).groupBy("id").agg(F.min("y").alias("y"))
    model = train(featurised(sampled_texts(docs, bounded_sample(learn, per_class), id_col, text_col), bag))
    return Model({k: np.asarray(x, dtype=np.float32) for k, x in model.p.items()})


def _scored(docs: DataFrame, text_col: str, model: Model, name: str) -> DataFrame:
    """All columns of ``docs`` and the score of each row's text, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.score(*passages(c)) for c in chunks(batch.column(at))]
            out = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, name])

    return bounded_batches(docs).mapInArrow(one, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    parts: int = 3,
    held_part: int = 1,
    per_class: int = PER_CLASS,
) -> DataFrame:
    """``(doc_id, held_out, score)``, one row per row of ``docs``; a higher score is better quality.

    A whole text is a bag of passages of 600 bytes, each encoded by the shares of adjacent pairs of
    character kinds and of repeats; document labels teach how to encode, attend and judge. At most
    about ``per_class`` labelled documents of each class train it, by a hash of the id, none from
    the held-out fold (crc32 of the id modulo ``parts``). Null and empty texts are one empty
    passage. Null ids aren't held out (held_out is null). Labels other than 0 and 1 are ignored;
    of contradicting labels of an id 0 counts. Without both classes the score is a constant.
    Repeated rows are scored each; a repeated id teaches with each of its texts. An empty table gives an
    empty result; other columns are ignored.
    """
    model = _learn(docs, labels, id_col, text_col, label_col, parts, held_part, per_class)
    scored = _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", model, "score")
    return scored.select("doc_id", (fold("doc_id", parts) == held_part).alias("held_out"), "score")


def good_documents(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    parts: int = 3,
    held_part: int = 1,
    per_class: int = PER_CLASS,
) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, judged where they are read: no join.

    See ``score_quality`` for the score and its cases.
    """
    model = _learn(docs, labels, id_col, text_col, label_col, parts, held_part, per_class)
    return _scored(docs, text_col, model, "__score").where(F.col("__score") >= threshold).drop("__score")
