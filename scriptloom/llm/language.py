"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import bounded_batches, byte_table, chunks, sums_by_row
from .training import bounded_sample, featurised, fold, ngram_buckets, ngram_counts, sampled_texts, sparse_rows

SIZES = (2, 3, 4)
BITS = 15
DIM = 16
EPOCHS = 8
BATCH = 32
RATE = 20.0
SEED = 5
#: Training rows of each language.
PER_LANGUAGE = 800
UNKNOWN = "und"

_ASCII_LETTER = byte_table([*range(65, 91), *range(97, 123)])
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """An embedding for each n-gram bucket, a softmax over languages, and its temperature."""

    languages: list[str]
    embedding: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    columns: np.ndarray = field(init=False)

    def settle(self) -> None:
        """Fold embedding and softmax into the logits of each bucket (zeros for no bucket), a row for each language."""
        table = np.vstack([self.embedding @ self.out, np.zeros(len(self.bias))]).astype(np.float32)
        self.columns = np.ascontiguousarray(table.T)

    def logits(self, means: np.ndarray) -> np.ndarray:
        return means + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, bytes]]) -> Model | None:
    """Fit by stochastic gradient descent; a tenth of the rows is kept back for the temperature."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    y = np.array([languages.index(r[0]) for r in rows])
    bounds, index, count = sparse_rows([r[1] for r in rows])
    share = count / np.repeat(np.maximum(sums_by_row(count, bounds), 1), np.diff(bounds))
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.1, (1 << BITS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    held = rng.random(len(y)) < 0.1
    keep = np.flatnonzero(~held)

    def shares(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that a batch's rows have, and each row's share of them as a small dense matrix."""
        sizes = bounds[batch + 1] - bounds[batch]
        at = np.repeat(bounds[batch] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        seen = np.zeros(1 << BITS, dtype=bool)
        seen[index[at]] = True
        dense = np.zeros((len(batch), np.count_nonzero(seen)))
        dense[np.repeat(np.arange(len(batch)), sizes), (np.cumsum(seen) - 1)[index[at]]] = share[at]
        return np.flatnonzero(seen), dense

    steps, total = 0, EPOCHS * -(-len(keep) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(keep)
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            buckets, x = shares(batch)
            h = x @ embedding[buckets]
            g = _softmax(h @ out + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            g /= len(batch)
            rate = RATE * (1 - steps / total)
            steps += 1
            gh = g @ out.T
            out -= 0.05 * rate * h.T @ g
            bias -= 0.01 * rate * g.sum(axis=0)
            embedding[buckets] -= rate * (x.T @ gh)
    model = Model(languages, embedding, out, bias)
    model.settle()
    if held.any():
        rest = np.flatnonzero(held)
        tries = [shares(rest[k : k + BATCH]) for k in range(0, len(rest), BATCH)]
        z = np.concatenate([x @ model.embedding[buckets] for buckets, x in tries]) @ out + bias
        own = y[rest]
        temperatures = np.geomspace(0.2, 20, 60)
        loss = [-np.log(_softmax(z / t)[np.arange(len(own)), own] + 1e-12).mean() for t in temperatures]
        model.temperature = float(temperatures[int(np.argmin(loss))])
    return model


def _has_letter(chunk) -> np.ndarray:
    """Whether each text of a chunk has a letter: ASCII ones at once, others only where none is found."""
    seen = sums_by_row(_ASCII_LETTER[chunk.data].astype(np.float32), chunk.offsets) > 0
    for i in np.flatnonzero(~seen):
        seen[i] = bool(_LETTER.search(chunk.row(i).decode(errors="replace")))
    return seen


def predict(chunk, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(language number, or -1 without letters; calibrated probability) for each text."""
    total = np.zeros((len(chunk), len(model.languages)))
    grams = np.zeros(len(chunk))
    for n in SIZES:
        buckets = ngram_buckets(chunk.data, chunk.offsets, n, BITS)
        for k, column in enumerate(model.columns):
            total[:, k] += sums_by_row(column[buckets], chunk.offsets)
        grams += np.maximum(np.diff(chunk.offsets) - n + 1, 0)
    odds = _softmax(model.logits(total / np.maximum(grams, 1)[:, None]) / model.temperature)
    best = odds.argmax(axis=1)
    score = odds[np.arange(len(chunk)), best]
    none = ~_has_letter(chunk)
    best[none], score[none] = -1, 0.0
    return best, score


def identify_language(
    docs: DataFrame,
    training: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    parts: int = 5,
    held_part: int = 0,
    per_language: int = PER_LANGUAGE,
    reject_below: float = 0.0,
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``.

    Learns from text and language of ``training`` (``docs`` itself if not given) outside the
    held-out fold (crc32 of the id modulo ``parts``), at most about ``per_language`` documents of
    each language by a hash of the id. score is the probability of lang_pred, calibrated by a
    temperature. ``und`` stands for texts that are null or have no letter (score 0), and for
    predictions with a score below ``reject_below``. Rows of ``training`` without a language
    teach nothing; if none is left every text is ``und``. Null ids are never trained from. Repeated
    rows are judged each; where rows of one id name several languages, each of its texts teaches all of them. An
    empty table gives an empty result; other columns are ignored.
    """
    training = docs if training is None else training
    pool = training.select(F.col(id_col).alias("id"), F.col(lang_col).alias("y")).where(fold("id", parts) != held_part)
    sample = bounded_sample(pool, per_language)
    texts = sampled_texts(training, sample, id_col, text_col)
    model = train(featurised(texts, lambda c: ngram_counts(c, SIZES, BITS)))
    if model:
        model.embedding = model.embedding[:0]  # the folded table is all that a prediction needs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            for chunk in chunks(batch.column(1)) if model else ():
                rows = slice(chunk.first, chunk.first + len(chunk))
                best[rows], score[rows] = predict(chunk, model)
            best[score < reject_below] = -1
            names = pa.array([*(model.languages if model else []), UNKNOWN], pa.string())
            lang = pc.take(names, pa.array(np.where(best < 0, len(names) - 1, best)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = bounded_batches(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(one, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (fold("doc_id", parts) == held_part).alias("held_out"), "lang_pred", "score")
