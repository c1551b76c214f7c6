"""Bounded training samples: labelled ids, joined with their whole texts, featurised by tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import durable
from .textbatch import ASCII_LOWER, bounded_batches, chunks

#: Rows of each class that a model is trained from, and bytes of their texts in all, at most.
PER_CLASS = 2000
SAMPLE_BYTES = 64 << 20


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def _rank(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1 << 40))


def bounded_sample(rows: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(id, y)`` -> at most about ``per_class`` rows of each y, by a hash of the id.

    Classes are counted over all rows; a class of n rows keeps those whose hash is below
    per_class / n. The result is cut at ``per_class`` times the number of classes, so it is safe
    to broadcast. Rows with a null id or y are left out. Repeated rows are kept once; only their
    counts see all of them. The hash is applied before anything is shuffled.
    """
    rows = rows.where("id is not null and y is not null")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == F.lit(y), F.lit(min(1.0, per_class / n))).otherwise(share)
    kept = rows.where(_rank("id") < share * float(1 << 40)).distinct()
    return kept.orderBy(_rank("id"), "id", "y").limit(int(1.1 * per_class) * len(counts))


Features = Callable[[object], list[bytes]]


def sampled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(id, y, text)``: whole texts of the sampled documents, as a written table.

    At most about ``most_bytes`` of text are taken, in the order of the ids' hash; a text that would
    go beyond that is left out of the sample, never cut.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = durable(texts.join(F.broadcast(sample), "id").select("id", "y", "text"), "sample")
    sizes = rows.select("id", _rank("id").alias("r"), F.octet_length("text").alias("n"))
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= most_bytes:
        return rows
    taken, used = [], 0
    for r in sizes.groupBy("id", "r").agg(F.sum("n").alias("n")).orderBy("r", "id").toLocalIterator():  # the sample's ids only
        if used + r["n"] <= most_bytes:
            taken.append((r["id"],))
            used += r["n"]
    kept = docs.sparkSession.createDataFrame(taken, f"id {rows.schema['id'].dataType.simpleString()}")
    return rows.join(F.broadcast(kept), "id", "left_semi")


def featurised(rows: DataFrame, features: Features) -> list[tuple]:
    """``(y, feature bytes)`` of sampled texts, in the order of id, y and features.

    Tasks compute ``features(chunk)`` (bytes for each of its rows) from whole texts; only the
    sample's features reach the driver.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for chunk in chunks(batch.column(2)) for x in features(chunk)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "y", "f"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = bounded_batches(rows).mapInArrow(one, f"id {kind['id']}, y {kind['y']}, f binary").toArrow()
    found = found.sort_by([("id", "ascending"), ("y", "ascending"), ("f", "ascending")])
    return list(zip(found["y"].to_pylist(), found["f"].to_pylist(), strict=True))


def bucket_counts(rows: DataFrame, sizes: tuple[int, ...], bits: int, least: int) -> np.ndarray:
    """Rows (bucket, n with y = 1, n with y = 0) of n-gram buckets that ``least`` texts with y = 1 have."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            y = np.asarray(batch.column(1))
            for chunk in chunks(batch.column(2)):
                buckets = [ngram_buckets(chunk.data, chunk.offsets, n, bits) for n in sizes]
                for i in range(len(chunk)):
                    own = np.unique(np.concatenate([b[chunk.offsets[i] : chunk.offsets[i + 1]] for b in buckets]))
                    totals[int(y[chunk.first + i]), own[own < 1 << bits]] += 1
        at = np.flatnonzero(totals.any(axis=0))
        columns = [pa.array(at), pa.array(totals[1, at]), pa.array(totals[0, at])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "p", "u"])

    each = bounded_batches(rows.select("id", "y", "text")).mapInArrow(one, "bucket bigint, p bigint, u bigint")
    total = each.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= least)
    found = total.toArrow().sort_by("bucket")
    return np.stack([np.asarray(found[c], dtype=np.int64) for c in ("bucket", "p", "u")], axis=1)


#: Bytes as n-grams see them: A-Z in lower case, other ASCII characters than letters as blanks.
_LETTERS = ASCII_LOWER.copy()
_LETTERS[[b for b in range(128) if not 97 <= ASCII_LOWER[b] <= 122]] = 32


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the byte n-gram at each position; ``1 << bits`` where it would leave its row."""
    size = len(data)
    seen = _LETTERS[data].astype(np.uint64)
    key = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        key[: size - j or None] |= seen[j:] << np.uint64(8 * j)
    key = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    out = ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int32)
    for j in range(1, n):
        at = offsets[1:] - j
        out[at[at >= offsets[:-1]]] = 1 << bits
    return out


def ngram_counts(chunk, sizes: tuple[int, ...], bits: int, chosen: np.ndarray | None = None) -> list[bytes]:
    """For each row, its n-gram buckets (int32) and how often each occurs (float32), as bytes.

    chosen: keep these buckets only; a last pair then holds ``1 << bits`` and the count of all.
    """
    buckets = [ngram_buckets(chunk.data, chunk.offsets, n, bits) for n in sizes]
    out = []
    for i in range(len(chunk)):
        own = np.concatenate([b[chunk.offsets[i] : chunk.offsets[i + 1]] for b in buckets])
        own = own[own < 1 << bits]
        total = len(own)
        if chosen is not None:
            own = own[chosen[own]]
        found, counts = np.unique(own, return_counts=True)
        if chosen is not None:
            found, counts = np.append(found, 1 << bits), np.append(counts, total)
        out.append(found.astype(np.int32).tobytes() + counts.astype(np.float32).tobytes())
    return out


def sparse_rows(features: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of rows, buckets, counts) of what ``ngram_counts`` made."""
    half = [len(f) // 2 for f in features]
    bounds = np.concatenate([[0], np.cumsum(half)]).astype(np.int64) // 4
    index = np.concatenate([np.frombuffer(f[:h], np.int32) for f, h in zip(features, half, strict=True)] or [np.zeros(0, np.int32)])
    count = np.concatenate([np.frombuffer(f[h:], np.float32) for f, h in zip(features, half, strict=True)] or [np.zeros(0, np.float32)])
    return bounds, index, count


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
