"""Benchmark decontamination by winnowing: find every shared span of ten words."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import durable
from .textbatch import ASCII_LOWER, bounded_batches, byte_table, chunks, mix, runs, span_hashes

WINDOW = 10
#: Words of a gram. A window of ten words has WINDOW - GRAM + 1 of them and winnowing keeps its least.
GRAM = 5
#: Words are runs of digits, letters and bytes of non-ASCII characters.
_WORD = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Above so much benchmark text the fingerprints are joined by a shuffle instead of sent to each task.
BROADCAST_BYTES = 4 << 20


def _item_type(kind: str) -> tuple[str, pa.DataType]:
    """Integers are handed on as bigint, other ids as text."""
    return ("bigint", pa.int64()) if kind in ("tinyint", "smallint", "int", "bigint") else ("string", pa.string())


def _words(text: bytes) -> list[bytes]:
    data = ASCII_LOWER[np.frombuffer(text, dtype=np.uint8)]
    starts, ends, _ = runs(_WORD[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)


def _winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the least of at least one window of ``width`` grams."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = grams[:n].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + n], out=least)
    picked = np.zeros(len(grams), dtype=bool)
    for j in range(width):
        picked[j : j + n] |= grams[j : j + n] == least
    return np.flatnonzero(picked)


def _selected(hashes: np.ndarray, first: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed (word position, gram hash) of rows of words; ``first`` bounds the rows."""
    grams = _grams(hashes, gram)
    if not len(grams):
        return np.zeros(0, dtype=np.int64), grams
    at = _winnow(grams, width)
    row = np.searchsorted(first, at, side="right") - 1
    # A gram that crosses into the next row is noise. It may hide a row's own gram in windows that
    # cross as well, never in a window that lies within the row.
    at = at[at + gram <= first[row + 1]]
    return at, grams[at]


class Index:
    """The benchmark's fingerprints, for lookups by tasks, and its words, for extending hits."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items = [(i, w) for i, t in items if (w := _words(t))]
        self.lengths = sorted({min(len(w), WINDOW) for _, w in self.items})
        self.keys: dict[int, np.ndarray] = {}
        self.places: dict[int, list[list[tuple[int, int]]]] = {}
        found: dict[int, dict[int, list]] = {n: defaultdict(list) for n in self.lengths}
        for k, (_, words) in enumerate(self.items):
            n = min(len(words), WINDOW)
            for at, key in zip(*self.fingerprints(words, n), strict=True):
                found[n][int(key)].append((k, int(at)))
        for n, by_key in found.items():
            self.keys[n] = np.array(sorted(by_key), dtype=np.uint64)
            self.places[n] = [by_key[int(x)] for x in self.keys[n]]

    def lookup(self, n: int, at: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(word position, item, item position) of the keys that the index has for spans of n words."""
        place = np.searchsorted(self.keys[n], keys)
        place[place == len(self.keys[n])] = 0
        same = self.keys[n][place] == keys
        return [
            (i, k, j)
            for i, p in zip(at[same].tolist(), place[same].tolist(), strict=True)
            for k, j in self.places[n][p]
        ]

    @staticmethod
    def shape(n: int) -> tuple[int, int]:
        """Gram and window width for spans of ``n`` words: gram + width - 1 = n."""
        return (GRAM, n - GRAM + 1) if n == WINDOW else (n, 1)

    @classmethod
    def fingerprints(cls, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        data = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - np.array([len(w) for w in words])
        hashes = span_hashes(np.frombuffer(data, dtype=np.uint8), starts, ends)
        return _selected(hashes, np.array([0, len(words)]), *cls.shape(n))


def _extend(words: list[bytes], other: list[bytes], i: int, j: int) -> tuple[int, int]:
    """The longest run with ``words[a:b] == other[a + j - i:b + j - i]`` around position i, j."""
    a, b, d = i, i, j - i
    while a and a + d and words[a - 1] == other[a + d - 1]:
        a -= 1
    while b < len(words) and b + d < len(other) and words[b] == other[b + d]:
        b += 1
    return a, b


def _spans(words: list[bytes], hits: list[tuple[int, int, int]], items: list) -> list[tuple[int, int, int]]:
    """Hits (word position, item, item position) -> verified spans (from, to, item)."""
    done: dict[tuple[int, int], int] = {}
    spans = []
    for i, k, j in sorted(hits):
        if done.get((k, j - i), -1) > i:  # within a run that was extended before
            continue
        a, b = _extend(words, items[k][1], i, j)
        done[k, j - i] = b
        if b > a and b - a >= min(WINDOW, len(items[k][1])):
            spans.append((a, b, k))
    return spans


def _inside(n: int, spans: list[tuple[int, int, int]]) -> int:
    """How many of n words lie in a span."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for a, b, _ in spans:
        edges[a] += 1
        edges[b] -= 1
    return int((np.cumsum(edges) > 0).sum())


def _scan(sent, item_type: pa.DataType):
    """sent: the broadcast index; a worker reads it once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            n_hit = np.zeros(batch.num_rows, dtype=np.int64)
            ids: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for chunk in chunks(batch.column(1)):
                data = ASCII_LOWER[chunk.data]
                starts, ends, first = runs(_WORD[data], chunk.offsets)
                n_words[chunk.first : chunk.first + len(chunk)] = np.diff(first)
                if not len(starts):
                    continue
                hashes = span_hashes(data, starts, ends)
                hits: dict[int, list] = defaultdict(list)
                for n in index.lengths:
                    at, keys = _selected(hashes, first, *index.shape(n))
                    for i, k, j in index.lookup(n, at, keys):
                        row = bisect.bisect_right(first, i) - 1
                        hits[row].append((i - int(first[row]), k, j))
                for row, own in hits.items():
                    spans = _spans(_words(chunk.row(row)), own, index.items)
                    n_hit[chunk.first + row] = _inside(int(first[row + 1] - first[row]), spans)
                    found = {index.items[k][0] for _, _, k in spans}
                    ids[chunk.first + row] = sorted(found - {None})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(ids, pa.list_(item_type))],
                ["doc_id", "n_words", "n_hit", "item_ids"],
            )

    return scan


def _emit(lengths: list[int], own_length: bool):
    """Rows (id, text) -> (id, span, key): the fingerprints for spans of so many words.

    own_length: of a text, only those for spans of min(its words, ten), as benchmark items have.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                data = ASCII_LOWER[chunk.data]
                starts, ends, first = runs(_WORD[data], chunk.offsets)
                if not len(starts):
                    continue
                hashes = span_hashes(data, starts, ends)
                size = np.minimum(np.diff(first), WINDOW)
                for n in lengths:
                    at, keys = _selected(hashes, first, *Index.shape(n))
                    row = np.searchsorted(first, at, side="right") - 1
                    if own_length:
                        own = size[row] == n
                        row, keys = row[own], keys[own]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row + chunk.first)),
                            pa.array(np.full(len(row), n, dtype=np.int32)),
                            pa.array(keys.view(np.int64)),
                        ],
                        ["id", "span", "key"],
                    )

    return emit


def _verify(item_type: pa.DataType):
    """Rows (row, item_id, text, item text) -> (row, item_id, spans): the verified spans of one item."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, spans = [], [], []
            for row, item_id, text, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, index = _words(text.encode()), Index([(item_id, item.encode())])
                n = index.lengths[0]
                at, keys = Index.fingerprints(words, n)
                if own := _spans(words, index.lookup(n, at, keys), index.items):
                    rows.append(row)
                    ids.append(item_id)
                    spans.append([[a, b] for a, b, _ in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, item_type), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["row", "item_id", "spans"],
            )

    return verify


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids)``, one row per row of ``docs``.

    A window is ten consecutive words of a benchmark item, or a shorter item's whole text. n_hit
    counts the words inside occurrences of windows, item_ids (sorted) names the items they are of.
    Winnowing keeps the least 5-gram hash of every ten words on both sides, so each shared span of
    ten words has a kept hash in common; equal hashes are extended word by word, so a collision
    never counts. Items of n < 10 words are met by the hashes of all n-grams.
    The benchmark's text is measured first: up to ``broadcast_bytes`` its index goes to every task
    and documents are never shuffled; beyond that fingerprints are joined by a shuffle.
    Null or empty texts have no words; items without words match nothing; an item with a null id
    hits but isn't named; rows may repeat. Null document ids are kept. Item ids that aren't integers
    are handed on as text. Empty tables are allowed: without items nothing is hit. Other columns
    are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_kind, item_type = _item_type(benchmark.schema[item_col].dataType.simpleString())
    items = benchmark.select(F.col(item_col).cast(item_kind).alias("item_id"), F.col(item_text).alias("item_text"))
    items = items.where("item_text is not null")
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size <= broadcast_bytes:
        index = Index([(r[0], r[1].encode()) for r in items.collect()])
        sent = docs.sparkSession.sparkContext.broadcast(index)
        return bounded_batches(docs).mapInArrow(_scan(sent, item_type), f"doc_id {kind}, n_words bigint, n_hit bigint, item_ids array<{item_kind}>")
    return _by_shuffle(docs, items, kind, item_kind, item_type)


def _by_shuffle(docs: DataFrame, items: DataFrame, kind: str, item_kind: str, item_type: pa.DataType) -> DataFrame:
    docs = durable(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    items = items.withColumn("item_row", F.monotonically_increasing_id())
    items = durable(items, "items")
    schema = "id bigint, span int, key bigint"
    mine = items.select("item_row", "item_text").mapInArrow(_emit(list(range(1, WINDOW + 1)), True), schema)
    mine = durable(mine.distinct(), "item_fingerprints")
    spans = sorted(r[0] for r in mine.select("span").distinct().collect())  # ten at most
    theirs = bounded_batches(docs.select("row", "text")).mapInArrow(_emit(spans, False), schema).distinct()
    pairs = (
        theirs.withColumnRenamed("id", "row").join(mine.withColumnRenamed("id", "item_row"), ["span", "key"])
        .select("row", "item_row").distinct()
    )
    joined = pairs.join(docs.select("row", "text"), "row").join(items, "item_row")
    checked = bounded_batches(joined.select("row", "item_id", "text", "item_text")).mapInArrow(
        _verify(item_type), f"row bigint, item_id {item_kind}, spans array<array<bigint>>"
    )
    # words inside any span: the union of intervals, by a running maximum of the ends
    each = checked.select("row", F.explode("spans").alias("s")).select("row", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
    before = F.max("b").over(Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    words = (
        each.distinct().withColumn("from", F.greatest("a", F.coalesce(before, F.lit(0))))
        .groupBy("row").agg(F.sum(F.greatest(F.col("b") - F.col("from"), F.lit(0))).alias("n_hit"))
    )
    named = checked.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    none = F.array().cast(f"array<{item_kind}>")
    counted = bounded_batches(docs.select("row", "doc_id", "text")).mapInArrow(_count, f"row bigint, doc_id {kind}, n_words bigint")
    return (
        counted.join(words, "row", "left").join(named, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for chunk in chunks(batch.column(2)):
            _, _, first = runs(_WORD[ASCII_LOWER[chunk.data]], chunk.offsets)
            n[chunk.first : chunk.first + len(chunk)] = np.diff(first)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["row", "doc_id", "n_words"])


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options
) -> DataFrame:
    """``docs`` without the rows whose id has a text with a benchmark window; null ids stay.

    Only ids of contaminated documents are joined. See ``find_contamination`` for what counts.
    """
    found = find_contamination(docs, benchmark, id_col, text_col, item_col, item_text, **options)
    gone = durable(found.where("n_hit > 0").select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
