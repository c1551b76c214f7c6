"""Repeated lines and sentences: global digests, the earliest occurrence stays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import durable
from .textbatch import bounded_batches

#: A unit of fewer words is never removed: short ones repeat by chance.
MIN_WORDS = 8
#: Each level cuts a text into pieces that cover it; a piece holds its line or sentence end.
LEVELS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^.!?\n]+[.!?]*[ \t]*\n?|[.!?\n]+[ \t]*"}


def _units(levels: list[str], min_words: int):
    patterns = [(k, re.compile(LEVELS[level])) for k, level in enumerate(levels)]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list] = {n: [] for n in ("row", "level", "start", "end", "digest")}
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                for level, pattern in patterns:
                    for piece in pattern.finditer(text):
                        # bytes.lower and bytes.split know ASCII only, as the normal form asks
                        words = piece[0].encode().lower().split()
                        if len(words) >= min_words:
                            own["row"].append(i)
                            own["level"].append(level)
                            own["start"].append(piece.start())
                            own["end"].append(piece.end())
                            own["digest"].append(hashlib.blake2b(b"%d " % level + b" ".join(words), digest_size=16).digest())
                if len(own["row"]) > 100_000:
                    yield table(batch, own)
                    own = {n: [] for n in own}
            yield table(batch, own)

    def table(batch: pa.RecordBatch, own: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(own["row"], pa.int64())),
                pa.array(own["level"], pa.int32()),
                pa.array(own["start"], pa.int64()),
                pa.array(own["end"], pa.int64()),
                pa.array(own["digest"], pa.binary()),
            ],
            ["doc_id", "level", "start", "end", "digest"],
        )

    return units


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, ...] = ("line", "sentence"), min_words: int = MIN_WORDS
) -> DataFrame:
    """``(doc_id, level, start, end, first_id, first_start)``: every span that repeats an earlier one.

    Units are lines and sentences of whole texts with ``min_words`` or more words; two are equal
    if they are so with A-Z in lower case and ASCII white space collapsed (128-bit digests). The
    occurrence of the smallest (id, start) stays, in whatever document; the others are returned
    with their character offsets in the original text and the occurrence that stays. A level
    compares with itself only, so a span may come once for each level.
    Digests are counted before the shuffle, and only those that occur twice or more are joined
    with the units; a very common line is split by AQE, as both sides are dealt afresh.
    Rows with a null id or a null or empty text have no units; rows that repeat an id count as the
    same document: what is kept at an offset is kept in each. An empty table gives no spans.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0))
    units = bounded_batches(rows).mapInArrow(_units(list(levels), min_words), f"doc_id {kind}, level int, start bigint, end bigint, digest binary")
    units = durable(units, "units")
    first = units.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
    first = durable(first.where("n > 1").select("digest", "first"), "repeated")
    found = units.join(first, "digest")
    names = F.element_at(F.array(*[F.lit(n) for n in levels]), F.col("level") + 1)
    return found.where(~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))).select(
        "doc_id", names.alias("level"), "start", "end", F.col("first.doc_id").alias("first_id"), F.col("first.start").alias("first_start")
    )


def spans_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, spans)``, one row per row of ``docs``: its repeated spans by level and start.

    spans is empty, never null. See ``repeated_spans`` for what counts.
    """
    found = repeated_spans(docs, id_col, text_col, **options).distinct()
    spans = F.array_sort(F.collect_list(F.struct("level", "start", "end", "first_id", "first_start")))
    own = durable(found.groupBy("doc_id").agg(spans.alias("spans")), "spans")
    ids = docs.select(F.col(id_col).alias("doc_id"))
    none = F.array().cast(own.schema["spans"].dataType)
    return ids.join(own, "doc_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated spans cut out of the text, and ``removed``: the cut spans' original offsets.

    Spans of both levels are united; ``removed`` is an array of (start, end), empty where nothing
    was cut. Rows with a null id or text are returned as they are.
    """
    found = repeated_spans(docs, id_col, text_col, **options).select("doc_id", "start", "end").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("start", "end")))
    # unite spans that touch: each is appended, or lengthens the last
    grow = lambda out, s: F.when(
        (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(out, F.array(s)))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    cut = durable(found.groupBy("doc_id").agg(F.aggregate(ordered, none, grow).alias("removed")), "cut")
    rows = docs.join(cut.withColumnRenamed("doc_id", id_col), id_col, "left")
    spans = F.coalesce("removed", none)
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            F.col(text_col),
            F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).cast("int") + 1,
            (F.coalesce(F.get(spans, i)["start"], F.length(text_col)) - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))).cast("int"),
        ),
    )
    return rows.select(
        *[F.when(F.col(c).isNotNull(), F.array_join(pieces, "")).alias(c) if c == text_col else F.col(c) for c in docs.columns], spans.alias("removed")
    )
