"""Readers of scripts, Final Draft XML, style packs and image manifests."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encodings import decode

MOST_BYTES = 128 << 20
PARAGRAPHS = "array<struct<_Type: string, Text: array<string>>>"
FDX = (
    "_ScriptID string, Content struct<Paragraph: array<struct<_Type: string, Text: array<string>, DualDialogue: struct<Paragraph: "
    f"{PARAGRAPHS}>>>>, TitlePage struct<Content: struct<Paragraph: array<struct<Text: array<string>>>>>"
)
STYLE_CARD = "id string, prompt string, category string, title string"

#: Bytes of one Arrow batch, about; a larger file is a batch of its own.
BATCH_BYTES = 16 << 20


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length, content) -> (path, length, charset, text, reason), a file at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            content = batch.column(2)[i]
            charset, text, reason = decode(content.as_py())
            if text is None:
                texts = pa.nulls(1, pa.string())
            else:  # without another copy
                ends = pa.py_buffer(np.array([0, len(text)], dtype=np.int32))
                texts = pa.StringArray.from_buffers(1, ends, pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([charset], pa.string()), texts, pa.array([reason], pa.string())], ["path", "length", "charset", "text", "reason"]
            )


def _fits() -> Column:
    return F.col("length") <= MOST_BYTES


def decode_scripts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, length, content)`` -> (scripts, rejects).

    A file is accepted if it round-trips in UTF-8, UTF-16 or UTF-32 with a mark, or, without one,
    in UTF-8 or the likeliest one of GB18030, Big5 and UTF-16 (see ``encodings.decode``).
    Only a leading mark is dropped. Files over 128 MB and all others are refused with a reason
    (not decodable, ambiguous encoding), never repaired. An empty file is an empty script. Plain
    UTF-8 is read by the JVM; Python sees only the rest, a file at a time, in Arrow batches of some 16 MB
    (the session is set to that).
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    files.sparkSession.conf.set(name, str(BATCH_BYTES))
    large = files.where(~_fits()).select("path", F.lit("too large").alias("reason"), "length")
    small = files.where(_fits())
    text = F.col("content").cast("string")
    plain = F.coalesce(F.is_valid_utf8("content") & ~F.contains(text, F.lit("\x00")), F.lit(False))
    unmarked = F.when(F.startswith(text, F.lit("﻿")), F.call_function("substring", text, F.lit(2))).otherwise(text)
    easy = small.where(plain).select("path", unmarked.alias("text"), F.lit("UTF-8").alias("charset"))
    kind = files.schema["path"].dataType.simpleString()
    hard = small.where(~plain).select("path", "length", "content").mapInArrow(_decoded, f"path {kind}, length {files.schema['length'].dataType.simpleString()}, charset string, text string, reason string")
    scripts = easy.unionByName(hard.where("charset is not null").select("path", "text", "charset"))
    scripts = scripts.select(F.sha2("path", 256).alias("script_id"), "path", "text", "charset", F.sha2("text", 256).alias("fingerprint"))
    bad = hard.where("charset is null").select("path", "reason", "length")
    return scripts, large.unionByName(bad)


def _listed(files: DataFrame) -> DataFrame:
    """``(path)`` of all files of a reader, also of those without bytes, which Spark lists but doesn't read."""
    names = [(unquote(name).replace("file:///", "file:/", 1),) for name in files.inputFiles()]
    return files.sparkSession.createDataFrame(names, "path string")


def read_scripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text scripts under a path; the size test is pushed down, so large files aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    empty = _listed(files).join(files.select("path"), "path", "left_anti")
    empty = empty.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content"))
    return decode_scripts(files.select("path", "length", "content").unionByName(empty))


def read_fdx(spark: SparkSession, path: str) -> DataFrame:
    """``(script_id, element_idx, element, text, dual)`` of Final Draft XML, paragraphs in order.

    A paragraph's text is that of all its runs, however they are styled. Paragraphs that stand
    side by side (``DualDialogue``) come in order, with one number for each such group in ``dual``; the
    paragraph around them, and any other without a type, is no element. Documents without a
    ``ScriptID`` take their file's path as id. Empty paragraphs have empty text.
    """
    rows = spark.read.format("xml").schema(FDX).option("rowTag", "FinalDraft").option("ignoreSurroundingSpaces", False).load(path)
    script_id = F.coalesce("_ScriptID", F.col("_metadata.file_path"))
    single = lambda p, n: F.struct(p["_Type"].alias("element"), _runs(p["Text"]).alias("text"), n.alias("dual"))
    none = F.lit(None).cast("int")
    groups = F.transform(
        F.col("Content.Paragraph"),
        lambda p, i: F.concat(F.array(single(p, none)), F.transform(F.coalesce(p["DualDialogue"]["Paragraph"], F.array().cast(PARAGRAPHS)), lambda q: single(q, i))),
    )
    listed = rows.select(script_id.alias("script_id"), F.posexplode(F.filter(F.flatten(groups), lambda e: e["element"].isNotNull())).alias("element_idx", "e"))
    number = F.dense_rank().over(Window.partitionBy("script_id").orderBy(F.col("e.dual").asc_nulls_last()))
    return listed.select("script_id", "element_idx", "e.element", "e.text", F.when(F.col("e.dual").isNotNull(), number).alias("dual"))


def read_fdx_titles(spark: SparkSession, path: str) -> DataFrame:
    """``(script_id, line_idx, text)`` of the title pages of Final Draft XML."""
    rows = spark.read.format("xml").schema(FDX).option("rowTag", "FinalDraft").option("ignoreSurroundingSpaces", False).load(path)
    listed = rows.select(F.coalesce("_ScriptID", F.col("_metadata.file_path")).alias("script_id"), F.posexplode("TitlePage.Content.Paragraph").alias("line_idx", "p"))
    return listed.select("script_id", "line_idx", _runs(F.col("p.Text")).alias("text"))


def _runs(c: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(c, lambda run: F.coalesce(run, F.lit(""))), ""), F.lit(""))


def read_style_pack(spark: SparkSession, path: str, repository: str | None = None, commit: str | None = None, license: str | None = None) -> DataFrame:
    """Style cards of JSON packs with their provenance; a pack is an array of cards.

    The result has the file that a card is from (source_path), its id there (original_id), and the
    repository, commit and license given here.
    """
    rows = spark.read.schema(STYLE_CARD).option("multiLine", True).json(path)
    return rows.withColumns({
        "source_path": F.col("_metadata.file_path"), "original_id": F.col("id"), "repository": F.lit(repository).cast("string"),
        "source_commit": F.lit(commit).cast("string"), "license": F.lit(license).cast("string"),
    })


def read_image_sets(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(``(set_name, filenames)`` of the Contents.json manifests, ``(set_name, filename)`` of the files there).

    Files are listed, not read; one without bytes is there as well.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": "Contents.json"}
    manifests = spark.read.schema("images array<struct<filename: string>>").options(multiLine=True, **options).json(root)
    of = lambda path: F.element_at(F.split(path, "/"), -2)
    sets = manifests.select(of(F.col("_metadata.file_path")).alias("set_name"), F.filter("images.filename", lambda f: f.isNotNull()).alias("filenames"))
    listed = _listed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
    files = listed.select(of(F.col("path")).alias("set_name"), F.element_at(F.split("path", "/"), -1).alias("filename")).where("filename <> 'Contents.json'")
    return sets, files
