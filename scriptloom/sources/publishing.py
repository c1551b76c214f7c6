"""Publishing as a transaction: a Spark data source whose writer commits one version or leaves nothing.

A published folder has data files, each in a folder of the write that made it, and ``_versions`` with
one small JSON file a version: which files it added. A version file comes into being as a whole and
under a number that nothing had (a hard link; a move that fails if the target is there on
HDFS), so of two publishers at once each gets a number of its own. Of every script the greatest
version that holds it counts. Files that no version names are never read.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows that say which scripts a version holds, also those without rows.
HELD = "_held"
VERSIONS = "_versions"
MOST_TRIES = 1000


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _versions(fs: pafs.FileSystem, root: str) -> dict[int, list[str]]:
    """The files that each version added."""
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/{VERSIONS}", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                found[int(info.base_name.removesuffix(".json"))] = json.loads(f.read())["files"]
    return found


def _claim(fs: pafs.FileSystem, draft: str, target: str) -> bool:
    """Give a finished version file its name, unless something has it; False then."""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(draft, target)
            return True
        except FileExistsError:
            return False
    if not isinstance(fs, pafs.HadoopFileSystem):
        raise NotImplementedError("publishing needs a file system that can create a file only if it isn't there: local (shared) or HDFS")
    if fs.get_file_info(target).type != pafs.FileType.NotFound:
        return False
    try:
        fs.move(draft, target)  # HDFS doesn't move onto an existing file
        return True
    except OSError:
        if fs.get_file_info(target).type == pafs.FileType.NotFound:
            raise
        return False


@dataclass
class Written(WriterCommitMessage):
    """The files that one task has written."""

    files: list[str]


class PublishWriter(DataSourceArrowWriter):
    """Tasks write Parquet files; the driver commits them as one version or removes them."""

    def __init__(self, path: str):
        self.path = path
        self.own = f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.path)
        name, writer = f"{self.own}/part-{uuid.uuid4().hex}.parquet", None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    fs.create_dir(f"{root}/{self.own}", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs)
                writer.write_batch(batch)
        finally:
            if writer is not None:
                writer.close()
        return Written([name] if writer is not None else [])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        files = [name for m in messages if m is not None for name in m.files]
        fs.create_dir(f"{root}/{VERSIONS}", recursive=True)
        draft = f"{root}/{VERSIONS}/{self.own}.draft"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files, "write": self.own}).encode())
        try:
            for _ in range(MOST_TRIES):
                number = max(_versions(fs, root), default=0) + 1
                if _claim(fs, draft, f"{root}/{VERSIONS}/{number:010d}.json"):
                    return
            raise RuntimeError(f"no version number was free in {MOST_TRIES} tries")
        finally:
            if fs.get_file_info(draft).type != pafs.FileType.NotFound:
                fs.delete_file(draft)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove all files of this write, also those of tasks that never answered.

        A task that is still at work may write after that; its files belong to no version, so nobody
        reads them, and ``remove_superseded`` takes them away.
        """
        fs, root = _filesystem(self.path)
        if fs.get_file_info(f"{root}/{self.own}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.own}")


class PublishSource(DataSource):
    """``df.write.format("publish").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "publish"

    def writer(self, schema, overwrite: bool) -> PublishWriter:
        return PublishWriter(self.options["path"])


def publish_if_complete(df: DataFrame, audits: DataFrame, path: str) -> None:
    """Publish the rows of scripts with a complete audit as one version; others keep their last good result.

    A complete script without rows is published as empty. Readers see the whole version or, until it is
    committed and after any failure, what was there before. Publishers at the same time both succeed; of a script
    that both hold the later version counts.
    """
    spark = df.sparkSession
    spark.dataSource.register(PublishSource)
    complete = audits.where("complete").select("script_id").distinct()
    rows = df.join(complete, "script_id", "left_semi").withColumn(HELD, F.lit(False))
    held = complete.select("script_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != "script_id"], F.lit(True).alias(HELD))
    rows.unionByName(held).write.format("publish").mode("append").save(path)


def _published(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of all versions with their ``_version``; None where nothing has been published."""
    fs, root = _filesystem(path)
    versions = _versions(fs, root)
    files = [f"{path.rstrip('/')}/{name}" for names in versions.values() for name in names]
    if not files:
        return None
    numbers = spark.createDataFrame([(names[0].split("/")[0], n) for n, names in versions.items() if names], "_write string, _version bigint")
    write = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.parquet(*files).withColumn("_write", write).join(numbers, "_write").drop("_write")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The published rows: of each script those of the last version that holds it.

    An error where nothing has been published yet.
    """
    rows = _published(spark, path)
    if rows is None:
        raise FileNotFoundError(f"nothing has been published in {path}")
    last = rows.groupBy("script_id").agg(F.max("_version").alias("_version"))
    return rows.where(~F.col(HELD)).join(last, ["script_id", "_version"], "left_semi").drop(HELD, "_version")


def remove_superseded(spark: SparkSession, path: str, older_than_s: float = 7 * 24 * 3600) -> list[int]:
    """Remove versions of which no script's last result is left, and files that no version names.

    Only what was last changed ``older_than_s`` ago goes, so that readers and writers at work keep
    theirs. Returns the numbers of the versions removed. The newest version always stays.
    """
    fs, root = _filesystem(path)
    versions = _versions(fs, root)
    rows = _published(spark, path)
    live = {max(versions, default=0)}
    if rows is not None:
        live |= {r[0] for r in rows.groupBy("script_id").agg(F.max("_version").alias("v")).select("v").distinct().collect()}  # versions, not scripts
    before = time.time() - older_than_s
    gone = []
    for number in sorted(set(versions) - live):
        target = f"{root}/{VERSIONS}/{number:010d}.json"
        if fs.get_file_info(target).mtime.timestamp() <= before:
            fs.delete_file(target)
            gone.append(number)
    named = {name.split("/")[0] for n, names in versions.items() if n not in gone for name in names}
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.type == pafs.FileType.Directory and info.base_name.startswith("write-") and info.base_name not in named and info.mtime.timestamp() <= before:
            fs.delete_dir(info.path)
    return gone
