"""Files by name: a sink that stages and commits, and the cache that is read back from them."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Hidden folders beside the files: staged ones, and a record of each commit.
STAGED, COMMITS, EPOCH = ".staged", ".commits", ".epoch"


@dataclass
class _Staged(WriterCommitMessage):
    """What a task leaves to the commit: its own folder, not the names in it."""

    folder: str


def _local(path: str) -> str:
    path = path.removeprefix("file://")
    if "://" in path:
        raise ValueError(f"named files go to a mounted folder, not to {path}")
    return path


def _epoch(folder: str) -> str:
    try:
        with open(f"{folder}/{EPOCH}") as f:
            return f.read()
    except OSError:
        return ""


class _Writer(DataSourceWriter):
    """Tasks write to folders of their own. The commit names their files, each at once; until then nothing is to be seen.

    A task that fails removes its folder, and an aborted job all of them, those of lost executors too. If
    the cache was cleared since the job began, its files are stale, and the commit drops them.
    """

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex
        self.epoch = _epoch(folder)

    def write(self, iterator) -> WriterCommitMessage:
        own = f"{self.folder}/{STAGED}/{self.job}/{uuid.uuid4().hex}"
        os.makedirs(own)
        try:
            for row in iterator:
                at = os.path.normpath(f"{own}/{row['name']}")
                if not at.startswith(f"{own}/"):
                    raise ValueError(f"{row['name']} is not a name below the folder")
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(row["content"])
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise
        return _Staged(own)

    def commit(self, messages) -> None:
        count = total = delta = 0
        stale = _epoch(self.folder) != self.epoch
        for message in messages:
            if message is None or stale:
                continue
            for folder, _, names in os.walk(message.folder):
                for name in names:
                    staged = f"{folder}/{name}"
                    final = f"{self.folder}/{os.path.relpath(staged, message.folder)}"
                    size = os.path.getsize(staged)
                    old = os.path.getsize(final) if os.path.exists(final) else 0
                    os.makedirs(os.path.dirname(final), exist_ok=True)
                    os.replace(staged, final)
                    count, total, delta = count + 1, total + size, delta + size - old
        shutil.rmtree(f"{self.folder}/{STAGED}/{self.job}", ignore_errors=True)
        os.makedirs(f"{self.folder}/{COMMITS}", exist_ok=True)
        with open(f"{self.folder}/{COMMITS}/{self.job}.json", "w") as f:
            json.dump({"job": self.job, "files": count, "bytes": total, "delta": delta, "stale": stale}, f)

    def abort(self, messages) -> None:
        shutil.rmtree(f"{self.folder}/{STAGED}/{self.job}", ignore_errors=True)


class NamedFiles(DataSource):
    """df.write.format("named_files").mode("append").save(folder): a file for each row (name string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(_local(self.options["path"]))


def write_files(rows: DataFrame, folder: str) -> None:
    """A file below ``folder`` for each row of name and content; rows of null content have none. Of rows with one name any one stays."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.where("name is not null and content is not null").select("name", "content").write.format("named_files").mode("append").save(folder)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each write: files, bytes, and by how much the folder grew."""
    return spark.read.schema("job string, files long, bytes long, delta long, stale boolean").json(f"file://{_local(folder)}/{COMMITS}")


def clear(folder: str) -> None:
    """Remove all files; writes that are under way commit none."""
    folder = _local(folder)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{EPOCH}", "w") as f:
        f.write(uuid.uuid4().hex)
    for name in os.listdir(folder):
        if name not in (EPOCH, STAGED):
            at = f"{folder}/{name}"
            shutil.rmtree(at) if os.path.isdir(at) and not os.path.islink(at) else os.remove(at)


def cache_files(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """name, size, modified, content of files by glob; a plan that doesn't ask for content doesn't read it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).load(f"file://{_local(folder)}")
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
