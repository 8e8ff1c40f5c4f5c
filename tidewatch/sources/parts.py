"""A folder of JSON lines that grows by committed batches, written by a Spark sink with a commit protocol.

Tasks write files of their own under _pending. A commit moves them to parts named by the rows before
them, then puts a manifest of the batch in its place by one rename, and then the checkpoint (the rows so
far). Readers follow the manifests alone, so they see a batch whole or not at all. A batch that is tried
again after a failure finds its manifest and does nothing, or takes the place of the parts left without one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

PENDING, COMMITS, CHECKPOINT = "_pending", "_commits", "checkpoint.json"
MANIFEST = "batch long, key string, replaces boolean, first long, last long, files array<string>"


@dataclass
class Written(WriterCommitMessage):
    """A task's file (none if it had no rows) and its rows."""

    file: str | None
    rows: int


class _Folder:
    """The files of one sink, in any store that pyarrow knows."""

    def __init__(self, path: str) -> None:
        self.path = path

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        files, base = self.open()
        files.create_dir(f"{base}/{PENDING}", recursive=True)
        name, n = f"{PENDING}/{uuid.uuid4().hex}.json", 0
        with files.open_output_stream(f"{base}/{name}") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(), default=lambda v: v.isoformat()).encode() + b"\n")
                n += 1
        if n:
            return Written(name, n)
        files.delete_file(f"{base}/{name}")
        return Written(None, 0)

    def manifests(self) -> list[dict]:
        """All committed batches, in order."""
        files, base = self.open()
        found = files.get_file_info(fs.FileSelector(f"{base}/{COMMITS}", allow_not_found=True))
        return [json.loads(files.open_input_stream(f.path).readall()) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".json")]

    def _place(self, name: str, content: dict) -> None:
        """Writes a small file aside and renames it, so that it is there whole or not at all."""
        files, base = self.open()
        aside = f"{base}/{PENDING}/{uuid.uuid4().hex}"
        files.create_dir(f"{base}/{PENDING}", recursive=True)
        with files.open_output_stream(aside) as out:
            out.write(json.dumps(content).encode())
        files.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
        files.move(aside, f"{base}/{name}")

    def commit(self, messages: list[Written | None], batch: int | None, key: str | None, replaces: bool) -> None:
        done = self.manifests()
        if any((batch is not None and m["batch"] == batch) or (key is not None and m["key"] == key) for m in done):
            self.drop(messages)
            return
        files, base = self.open()
        number = batch if batch is not None else 1 + max((m["batch"] for m in done), default=-1)
        first = at = 0 if replaces else max((m["last"] for m in done[-1:]), default=0)
        names = []
        for m in messages:
            if m is not None and m.file:
                names.append(f"part-{number:09d}-{at:012d}.json")
                target = f"{base}/{names[-1]}"
                if files.get_file_info(target).type != fs.FileType.NotFound:
                    files.delete_file(target)  # of a try that ended before its manifest
                files.move(f"{base}/{m.file}", target)
                at += m.rows
        self._place(f"{COMMITS}/{number:09d}.json", {"batch": number, "key": key, "replaces": replaces, "first": first, "last": at, "files": names})
        self._place(CHECKPOINT, {"offset": at})

    def drop(self, messages: list[Written | None]) -> None:
        files, base = self.open()
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{base}/{m.file}")


class _Batch(DataSourceWriter):
    def __init__(self, folder: _Folder, key: str | None, replaces: bool) -> None:
        self.folder, self.key, self.replaces = folder, key, replaces

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.folder.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.folder.commit(messages, None, self.key, self.replaces)

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.drop(messages)


class _Stream(DataSourceStreamWriter):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.folder.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.folder.commit(messages, batchId, None, False)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.folder.drop(messages)


class RequestParts(DataSource):
    """The sink `request_parts`: path, and for batches key, a name under which a batch is committed once only."""

    @classmethod
    def name(cls) -> str:
        return "request_parts"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Batch(_Folder(self.options["path"]), self.options.get("key"), overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Stream(_Folder(self.options["path"]))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of path that count: from the last one on that replaced all before it."""
    files, base = _Folder(path).open()
    if files.get_file_info(f"{base}/{COMMITS}").type == fs.FileType.NotFound:
        return spark.createDataFrame([], MANIFEST)
    # A folder whose name begins with an underscore is read only by a pattern.
    found = spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/{COMMITS}/*.json")
    last = found.where("replaces").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    return found.where(F.col("batch") >= last)


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches."""
    names = [r[0] for r in committed(spark, path).select(F.explode("files")).distinct().collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{n}" for n in names])


def write_parts(rows: DataFrame, path: str, key: str | None = None, replace: bool = False) -> None:
    """Commits rows to path as one batch."""
    rows.sparkSession.dataSource.register(RequestParts)
    out = rows.write.format("request_parts").mode("overwrite" if replace else "append").option("path", path)
    (out.option("key", key) if key else out).save()


def stream_parts(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer, to be started, that commits each of the stream's batches to path."""
    rows.sparkSession.dataSource.register(RequestParts)
    return rows.writeStream.format("request_parts").option("path", path).option("checkpointLocation", checkpoint)
