"""A sink of one named file a row, all at once: `df.write.format("frames").mode("overwrite").save(folder)` after register().

Rows are (name, value): a relative file name and its text. Tasks write to a staging folder of the job, and only the commit moves files to
their names, so a job that fails or is given up leaves nothing there, and writing the same rows again gives the same files. `append`
adds files, and replaces those of the same name; `overwrite` also removes the others that the sink wrote before.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Folders and files that are not results begin with an underscore, which readers pass over.
_STAGING, _DONE = "_staging", "_SUCCESS"


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder and how many files it has: names stay on the store."""

    folder: str
    files: int


def checked(name: str) -> str:
    """A relative name that stays within the folder."""
    clean = posixpath.normpath(name or "")
    if not name or clean.startswith(("/", "..", "_")) or clean == ".":
        raise ValueError(f"not a file name for this sink: {name!r}")
    return clean


class FrameWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        names = schema.fieldNames()
        if sorted(names) != ["name", "value"]:
            raise ValueError(f"the columns are name and value, not {names}")
        self.uri, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def write(self, rows: Iterator[Row]) -> Staged:
        store, root = self._store()
        task = TaskContext.get()
        folder = f"{root}/{_STAGING}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        written = 0
        for row in rows:
            path = f"{folder}/{checked(row['name'])}"
            store.create_dir(posixpath.dirname(path), recursive=True)
            if store.get_file_info(path).type != fs.FileType.NotFound:
                raise ValueError(f"two rows are named {row['name']!r}")
            with store.open_output_stream(path) as out:
                out.write((row["value"] or "").encode())
            written += 1
        return Staged(folder, written)

    def _staged(self, store: fs.FileSystem, message: Staged) -> Iterator[tuple[str, str]]:
        if message.files:
            for f in store.get_file_info(fs.FileSelector(message.folder, recursive=True)):
                if f.type == fs.FileType.File:
                    yield f.path, f.path[len(message.folder) + 1 :]

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self._store()
        staged = [m for m in messages if m is not None]
        names: set[str] = set()
        for m in staged:
            for _, name in self._staged(store, m):
                if name in names:
                    self.abort(messages)
                    raise ValueError(f"two rows are named {name!r}")
                names.add(name)
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
                name = f.path[len(root) + 1 :]
                if f.type == fs.FileType.File and not name.startswith("_") and name not in names:
                    store.delete_file(f.path)
        for m in staged:
            for path, name in self._staged(store, m):
                store.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                store.move(path, f"{root}/{name}")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{_DONE}") as out:
            out.write(json.dumps({"files": len(names)}).encode())
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Nothing of this job stays but what was committed."""
        store, root = self._store()
        if store.get_file_info(f"{root}/{_STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{_STAGING}/{self.job}")
        if store.get_file_info(f"{root}/{_STAGING}").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{root}/{_STAGING}")):
            store.delete_dir(f"{root}/{_STAGING}")


class FrameFiles(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        path = self.options["path"]
        return FrameWriter(path if "://" in path or path.startswith("file:") else f"file://{path}", schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; a writer looks it up in the thread's active one, which may be another."""
    spark.dataSource.register(FrameFiles)
    active = SparkSession.getActiveSession()
    if active is not None and active is not spark:
        active.dataSource.register(FrameFiles)
