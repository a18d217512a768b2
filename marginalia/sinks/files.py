"""Notes as real files: a Spark data source whose tasks write, whose commit publishes, and whose abort leaves nothing behind."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# the writer travels to the executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CURRENT = "_current"


def _open(target: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)


def _safe(path: str) -> str:
    """``path`` as it may be put below a folder; one that would leave it is refused."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts or path.startswith("/"):
        raise ValueError(f"not a path below a folder: {path!r}")
    return "/".join(parts)


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class NoteFileWriter(DataSourceWriter):
    """One version of a folder: every task writes its notes below ``v-<id>``, the commit names that version in ``_current``."""

    def __init__(self, target: str, version: str, columns: list[str]):
        self.target, self.version, self.at = target.rstrip("/"), version, (columns.index("path"), columns.index("content"))

    def write(self, rows: Iterator) -> Written:
        system, base = _open(self.target)
        base, known, files, total = f"{base}/{self.version}", set(), 0, 0
        for row in rows:
            to = f"{base}/{_safe(row[self.at[0]])}"
            folder = to.rpartition("/")[0]
            if folder not in known:
                system.create_dir(folder, recursive=True)
                known.add(folder)
            data = (row[self.at[1]] or "").encode()
            # a task that runs again writes the same bytes to the same place
            with system.open_output_stream(to) as out:
                out.write(data)
            files, total = files + 1, total + len(data)
        return Written(files, total)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _open(self.target)
        system.create_dir(base, recursive=True)
        told = f"{self.version}\n{sum(m.files for m in messages if m)}\n{sum(m.bytes for m in messages if m)}\n"
        with system.open_output_stream(f"{base}/{CURRENT}-{self.version}") as out:
            out.write(told.encode())
        system.move(f"{base}/{CURRENT}-{self.version}", f"{base}/{CURRENT}")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _open(self.target)
        if system.get_file_info(f"{base}/{self.version}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.version}")


class NoteFiles(DataSource):
    """``df.write.format("note_files").save(folder)`` for (path, content) rows."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> NoteFileWriter:
        return NoteFileWriter(self.options["path"], f"v-{uuid.uuid4().hex}", schema.fieldNames())


def write_note_files(notes: DataFrame, target: str) -> None:
    """K1, K2: (path, content) rows as files of a new version below ``target``. Readers of the version before see it until the new one is whole; a failed write leaves
    the old one. Null contents are empty files; of equal paths any one stays."""
    notes.sparkSession.dataSource.register(NoteFiles)
    notes.select("path", "content").write.format("note_files").mode("append").save(target)


def current_version(target: str) -> tuple[str, int, int]:
    """Folder of the published version, and its files and bytes."""
    system, base = _open(target.rstrip("/"))
    with system.open_input_stream(f"{base}/{CURRENT}") as told:
        version, files, total = told.read().decode().split()
    return f"{target.rstrip('/')}/{version}", int(files), int(total)


def delete_folder(spark: SparkSession, target: str) -> None:
    """Delete a folder through Spark's own file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
