"""Folders listed and files read by tasks: neither names nor statuses of files pass through the driver."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.settle import settle
from ..sinks.files import _open

# the functions below travel to the executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 10_000  # of a batch of names
BATCH_BYTES = 8 << 20  # of contents in a batch
TASK_BYTES = 64 << 20  # of contents that one task reads

_ENTRY = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("micros", pa.int64())])


def _children(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int | None]]:
    """Name, whether it is a folder, bytes and time of what a folder holds; of a local one as a stream."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                told = e.stat()
                yield e.name, e.is_dir(), told.st_size, told.st_mtime_ns // 1000
    else:
        for e in system.get_file_info(fs.FileSelector(folder)):
            yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, e.mtime_ns // 1000 if e.mtime_ns is not None else None


def _hidden(name: str) -> bool:
    """What Spark's own readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _lister(root: str):
    """Job over (path) rows of folders below ``root``: the entries of each."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for b in batches:
            for folder in b.column("path").to_pylist():
                rows = []
                for name, is_folder, length, micros in _children(system, f"{base}/{folder}" if folder else base):
                    if not _hidden(name):
                        rows.append((f"{folder}/{name}" if folder else name, is_folder, 0 if is_folder else length, micros))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)

    return entries


def files_below(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length) of the files below ``root`` whose name matches ``glob``, empty ones too and hidden ones not. A round for each depth: every
    folder of it is listed by one task; the driver learns how many folders there are."""
    root, cores = root.rstrip("/"), spark.sparkContext.defaultParallelism
    name = f"^(?:{spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()})$"
    level, found = spark.range(1).select(F.lit("").alias("path")), None
    while True:
        rows = settle(level.mapInArrow(_lister(root), "path string, folder boolean, length long, micros long"))
        part = rows.where(~F.col("folder") & F.regexp_extract("path", r"([^/]*)$", 1).rlike(name))
        part = part.select("path", F.timestamp_micros("micros").alias("modificationTime"), "length")
        found = part if found is None else found.unionByName(part)
        folders = rows.where("folder").count()
        if not folders:
            return found
        level = rows.where("folder").select("path").repartition(min(folders, 4 * cores))


def _reader(root: str):
    """Job over rows with the path of a file below ``root``: the rows with its content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for b in batches:
            start, size, held = 0, 0, []
            paths = b.column("path").to_pylist()
            for i, path in enumerate(paths):
                with system.open_input_stream(f"{base}/{path}", compression=None) as told:
                    held.append(told.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i + 1 == len(paths):
                    yield pa.RecordBatch.from_arrays([*b.slice(start, len(held)).columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])
                    start, size, held = i + 1, 0, []

    return read


def with_content(files: DataFrame, root: str, parts: int | None = None) -> DataFrame:
    """``files`` (path, length, more) with the bytes of each as content. Paths are dealt over ``parts`` tasks, which read the files; contents are not shuffled."""
    if parts is None:
        n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        parts = max(1, min(n, max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    return files.repartition(parts, "path").mapInArrow(_reader(root.rstrip("/")), schema)
