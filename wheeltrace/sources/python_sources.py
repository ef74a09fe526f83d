"""Python data sources: point clouds read by byte ranges, and result tables with a commit manifest.

Both reach files through ``pyarrow.fs``, so any store it knows will do (local and shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 32 << 20     # a larger cloud is cut
TASK_BYTES = 32 << 20      # of clouds in one task
BATCH_POINTS = 200_000
FOLDER_TASKS = 256         # tasks that folders of documents are dealt to
BATCH_FILES, BATCH_BYTES = 2000, 16 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a path or URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of one file, of a folder with all below it, or of the files that a pattern in the last part names."""
    store, inner = store_of(path)
    pattern = None
    if "*" in inner.rpartition("/")[2]:
        inner, _, pattern = inner.rpartition("/")
    info = store.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=pattern is None, allow_not_found=True))
    hidden = lambda name: name.startswith(("_", "."))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.base_name) and (pattern is None or fnmatch(f.base_name, pattern)))


def put_file(path: str, content: bytes) -> None:
    """Write a file so that it is there whole or not at all; writing it again gives the same."""
    store, inner = store_of(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, inner)


# --- point clouds -----------------------------------------------------------------------------------
@dataclass
class CloudRanges(InputPartition):
    """Ranges (path, start, stop, floats a point) that one task reads."""

    parts: list[tuple[str, int, int, int]]


class _CloudReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.options = options["path"], options

    def partitions(self) -> list[CloudRanges]:
        """Files are cut after so many bytes; small pieces share a task."""
        most, ranges = int(self.options.get("rangebytes", RANGE_BYTES)), []
        for path, size in list_files(self.path):
            floats = size // 4 if size % 4 == 0 else 0
            width = 4 if floats and floats % 4 == 0 else 3 if floats and floats % 3 == 0 else 0
            if width:  # others are no clouds
                step = max(1, most // (4 * width)) * 4 * width
                ranges += [(path, a, min(a + step, size), width) for a in range(0, size, step)]
        task = int(self.options.get("taskbytes", TASK_BYTES))
        out, room = [CloudRanges([])], task
        for r in ranges:
            if out[-1].parts and room < r[2] - r[1]:
                out.append(CloudRanges([]))
                room = task
            out[-1].parts.append(r)
            room -= r[2] - r[1]
        return out

    def read(self, partition: CloudRanges):
        store, _ = store_of(self.path)
        for path, start, stop, width in partition.parts:
            size = 4 * width
            with store.open_input_file(path) as f:
                for a in range(start, stop, BATCH_POINTS * size):
                    n = min(BATCH_POINTS * size, stop - a)
                    f.seek(a)
                    raw = np.frombuffer(f.read(n), np.float32).reshape(-1, width)
                    point = a // size + np.arange(len(raw))
                    cols = [raw[:, k].copy() if k < width else np.zeros(len(raw), np.float32) for k in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(raw)), pa.array(point), *map(pa.array, cols)], ["path", "point", "x", "y", "z", "i"])


class PointClouds(DataSource):
    """``path, point, x, y, z, i`` of raw float files: four floats a point, else three (``i`` 0), else the file is left out.

    A file is cut into ranges of ``rangeBytes``, and a task reads ranges of ``taskBytes`` or one larger, so that no cloud has to fit
    into a row or a task.
    """

    @classmethod
    def name(cls):
        return "point_clouds"

    def schema(self):
        return "path string, point long, x float, y float, z float, i float"

    def reader(self, schema):
        return _CloudReader(dict(self.options))


# --- small documents --------------------------------------------------------------------------------
@dataclass
class Folders(InputPartition):
    """Folders whose files one task lists and reads."""

    paths: list[str]


class _DocumentReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tasks = options["path"], int(options.get("tasks", FOLDER_TASKS))

    def partitions(self) -> list[Folders]:
        store, inner = store_of(self.path)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))
        return [Folders(found[k::self.tasks]) for k in range(min(self.tasks, len(found)))] or [Folders([])]

    def read(self, partition: Folders):
        store, _ = store_of(self.path)
        for folder in partition.paths:
            names, texts, size = [], [], 0
            for path, n in list_files(folder if isinstance(store, fs.LocalFileSystem) else f"{self.path.rstrip('/')}/{folder.rpartition('/')[2]}"):
                with store.open_input_stream(path) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
                names.append(path)
                size += n
                if size > BATCH_BYTES or len(names) >= BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["path", "value"])
                    names, texts, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["path", "value"])


class FolderDocuments(DataSource):
    """``path, value`` of the text files in the folders below a folder. The driver lists only the folders; their files are listed and read
    by the tasks, so that millions of small files need no list in one place."""

    @classmethod
    def name(cls):
        return "folder_documents"

    def schema(self):
        return "path string, value string"

    def reader(self, schema):
        return _DocumentReader(dict(self.options))


# --- results ----------------------------------------------------------------------------------------
@dataclass
class Staged(WriterCommitMessage):
    files: list[str]
    rows: int


class _ResultsWriter(DataSourceArrowWriter):
    """Tasks stage Parquet files; the commit publishes a manifest that names them. What no manifest names does not exist."""

    def __init__(self, options):
        self.path, self.version = options["path"], options["version"]

    def write(self, iterator):
        store, inner = store_of(self.path)
        out, name, rows = None, f"data/{self.version}-{uuid.uuid4().hex}.parquet", 0
        store.create_dir(f"{inner}/data", recursive=True)
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(f"{inner}/{name}", batch.schema, filesystem=store)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Staged([name] if out is not None else [], rows)

    def commit(self, messages):
        done = [m for m in messages if m is not None]
        text = json.dumps({"version": self.version, "files": sorted(f for m in done for f in m.files), "rows": sum(m.rows for m in done)})
        put_file(f"{self.path}/manifests/{self.version}.json", text.encode())

    def abort(self, messages):
        store, inner = store_of(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                store.delete_file(f"{inner}/{f}")


class Results(DataSource):
    """Versioned results; ``path`` and ``version`` are options. Read them with :func:`published_files`."""

    @classmethod
    def name(cls):
        return "versioned_results"

    def schema(self):
        raise NotImplementedError("read the files that the manifests name")

    def writer(self, schema, overwrite):
        return _ResultsWriter(dict(self.options))


def new_version() -> str:
    """Sorts by time; different for every writer."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def published_files(path: str) -> list[str]:
    """Data files of all committed writes."""
    store, inner = store_of(path)
    found = store.get_file_info(fs.FileSelector(f"{inner}/manifests", allow_not_found=True))
    out = []
    for info in sorted((f for f in found if f.path.endswith(".json")), key=lambda f: f.path):
        with store.open_input_stream(info.path) as f:
            out += [f"{path.rstrip('/')}/{name}" for name in json.loads(f.read())["files"]]
    return out


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointClouds)
    spark.dataSource.register(FolderDocuments)
    spark.dataSource.register(Results)


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write one file per row (``name``, ``content``) below a folder; returns how many."""

    def run(batches):
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                put_file(f"{folder}/{n}", c)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = files.select(name, content).mapInArrow(run, "n long")
    return rows.groupBy().sum("n").first()[0] or 0
