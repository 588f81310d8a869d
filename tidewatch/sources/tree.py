"""Source trees as a Spark data source (S1, and the sizes of S6).

``spark.read.format("sourcetree").load(root)`` gives one row per file, (path below
the root, length), for every name: also those that start with ``.`` or ``_``, which
Spark's own file listing leaves out.  The planner lists a bounded number of folders to
deal the tree out; tasks walk the rest.  Only names and lengths are listed.  Contents are read afterwards, in tasks
that are cut by bytes, so that neither a large repository nor a large folder is one task.

Links to folders are not followed, links to files are; pipes and sockets are no files.
Any file system that ``pyarrow.fs`` opens by its address works, on a cluster a shared one.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewatch.session import materialize, ship_package

# Parts a tree is dealt out in, and folders that the planner lists at most for that.
SLICES, PLANNED_FOLDERS = 256, 1000
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
# Bytes that one reading task is meant to open.
READ_BYTES = 64 << 20


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address or plain path, and the path there."""
    if "://" in root or root.startswith("file:"):
        scheme, _, rest = root.partition(":")
        if scheme == "file":  # no decoding: names may hold any sign
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), os.path.abspath(root)


def entries(files: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, length) of what a folder holds."""
    if isinstance(files, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0
                    continue
                try:
                    s = e.stat()
                except OSError:  # a link to nothing
                    continue
                if stat.S_ISREG(s.st_mode):
                    yield e.name, False, s.st_size
    else:
        for info in files.get_file_info(pafs.FileSelector(folder)):
            if info.type == pafs.FileType.Directory:
                yield info.base_name, True, 0
            elif info.is_file:
                yield info.base_name, False, info.size


@dataclass
class Slice(InputPartition):
    """Folders below the root, each with whether its subfolders belong to the slice too."""
    folders: list[tuple[str, bool]]


def _below(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.slices = int(options.get("slices", SLICES))

    def partitions(self) -> list[Slice]:
        files, root = open_root(self.root)
        whole, single = deque([""]), []
        while whole and len(whole) < self.slices and len(single) < PLANNED_FOLDERS:
            folder = whole.popleft()
            single.append((folder, False))
            whole.extend(_below(folder, name) for name, is_folder, _ in entries(files, _below(root, folder) if folder else root) if is_folder)
        units = [*single, *((f, True) for f in whole)]
        return [Slice(units[i::self.slices]) for i in range(min(self.slices, len(units)))]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, root = open_root(self.root)
        rows: list[tuple[str, int]] = []
        todo = list(partition.folders)
        while todo:
            folder, deep = todo.pop()
            for name, is_folder, length in entries(files, f"{root}/{folder}" if folder else root):
                if not is_folder:
                    rows.append((shown(_below(folder, name)), length))
                elif deep:
                    todo.append((_below(folder, name), True))
                if len(rows) == BATCH_ROWS:
                    yield _listing(rows)
                    rows = []
        if rows:
            yield _listing(rows)


def shown(path: str) -> str:
    """A path as text; bytes that are no UTF-8 are written as ``\\xNN`` (such files are listed, not opened)."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


def _listing(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "length"])


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options)


def list_source_tree(spark: SparkSession, root: str, repo: str | None = None, slices: int = SLICES) -> DataFrame:
    """(repo, path, bytes) of every file under ``root``, as a written table.

    ``repo`` names one repository at ``root``; without it ``root`` holds one checkout per folder, and
    the first folder of a file's path names its repository (files directly under ``root`` belong to
    the last part of ``root``)."""
    ship_package(spark)
    spark.dataSource.register(SourceTree)
    root = root.rstrip("/") or "/"
    found = spark.read.format("sourcetree").option("slices", slices).load(root).withColumn("file", F.col("path"))
    if repo is not None:
        named = found.select(F.lit(repo).alias("repo"), "path", F.col("length").alias("bytes"), "file")
    else:
        inside = F.instr("path", "/") > 0
        named = found.select(
            F.when(inside, F.substring_index("path", "/", 1)).otherwise(F.lit(root.rsplit("/", 1)[-1])).alias("repo"),
            F.when(inside, F.expr("substring(path, instr(path, '/') + 1)")).otherwise(F.col("path")).alias("path"), F.col("length").alias("bytes"), "file")
    return materialize(named, "source-tree")


def read_contents(listing: DataFrame, root: str, most: int) -> DataFrame:
    """``listing`` (with ``file``, the path below ``root``, and ``bytes``) plus ``content`` as bytes; a file above
    ``most`` bytes, or one that cannot be opened, has a null content."""
    spark = listing.sparkSession
    total = listing.agg(F.sum(F.least("bytes", F.lit(most)))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    fields = listing.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = open_root(root)
        for b in batches:
            first, held, size = 0, [], 0
            for i, (name, length) in enumerate(zip(b.column("file").to_pylist(), b.column("bytes").to_pylist())):
                data = None
                if length <= most:
                    try:
                        with files.open_input_stream(f"{at}/{name}") as f:
                            data = f.read()
                    except OSError:
                        pass
                held.append(data)
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield _with_content(b, first, held)
                    first, held, size = i + 1, [], 0
            if held:
                yield _with_content(b, first, held)

    return listing.repartition(int(tasks), "file").mapInArrow(run, schema)


def _with_content(b: pa.RecordBatch, first: int, held: list[bytes | None]) -> pa.RecordBatch:
    part = b.slice(first, len(held))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])


def write_tree(files: DataFrame, root: str) -> int:
    """Writes (path, content) rows as files under ``root`` from the tasks, a checkout for tests and
    queries; returns their number.  A repeated task writes the same files again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_root(root)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                store.create_dir(f"{at}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{at}/{path}") as out:
                    out.write(content.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
