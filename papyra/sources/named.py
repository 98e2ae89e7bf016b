"""A data source of whole files that keeps their names (S01, S02, S12): format `named_files`.

    named.register(spark)
    spark.read.format("named_files").option("glob", "*.md").load("/data/docs")       # (file_path, text, modified)
    rows.select("file_path", "text").write.format("named_files").mode("append").save("/data/out")

Paths may name any file system that Arrow knows (a local or shared folder, hdfs://, s3://, gs://).
Reading: the driver lists names and sizes, tasks read the contents; files are dealt to
partitions of `partition_bytes` at most (128 MB) and 4,096 files about, so one flat folder is
many tasks' work, of small files too; what is no UTF-8 is replaced. Equality filters on file_path are pushed to the listing.
Writing: a task writes its files into a folder of its own below `_attempts`; when all tasks
have ended well the driver moves them into place, by MOVERS threads, else all attempts are removed.
So a failed or repeated task leaves nothing. Of a name the driver keeps the message of its task and eight bytes more. Modes: append replaces files of the same path, overwrite removes
all others first. A path that is absolute, empty or leads out of the folder is an error, as is
a path that two rows have.
"""

from __future__ import annotations

import fnmatch
import posixpath
import time
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file_path string, text string, modified timestamp"
ATTEMPTS = "_attempts"
PARTITION_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
#: Files of a partition if they are empty: each counts for its share of partition_bytes beside its size.
FILES = 4096
#: Threads that move files into place, and files that one moves at a time.
MOVERS, LOT = 16, 1000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.normpath(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def _checked(path: str | None) -> str:
    if not path or path.startswith("/") or "\\" in path or posixpath.normpath(path) != path or path.split("/")[0] in ("..", ATTEMPTS):
        raise ValueError(f"not a path within the folder: {path!r}")
    return path


def _repeated(names: list[list[str]]) -> bool:
    """Whether two names are equal; names are compared only where their hashes are equal."""
    seen = np.sort(np.fromiter((hash(n) for own in names for n in own), np.int64))
    twice = set(seen[1:][seen[1:] == seen[:-1]].tolist())
    held = [n for own in names for n in own if hash(n) in twice] if twice else []
    return len(held) > len(set(held))


@dataclass
class Files(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file_path",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = [(f.path[len(root) + 1 :], f.size or 0) for f in found if f.type == fs.FileType.File]
        names = sorted((n, s) for n, s in names if fnmatch.fnmatch(posixpath.basename(n), self.glob) and n.split("/")[0] != ATTEMPTS and (self.only is None or n in self.only))
        out, size = [], 0
        for n, s in names:
            s += self.most // FILES
            if not out or size and size + s > self.most:
                out.append(Files([]))
                size = 0
            out[-1].names.append(n)
            size += s
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = _open(self.root)
        rows, size = [], 0

        def batch():
            kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["file_path", "text", "modified"])

        for n in partition.names:
            path = f"{root}/{n}"
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            rows.append((n, text, system.get_file_info(path).mtime))
            size += len(text)
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        system, root = _open(self.root)
        system.create_dir(f"{root}/{ATTEMPTS}/{self.job}", recursive=True)  # on the driver; while it stands, tasks may write

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.root)
        job = f"{root}/{ATTEMPTS}/{self.job}"
        folder, names, made = f"{job}/{uuid.uuid4().hex}", [], {job}

        def make(path: str) -> None:
            """A folder below the job's, level by level: none is made anew for a job that was given up."""
            if path not in made:
                make(posixpath.dirname(path))
                system.create_dir(path, recursive=False)
                made.add(path)

        for b in iterator:
            if system.get_file_info(job).type != fs.FileType.Directory:
                raise RuntimeError("the write was given up")
            for name, text in zip(b.column("file_path").to_pylist(), b.column("text").to_pylist()):
                path = f"{folder}/{_checked(name)}"
                make(posixpath.dirname(path))
                with system.open_output_stream(path) as f:
                    f.write((text or "").encode())
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.root)
        done = [m for m in messages if m is not None]
        if _repeated([m.names for m in done]):
            self.abort(messages)
            raise ValueError("two rows have one path")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if posixpath.basename(f.path) != ATTEMPTS:
                    (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        for path in sorted({posixpath.dirname(n) for m in done for n in m.names}):
            system.create_dir(f"{root}/{path}", recursive=True)

        def move(m: Written, first: int) -> None:
            for n in m.names[first : first + LOT]:
                system.move(f"{m.folder}/{n}", f"{root}/{n}")

        running = deque()
        with ThreadPoolExecutor(MOVERS) as pool:
            for m, first in ((m, k) for m in done for k in range(0, len(m.names), LOT)):
                running.append(pool.submit(move, m, first))
                if len(running) > 2 * MOVERS:
                    running.popleft().result()
            for r in running:
                r.result()
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.root))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        for path in (f"{root}/{ATTEMPTS}/{self.job}", f"{root}/{ATTEMPTS}"):
            there = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            if path.endswith(self.job) or not there:
                for again in range(20):  # a task that hasn't been stopped yet may add a file meanwhile
                    try:
                        if system.get_file_info(path).type == fs.FileType.Directory:
                            system.delete_dir(path)
                        break
                    except OSError:
                        if again == 19 and path.endswith(self.job):
                            raise
                        time.sleep(0.1)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; filters are pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NamedFiles)
