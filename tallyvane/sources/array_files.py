"""JSON arrays in files of given names: a data source that writes them, and a reader whose tasks list the files."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def file_name(value: str) -> str:
    """A name that any file system takes: : / and % are written as %3A %2F %25."""
    return value.replace("%", "%25").replace(":", "%3A").replace("/", "%2F")


def plain_name(value: str) -> str:
    """The value that file_name was given."""
    return value.replace("%3A", ":").replace("%2F", "/").replace("%25", "%")


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: the folder of its attempt, whose list names the folder and file of each staged one."""

    attempt: str


class ArrayWriter(DataSourceArrowWriter):
    """Each task streams its files into a folder of its own attempt; the job's commit gives the files of the attempts that
    count their names, each by one move in place of an older one. So a repeated or stopped task leaves nothing to be read."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root, f"{root}/.staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, staged = self._open()
        attempt, done, current, out = f"{staged}/{uuid.uuid4().hex}", 0, None, None
        files.create_dir(attempt)
        with files.open_output_stream(f"{attempt}/list") as names:
            for batch in iterator:
                for folder, file, item in zip(*(batch.column(c).to_pylist() for c in ("folder", "file", "item"))):
                    if (folder, file) != current:
                        if out is not None:
                            out.write(b"]\n")
                            out.close()
                        current = (folder, file)
                        names.write(json.dumps(current).encode() + b"\n")
                        out = files.open_output_stream(f"{attempt}/{done}")
                        out.write(b"[")
                        done, between = done + 1, b"\n"
                    if item is not None:
                        out.write(between + item.encode() + b"\n")
                        between = b","
            if out is not None:
                out.write(b"]\n")
                out.close()
        return Written(attempt)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, _ = self._open()

        def name(attempt: str) -> None:
            made = None
            with files.open_input_stream(f"{attempt}/list") as names:
                for k, line in enumerate(io.TextIOWrapper(names, "utf-8")):
                    folder, file = json.loads(line)
                    place = f"{root}/{file_name(folder)}" if folder else root
                    if place != made:
                        files.create_dir(place)
                        made = place
                    files.move(f"{attempt}/{k}", f"{place}/{file_name(file)}")

        # The lists are read as streams: the driver never holds the names of all files.
        with ThreadPoolExecutor(8) as pool:
            for _ in pool.map(name, [m.attempt for m in messages if m is not None]):
                pass
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, staged = self._open()
        if files.get_file_info(staged).type != fs.FileType.NotFound:
            files.delete_dir(staged)


class JsonArrays(DataSource):
    """Rows (folder, file, item), those of a file together and in order: path/<folder>/<file> is an array of the items, which
    are JSON on one line. A null item is no element, so that a file can be empty; the folder "" is the path itself."""

    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"])


#: Names, and bytes of texts, that a task hands on at a time.
NAMES, TEXTS = 10_000, 8 << 20


def _list(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(path)
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            found = [f.base_name for f in files.get_file_info(fs.FileSelector(f"{root}/{folder}")) if f.is_file and f.base_name.endswith(".json")]
            for k in range(0, len(found), NAMES):
                names = found[k : k + NAMES]
                yield pa.RecordBatch.from_pydict({"folder": [folder] * len(names), "file": names})


def _read(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(path)
    rows, held = [], 0
    made = lambda: pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(("folder", "file", "raw"))})
    for batch in batches:
        for folder, file in zip(batch.column("folder").to_pylist(), batch.column("file").to_pylist()):
            with files.open_input_stream(f"{root}/{folder}/{file}", compression=None) as text:
                raw = text.read().decode("utf-8-sig", "replace")
            rows.append((plain_name(folder), plain_name(file), raw))
            held += len(raw)
            if held >= TEXTS or len(rows) >= NAMES:
                yield made()
                rows, held = [], 0
    if rows:
        yield made()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, raw) of the files path/<folder>/<file> whose names end in .json: what their names stand for, and their text.

    Spark's own readers hold the name, size and place of each file in the driver, more than it has room for where every
    project has several files. Here it knows the folders; a task lists one, and the names are dealt out to be read.
    """
    files, root = fs.FileSystem.from_uri(path)
    folders = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and not f.base_name.startswith(".staged-"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, min(parts, len(folders))), "folder")
    names = rows.mapInArrow(lambda batches: _list(path, batches), "folder string, file string").repartition(parts, "folder", "file")
    return names.mapInArrow(lambda batches: _read(path, batches), "folder string, file string, raw string")
