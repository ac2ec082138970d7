"""Folders of files as a data source: one folder for each row is written, and all files below a folder are read, dot-files too.

Spark's own sources write one file for each task and pass over names that
begin with a dot or underscore.  Paths go to ``pyarrow.fs``, so executors
reach local, mounted and object stores by URI.
"""

from __future__ import annotations

import fnmatch
import posixpath
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Folder of unfinished writes below the target.
ATTEMPTS = "_attempts"
#: Partitions of a read, about; folders in one partition, at least and at most.
PARTITIONS, FEWEST, MOST = 256, 16, 1024
#: Moves that the commit has under way at once.
MOVES = 32


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path.rstrip("/"))


def _inside(name: str) -> str:
    """A relative name that stays below its folder."""
    clean = posixpath.normpath(name)
    if not name or clean.startswith(("/", "..")) or clean == ".":
        raise ValueError(f"no name of a file or folder here: {name!r}")
    return clean


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    folders: list[str]


class TreeWriter(DataSourceWriter):
    """Tasks write below ``_attempts``; the commit moves each row's folder to its place, so a lost task leaves no half folder there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        store, top = _at(path)
        self.job = f"{top}/{ATTEMPTS}/{uuid.uuid4().hex}"
        store.create_dir(self.job, recursive=True)

    def _make(self, store: fs.FileSystem, at: str, made: set) -> None:
        """The folder and those above it, up to the job's own: a task that outlives the job's end finds that gone and fails."""
        if at not in made and at != self.job:
            self._make(store, posixpath.dirname(at), made)
            store.create_dir(at, recursive=False)
            made.add(at)

    def write(self, iterator: Iterator) -> Written:
        store, _ = _at(self.path)
        attempt, names, made = f"{self.job}/{uuid.uuid4().hex}", [], set()
        for row in iterator:
            name = _inside(row["folder"])
            self._make(store, f"{attempt}/{name}", made)
            for file, text in (row["files"] or {}).items():
                at = f"{attempt}/{name}/{_inside(file)}"
                self._make(store, posixpath.dirname(at), made)
                with store.open_output_stream(at) as out:
                    out.write((text or "").encode("latin-1", "replace") if row["latin1"] else (text or "").encode())
            names.append(name)
        return Written(attempt, names)

    def commit(self, messages: list) -> None:
        store, top = _at(self.path)
        places = [(m.attempt, n) for m in messages if m for n in m.folders]
        names = [n for _, n in places]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several rows have one folder")
        # folders below one folder go in turn, as one may lie in another
        below = defaultdict(list)
        for attempt, name in places:
            below[name.split("/")[0]].append((attempt, name))

        def move(first: str) -> None:
            for attempt, name in below[first]:
                there = store.get_file_info(f"{top}/{name}").type != fs.FileType.NotFound
                if there and not self.overwrite:
                    raise FileExistsError(f"{top}/{name}")
                if there:
                    store.delete_dir(f"{top}/{name}")
                if "/" in name:
                    store.create_dir(posixpath.dirname(f"{top}/{name}"), recursive=True)
                store.move(f"{attempt}/{name}", f"{top}/{name}")

        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(move, below):
                pass
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        store, top = _at(self.path)
        for left in reversed(range(50)):  # tasks that still write may add a file while the folder goes
            try:
                if store.get_file_info(f"{top}/{ATTEMPTS}").type != fs.FileType.NotFound:
                    store.delete_dir(f"{top}/{ATTEMPTS}")
                return
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)


@dataclass
class Folders(InputPartition):
    """Names of folders right below the path, or the path itself, whose folders do not count."""

    names: list[str]
    recursive: bool


class TreeReader(DataSourceReader):
    """Partitions hold some of the folders right below the path, and one the files beside them; executors list and read."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[Folders]:
        store, top = _at(self.path)
        if store.get_file_info(top).type == fs.FileType.NotFound:
            return []
        found = store.get_file_info(fs.FileSelector(top))
        names = sorted(x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name != ATTEMPTS)
        each = min(max(-(-len(names) // PARTITIONS), FEWEST), MOST)
        return [Folders([""], False), *(Folders(names[i : i + each], True) for i in range(0, len(names), each))]

    def read(self, partition: Folders | None) -> Iterator[tuple]:
        if partition is None:  # there is no folder
            return
        store, top = _at(self.path)
        for name in partition.names:
            folder = f"{top}/{name}".rstrip("/")
            for x in sorted(store.get_file_info(fs.FileSelector(folder, recursive=partition.recursive)), key=lambda x: x.path):
                if x.type == fs.FileType.File and fnmatch.fnmatchcase(x.base_name, self.pattern):
                    with store.open_input_stream(x.path) as f:
                        yield x.path[len(top) + 1 :], x.path, x.size, f.read()


class Tree(DataSource):
    """Format ``file_tree``; options ``path`` and, for reading, ``pattern`` of file names."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "name string, path string, length long, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("pattern", "*"))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], overwrite)


def read_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, path, length, content) of all files below a folder, dot-files too; none where there is no folder."""
    spark.dataSource.register(Tree)
    return spark.read.format("file_tree").option("path", path).option("pattern", pattern).load()


def write_tree(df: DataFrame, path: str, folder: str = "folder", files: str = "files", latin1: bool = False) -> None:
    """One folder for each row, with the files of its map of names to texts, appearing as a whole; a folder that is there is replaced."""
    spark = df.sparkSession
    spark.dataSource.register(Tree)
    rows = df.select(F.col(folder).cast("string").alias("folder"), F.col(files).cast("map<string,string>").alias("files"), F.lit(latin1).alias("latin1"))
    # making files is the work, not the size of the table: as many parts as there are cores, several times
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(parts, "folder").write.format("file_tree").option("path", path).mode("overwrite").save()


def first_existing(df: DataFrame, path: str, bases: list[str], name: str = "resolved") -> DataFrame:
    """Adds the first place where the path exists: as it is if absolute, else below each of ``bases`` in turn; below the first where it is nowhere.

    Executors look, once for each different path of a batch.  Null paths stay null.
    """
    stems = [b.rstrip("/") for b in bases]

    def places(value: str) -> list[str]:
        return [value] if value.startswith("/") or "://" in value else [f"{b}/{value}" for b in stems]

    def there(place: str) -> bool:
        store, at = _at(place)
        return store.get_file_info(at).type != fs.FileType.NotFound

    def run(batches):
        for b in batches:
            values = b.column(path).to_pylist()
            known = {v: next((p for p in places(v) if there(p)), places(v)[0]) for v in set(values) if v is not None}
            yield b.append_column(name, pa.array([known.get(v) for v in values], pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, `{name}` string")
