"""Files under names of their own: one a row, written by tasks and given their names once all tasks are done.

A few files lie in the folder itself, and the driver names them one by one. Many are dealt by their names over folders ``<i>-of-<n>`` below
it: the files of one such folder are written by one task, which alone has to know the names there, and the driver moves each folder as a whole.
A task reads such a folder at once. So what the driver does grows with the folders, and what a task does doesn't grow.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from strandmark.operators.search import ranked

#: Characters that can't stand in a file's name everywhere.
NOT_IN_NAME = r'[\\/:*?"<>|\x00-\x1F]'


#: Files of a folder that many are dealt over, and of a task that reads files lying in the folder itself.
FOLDER_FILES = 1024
#: A folder among those that files are dealt over.
DEALT = re.compile(r"\d+-of-(\d+)")
#: Contents and rows that a task hands on at once when it reads.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.rstrip("/"))


@dataclass
class Written(WriterCommitMessage):
    place: str
    names: list[str]
    folders: list[str]


class NamedFilesWriter(DataSourceWriter):
    """Tasks write below ``.writing-<job>``, each attempt in a folder of its own; the driver moves what committed tasks wrote, and removes the rest."""

    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.job = path, replace, f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, base = opened(self.path)
        place, taken = f"{base}/{self.job}/{uuid.uuid4().hex}", {}
        files.create_dir(place, recursive=True)
        try:
            for row in iterator:
                name, folder = row["name"], row["folder"]
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"not a file's name: {name!r}")
                if folder not in taken:
                    taken[folder] = set() if self.replace or not folder else self._names(files, f"{base}/{folder}")
                    if folder:  # not with those above it, which an abort may have removed
                        files.create_dir(f"{place}/{folder}", recursive=False)
                if name in taken[folder]:
                    raise ValueError("a name is taken")
                taken[folder].add(name)
                with files.open_output_stream(f"{place}/{folder}/{name}" if folder else f"{place}/{name}") as out:
                    out.write(bytes(row["content"] or b""))
        except BaseException:
            files.delete_dir(place)
            raise
        return Written(place, sorted(taken.pop("", ())), sorted(taken))

    @staticmethod
    def _names(files: fs.FileSystem, folder: str) -> set[str]:
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
        return {f.base_name for f in found if f.type == fs.FileType.File}

    def commit(self, messages: list) -> None:
        files, base = opened(self.path)
        done = [m for m in messages if m]
        names, folders = [n for m in done for n in m.names], [x for m in done for x in m.folders]
        found = files.get_file_info(fs.FileSelector(base))
        there = {f.base_name for f in found if f.type == fs.FileType.File}
        dealt = {f.base_name for f in found if f.type == fs.FileType.Directory and DEALT.fullmatch(f.base_name)}
        if len(set(names)) < len(names) or len(set(folders)) < len(folders) or not self.replace and there & set(names):
            raise ValueError("a name is taken")
        if not self.replace and (names and dealt or folders and (there or len({DEALT.fullmatch(x)[1] for x in dealt.union(folders)}) > 1)):
            raise ValueError("the files that are there are dealt over another number of folders")
        if self.replace:
            for name in there - set(names):
                files.delete_file(f"{base}/{name}")
            for folder in dealt:
                files.delete_dir(f"{base}/{folder}")
        for message in done:
            for name in message.names:
                files.move(f"{message.place}/{name}", f"{base}/{name}")
            for folder in message.folders:  # beside what earlier jobs left there
                files.create_dir(f"{base}/{folder}")
                files.move(f"{message.place}/{folder}", f"{base}/{folder}/{self.job.removeprefix('.writing-')}")
        files.delete_dir(f"{base}/{self.job}")

    def abort(self, messages: list) -> None:
        files, base = opened(self.path)
        if files.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{self.job}")


@dataclass
class Part(InputPartition):
    """A folder that files are dealt over, or names of files that lie in the folder itself."""

    folder: str
    names: list[str]


class NamedFilesReader(DataSourceReader):
    """Names and sizes are tested on the listing, before contents are read; names with a dot in front aren't files."""

    def __init__(self, path: str, pattern: str, most_bytes: int | None, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.pattern, self.most_bytes, self.schema = path, pattern, most_bytes, to_arrow_schema(schema)

    def _wanted(self, f: fs.FileInfo) -> bool:
        return f.type == fs.FileType.File and f.base_name[0] != "." and fnmatchcase(f.base_name, self.pattern) and (self.most_bytes is None or f.size <= self.most_bytes)

    def partitions(self) -> list[Part]:
        files, base = opened(self.path)
        found = files.get_file_info(fs.FileSelector(base))
        parts = [Part(f.base_name, []) for f in found if f.type == fs.FileType.Directory and DEALT.fullmatch(f.base_name)]
        names = [f.base_name for f in found if self._wanted(f)]
        return [*parts, *(Part("", names[i : i + FOLDER_FILES]) for i in range(0, len(names), FOLDER_FILES))] or [Part("", [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, base = opened(self.path)
        if partition.folder:
            found = files.get_file_info(fs.FileSelector(f"{base}/{partition.folder}", recursive=True))
        else:
            found = files.get_file_info([f"{base}/{name}" for name in partition.names])
        held, size = [], 0
        for f in found:
            if self._wanted(f):
                with files.open_input_stream(f.path) as content:
                    held.append((f.base_name, f.path, f.mtime, f.size, content.read()))
                size += f.size
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield self._batch(held)
                    held, size = [], 0
        yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


class NamedFiles(DataSource):
    """Rows of name and content as files of a folder: ``append`` adds files, ``overwrite`` leaves only the new ones. The folder is one that Python
    on driver and executors reaches by the same path or address."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, path string, modificationTime timestamp, length long, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> DataSourceReader:
        most = self.options.get("mostBytes")
        return NamedFilesReader(self.options["path"], self.options.get("pattern", "*"), None if most is None else int(most), schema)


def folders_for(rows: DataFrame) -> int:
    """The number of folders that the files of so many rows are dealt over."""
    return max(1, rows.count() // FOLDER_FILES)


def write_files(rows: DataFrame, name: Column, content: Column, path: str, mode: str = "append", folders: int | None = None) -> None:
    """One file for each row; equal names, or a file that is there already with ``append``, are an error and leave nothing.

    Without ``folders`` files lie in the folder itself. For many, ``folders`` of them below it are each written by a task; later calls
    for the same path need the same number.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    named = rows.select(name.alias("name"), content.cast("binary").alias("content"))
    if folders:
        at = F.pmod(F.xxhash64("name"), F.lit(folders)).cast("int")
        named = named.withColumn("folder", F.format_string("%06d-of-%06d", at, F.lit(folders))).repartitionById(folders, at)
    else:
        named = named.withColumn("folder", F.lit(""))
    named.write.format("named_files").mode(mode).save(path)


def file_names(rows: DataFrame, stem: Column, ending: str, order: list[str], name: str = "name", path: str | None = None) -> DataFrame:
    """Adds ``name``: the stem with its ending, without characters that names can't have; further rows of one name get _2, _3 and so on.

    Without ``path`` the rows of a stem are one task's. With it they are ranged by stem and order, written there in parts and numbered over all
    parts, so that a stem may have any share of the rows.
    """
    stems = rows.withColumn("_stem", F.regexp_replace(stem, NOT_IN_NAME, "_"))
    if path is None:
        numbered = stems.withColumn("_n", F.row_number().over(Window.partitionBy("_stem").orderBy(*order)))
    else:
        placed = ranked(stems, ["_stem", *order], path, "_place")
        begins = placed.groupBy(F.col("_stem").alias("_of")).agg(F.min("_place").alias("_begin"))  # few where a stem has many rows
        joined = placed.join(begins, F.col("_stem").eqNullSafe(F.col("_of")))
        numbered = joined.withColumn("_n", F.col("_place") - F.col("_begin") + 1).drop("_of", "_begin", "_place")
    n = F.col("_n")
    return numbered.withColumn(name, F.concat("_stem", F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(ending))).drop("_stem", "_n")


def read_files(spark, path: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """name, path, modificationTime, length and content of a folder's files, also of those that are dealt over folders."""
    spark.dataSource.register(NamedFiles)
    reader = spark.read.format("named_files").option("pattern", pattern)
    return (reader if most_bytes is None else reader.option("mostBytes", most_bytes)).load(path)
