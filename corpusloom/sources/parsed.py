"""Parse results as a Python data source: a folder for each document, with a file for each of its parts; folders may lie in zip archives."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .documents import PARTS, with_missing, with_pages


@dataclass
class _Folder(InputPartition):
    """Folders (with all below them or without) and archives."""

    folders: list[tuple[str, bool]]


#: The end of the names of archives.
ARCHIVE = ".zip"


def _part(path: str) -> str | None:
    return next((k for k, suffix in PARTS.items() if path.endswith(suffix)), None)


class _Reader(DataSourceReader):
    def __init__(self, path: str, each: int):
        self.path, self.each = path, each

    def partitions(self) -> list[InputPartition]:
        """A partition for each document's folder (or for some of them) and for each archive; the files in these are listed by the tasks."""
        system, root = fs.FileSystem.from_uri(self.path)
        listed = lambda folder: system.get_file_info(fs.FileSelector(folder))
        level, own, archives = [root], [], []
        while True:
            infos = [i for folder in level for i in listed(folder)]
            archives += sorted(i.path for i in infos if i.is_file and i.path.endswith(ARCHIVE))
            own += sorted({i.path.rpartition("/")[0] for i in infos if i.is_file and _part(i.path)})
            level = sorted(i.path for i in infos if i.type == fs.FileType.Directory)
            if not level or all(i.is_file for i in listed(level[0])):
                break
        folders = [*((f, False) for f in own), *((f, True) for f in level)]
        found = [_Folder(folders[i : i + self.each]) for i in range(0, len(folders), self.each)]
        return [*found, *(_Folder([(a, False)]) for a in archives)] or [_Folder([])]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for top, deep in partition.folders:
            yield from self._archived(system, top) if top.endswith(ARCHIVE) else self._plain(system, top, deep)

    def _plain(self, system: fs.FileSystem, top: str, deep: bool) -> Iterator[tuple]:
        found, archives = self._found(system, top, deep)
        for folder, files in found:
            bodies = []
            for part in PARTS:
                if part in files:
                    with system.open_input_stream(files[part]) as f:
                        bodies.append(f.read().decode("utf-8", "replace"))
                else:
                    bodies.append(None)
            yield (folder.rpartition("/")[2], *bodies)
        for archive in archives:
            yield from self._archived(system, archive)

    @staticmethod
    def _archived(system: fs.FileSystem, path: str) -> Iterator[tuple]:
        """The documents of an archive, one at a time; files without a folder are the document that the archive is named for."""
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            found: dict[str, dict[str, str]] = {}
            for name in z.namelist():
                if part := _part(name):
                    found.setdefault(name.rpartition("/")[0], {})[part] = name
            for folder, files in found.items():
                bodies = [z.read(files[p]).decode("utf-8", "replace") if p in files else None for p in PARTS]
                yield (folder.rpartition("/")[2] or path.rpartition("/")[2].removesuffix(ARCHIVE), *bodies)

    @staticmethod
    def _found(system: fs.FileSystem, top: str, deep: bool) -> tuple[list[tuple[str, dict[str, str]]], list[str]]:
        """Folders with their parts, and what archives lie below the top."""
        found: dict[str, dict[str, str]] = {}
        archives = []
        for info in system.get_file_info(fs.FileSelector(top, recursive=deep)):
            if info.is_file and (part := _part(info.path)):
                found.setdefault(info.path.rpartition("/")[0], {})[part] = info.path
            elif info.is_file and deep and info.path.endswith(ARCHIVE):
                archives.append(info.path)
        return sorted(found.items()), sorted(archives)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, archived: int):
        self.path, self.archived, self.name = path, archived, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.path)
        if self.archived:
            return self._zipped(system, root, iter(iterator))
        for row in iterator:
            system.create_dir(f"{root}/{row['folder']}", recursive=True)
            for part, suffix in PARTS.items():
                if row[part] is not None:
                    with system.open_output_stream(f"{root}/{row['folder']}/{row['folder']}{suffix}") as f:
                        f.write(row[part].encode())
        return WriterCommitMessage()

    def _zipped(self, system: fs.FileSystem, root: str, rows: Iterator) -> WriterCommitMessage:
        """Archives of so many documents each. A task that runs again has as many, and writes over those of the run before."""
        system.create_dir(root, recursive=True)
        task = TaskContext.get().partitionId()
        for n in count():
            first = next(rows, None)
            if first is None:
                return WriterCommitMessage()
            with system.open_output_stream(f"{root}/{self.name}-{task:05}-{n:05}{ARCHIVE}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                for row in chain([first], islice(rows, self.archived - 1)):
                    for part, suffix in PARTS.items():
                        if row[part] is not None:
                            body = row[part].encode()
                            z.writestr(f"{row['folder']}/{row['folder']}{suffix}", body, zipfile.ZIP_STORED if len(body) < 100 else None)


class ParsedDocuments(DataSource):
    """folder, md, content_list, middle and model of the documents under `path`; parts that aren't there are null.

    Option folders: documents of a partition, one by default. Written rows overwrite the files of their folder, so that a
    task that runs again changes nothing; paths are of any store that Arrow opens. Option archived: so many documents are
    written to a zip archive, instead of folders of their own, in which each small file takes a block of the disk. Reading
    finds folders and archives alike.
    """

    @classmethod
    def name(cls) -> str:
        return "parsed_documents"

    def schema(self) -> str:
        return "folder string, " + ", ".join(f"{p} string" for p in PARTS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("folders", "1")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("archived", "0")))


def read_parsed(spark: SparkSession, path: str, folders: int = 1) -> tuple[DataFrame, DataFrame]:
    """Documents whose four files are all there, with their pages, and the folders that lack some, as load_parsed_documents gives them."""
    spark.dataSource.register(ParsedDocuments)
    return with_pages(spark.read.format("parsed_documents").option("folders", folders).load(path))


def read_all_parsed(spark: SparkSession, path: str, folders: int = 1) -> DataFrame:
    """All folders in one pass, with the parts that each lacks and the pages of those that lack none."""
    spark.dataSource.register(ParsedDocuments)
    return with_missing(spark.read.format("parsed_documents").option("folders", folders).load(path))


def write_parsed(rows: DataFrame, path: str, archived: int = 0) -> None:
    """Writes rows (folder, md, content_list, middle, model) as a folder of files each, or so many of these folders to an archive; null parts are left out."""
    rows.sparkSession.dataSource.register(ParsedDocuments)
    rows.select("folder", *PARTS).write.format("parsed_documents").option("archived", archived).mode("append").save(path)
