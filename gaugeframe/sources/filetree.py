"""Files below a folder as a table that tasks list: ``spark.read.format("filetree")``."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, modified timestamp"


class Folder(InputPartition):
    """Folders of one task; ``deep`` ones with everything below them, others with their own files alone."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        uri = options["path"]
        self.uri = uri if urlsplit(uri).scheme else f"file://{uri}"
        self.parts = int(options.get("parts", 64))
        self.depth = int(options.get("depth", 1 << 30))
        self.prefix = options.get("prefix", "").strip("/")
        self.pattern = options.get("pattern", "")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    @staticmethod
    def _children(files, folder: str):
        from pyarrow import fs

        for child in files.get_file_info(fs.FileSelector(folder)):
            yield child, child.type == fs.FileType.Directory

    def _wanted(self, below: str) -> bool:
        """Whether a folder is on the way to ``prefix`` or inside it."""
        own, asked = (x.split("/") if x else [] for x in (below, self.prefix))
        return all(a == b for a, b in zip(own, asked))

    def partitions(self):
        """Folders are opened level by level until there are enough of them for ``parts`` tasks."""
        files, root = self._open()
        root = root.rstrip("/")
        level, opened, depth = [root], [], 0
        while level and len(level) < self.parts and depth < self.depth:
            opened += level
            level = [c.path for f in level for c, is_folder in self._children(files, f) if is_folder and self._wanted(c.path[len(root) + 1 :])]
            depth += 1
        todo = [(f, False) for f in opened] + [(f, True) for f in level if depth < self.depth]
        n = max(1, min(self.parts, len(todo)))
        return [Folder(todo[i::n]) for i in range(n)]

    def read(self, partition):
        files, root = self._open()
        root, name = root.rstrip("/"), re.compile(self.pattern)
        todo = list(partition.folders)
        while todo:
            folder, deep = todo.pop()
            below = folder[len(root) + 1 :]
            level = below.count("/") + 1 if below else 0
            for child, is_folder in self._children(files, folder):
                if is_folder:
                    if deep and level + 1 < self.depth and self._wanted(child.path[len(root) + 1 :]):
                        todo.append((child.path, True))
                elif self._inside(below) and name.search(child.base_name):
                    yield child.path, child.size, child.mtime

    def _inside(self, below: str) -> bool:
        return not self.prefix or below == self.prefix or below.startswith(f"{self.prefix}/")


class FileTree(DataSource):
    """``path, size, modified`` of files below a folder of any file system that Arrow knows.

    Options: ``path`` (a URI or a local path), ``parts`` (tasks, about), ``depth`` (levels of folders that are
    opened; 1 is the folder alone), ``prefix`` (a folder below ``path``: no other branch is opened) and
    ``pattern`` (a regular expression that is searched in file names). The driver opens whole levels until
    it has ``parts`` folders and holds the folders of one level; tasks list the rest. An empty folder gives no
    rows, a missing one an error.
    """

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options)


def list_tree(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Table of the files below ``folder``; options are those of ``FileTree``."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").options(**options).load(folder)
