"""A source tree as a Spark data source: `spark.read.format("repository").load("/path/to/tree")`.

Register it with `spark.dataSource.register(RepositorySource)`. Every folder of the tree that holds source files is a
partition, listed once on the driver by name only; contents are read on the executors. The tree must lie where all
executors see it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.functions.scalars import EXTENSIONS, IGNORED_DIRECTORIES


class Folder(InputPartition):
    def __init__(self, root: str, folder: str, names: list[str]):
        super().__init__(folder)
        self.root, self.folder, self.names = root, folder, names


class RepositorySource(DataSource):
    """Options: path (the tree), maxBytes (greatest size of a file, 2 MB by default; larger files have a null content)."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "rel_path string, language string, size long, mod_time long, content binary"

    def reader(self, schema) -> "RepositoryReader":
        return RepositoryReader(self.options)


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", "").removeprefix("file://").rstrip("/")
        self.most = int(options.get("maxbytes", options.get("maxBytes", 2 * 1024 * 1024)))

    def partitions(self) -> list[Folder]:
        out = []
        for folder, below, names in os.walk(self.root):
            below[:] = sorted(d for d in below if d not in IGNORED_DIRECTORIES)
            wanted = sorted(n for n in names if n.rsplit(".", 1)[-1].lower() in EXTENSIONS)
            if wanted:
                out.append(Folder(self.root, folder, wanted))
        return out or [Folder(self.root, self.root, [])]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for name in partition.names:
            path = os.path.join(partition.folder, name)
            stat = os.stat(path)
            content = None
            if stat.st_size <= self.most:
                with open(path, "rb") as f:
                    content = f.read()
            yield os.path.relpath(path, partition.root).replace(os.sep, "/"), EXTENSIONS[name.rsplit(".", 1)[-1].lower()], stat.st_size, int(stat.st_mtime), content
