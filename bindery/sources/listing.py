"""A folder tree as a data source: which book files there are, and what could not be looked at.

Folders are the unit of work: the driver opens folders breadth first only until there are enough of them, and every task walks its
own. Files are those of the formats asked for, regular and no symbolic links; names that begin with a dot are left out, folders with all that is in
them, unless hidden ones are asked for. A folder or file that can't be looked at is a row with a warning, and the rest goes on. The tree must be on
a file system that the driver and all executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bindery.schema import EXTENSIONS

LISTED = "path string, name string, size long, modified_ns long, warning string"
#: Folders that the driver looks for before the tasks begin.
FOLDERS = 256


@dataclass
class Folders(InputPartition):
    """Folders of one task; a plain one gives its own files only, as its folders are other tasks'."""

    whole: list[str]
    plain: list[str]

    def __post_init__(self):
        super().__init__(self.whole)


def local_path(root: str) -> str:
    """The path of a folder without its scheme, cleaned."""
    return os.path.abspath("/" + root.split(":", 1)[1].lstrip("/") if root.startswith("file:") else root)


class LibrarySource(DataSource):
    """Options: path, recursive (true), hidden (false), extensions (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return LibraryReader(dict(self.options))


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = local_path(options["path"])
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.suffixes = tuple(f".{e}" for e in options.get("extensions", ",".join(EXTENSIONS)).lower().split(","))
        self.tasks = int(options.get("tasks", "32"))

    def partitions(self) -> list[Folders]:
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"{self.root} is not a folder that can be read")
        if not self.recursive:
            return [Folders([], [self.root])]
        # the shallowest folders are opened first; what is left unopened is walked whole by some task
        left, opened = [self.root], []
        while left and len(left) < FOLDERS:
            here, left = left, []
            for folder in here:
                opened.append(folder)
                try:
                    left += [e.path for e in os.scandir(folder) if self._is_folder(e)]
                except OSError:
                    pass  # the task that reads the folder says so
        n = max(1, min(self.tasks, len(left) + len(opened)))
        return [Folders(sorted(left)[k::n], sorted(opened)[k::n]) for k in range(n)]

    def _shown(self, name: str) -> bool:
        return self.hidden or not name.startswith(".")

    def _is_folder(self, entry: os.DirEntry) -> bool:
        return self._shown(entry.name) and entry.is_dir(follow_symlinks=False)

    def read(self, partition: Folders) -> Iterator[tuple]:
        left = [(f, False) for f in partition.plain] + [(f, True) for f in partition.whole]
        while left:
            folder, deeper = left.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as error:
                yield folder, os.path.basename(folder), None, None, f"{folder}: {error.strerror or error}"
                continue
            for entry in entries:
                try:
                    if self._is_folder(entry):
                        if deeper:
                            left.append((entry.path, True))
                    elif self._shown(entry.name) and entry.name.lower().endswith(self.suffixes) and entry.is_file(follow_symlinks=False):
                        info = entry.stat(follow_symlinks=False)
                        yield entry.path, entry.name, info.st_size, info.st_mtime_ns, None
                except OSError as error:
                    yield entry.path, entry.name, None, None, f"{entry.path}: {error.strerror or error}"
