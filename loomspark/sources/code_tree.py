"""A data source of code trees that lists directories in tasks, leaves out what is pruned before opening it, and takes filters.

    spark.dataSource.register(CodeTree)
    spark.read.format("code_tree").load(root)

Rows are (rel_path, size_bytes, modified, content).  Directories that are ignored, and paths that are tests, are never entered or opened.
Options: `ignore` (further patterns, one a line), `tests` ("true" keeps test paths), `content` ("false" leaves it null and opens nothing).
Filters on rel_path (equal, begins with) and size_bytes are held against the listing; Spark hands them down where
spark.sql.python.filterPushdown.enabled is set.  The root may be in any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from loomspark.functions.paths import DEFAULT_IGNORES

#: Directories of so many levels below the root are dealt to tasks of their own.
DEALT_LEVELS = 2
_SIZE = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


@dataclass
class Subtree(InputPartition):
    """A directory below the root; if not deep, only its own files."""

    folder: str
    deep: bool

    def __post_init__(self) -> None:
        self.value = self.folder


class CodeTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return "rel_path string, size_bytes long, modified timestamp, content binary"

    def reader(self, schema: object) -> CodeTreeReader:
        o = self.options
        return CodeTreeReader(o["path"], o.get("ignore", "").split("\n"), o.get("tests", "false").lower() == "true", o.get("content", "true").lower() == "true")


class CodeTreeReader(DataSourceReader):
    def __init__(self, root: str, ignore: list[str], tests: bool, content: bool) -> None:
        self.root, self.tests, self.content = root.rstrip("/"), tests, content
        self.patterns = [*DEFAULT_IGNORES, *filter(None, ignore)]
        self.begins: list[str] = []
        self.sizes: list[tuple[type, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Keep what the listing can tell; hand back the rest."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("rel_path",) and isinstance(f, StringStartsWith):
                self.begins.append(f.value)
            elif column == ("size_bytes",) and type(f) in _SIZE:
                self.sizes.append((type(f), f.value))
            else:
                if column == ("rel_path",) and isinstance(f, EqualTo):
                    self.begins.append(f.value)  # prunes; Spark still compares
                yield f

    def system(self) -> tuple[object, str]:
        """The file system, and the root's path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def left_out(self, rel: str, folder: bool) -> bool:
        if not self.tests and "test" in rel.lower():
            return True
        if folder and any(p.endswith("/**") and f"/{rel}/".endswith(f"/{p[:-3]}/") for p in self.patterns):
            return True
        if any(fnmatch.fnmatchcase(rel + "/" if folder else rel, p) for p in self.patterns):
            return True
        # a folder may hold what is asked for if one of both begins the other
        return not all(rel.startswith(b) or (folder and b.startswith(rel + "/")) for b in self.begins)

    def listed(self, system: object, base: str, folder: str) -> Iterator[tuple[str, object]]:
        """(rel_path, information) of what a directory holds and is not left out, by name."""
        from pyarrow import fs

        for info in sorted(system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))), key=lambda x: x.base_name):
            rel = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type in (fs.FileType.File, fs.FileType.Directory) and not self.left_out(rel, info.type == fs.FileType.Directory):
                yield rel, info

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = self.system()
        out, level = [], [""]
        for _ in range(DEALT_LEVELS):
            out += [Subtree(folder, False) for folder in level]
            level = [rel for folder in level for rel, info in self.listed(system, base, folder) if info.type == fs.FileType.Directory]
        return out + [Subtree(folder, True) for folder in level]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, base = self.system()
        todo = [partition.folder]
        while todo:
            for rel, info in self.listed(system, base, todo.pop()):
                if info.type == fs.FileType.Directory:
                    if partition.deep:
                        todo.append(rel)
                elif all(_SIZE[kind](info.size, value) for kind, value in self.sizes):
                    data = None
                    if self.content:
                        with system.open_input_stream(f"{base}/{rel}") as f:
                            data = f.read()
                    yield rel, info.size, info.mtime, data
