"""A repository as a data source: folders are listed by tasks, and what globs or filters rule out is never entered or opened.

`spark.read.format("repository")` takes the options root (a path or URI that all executors reach), include and ignore
(globs, one a line) and content ("false" leaves files unopened). Columns: path below the root, size, content. Filters on
path (equality, IN, prefix, suffix, part) are pushed into the listing when spark.sql.python.filterPushdown.enabled is set,
as `scan` does; a prefix keeps it to the folders on its way. The driver lists folders breadth-first only until there are
enough for the tasks, at most FANOUT, and the tasks list what lies below theirs. Unreadable files have the content ''.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

FANOUT, BATCH_BYTES = 64, 8 << 20


def glob_to_regex(glob: str) -> str:
    """** spans folders, * and ? stay in one, {a,b} is a choice."""
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\{[^}]*\}|[^*?{]+", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or ("(?:" + "|".join(map(re.escape, part[1:-1].split(","))) + ")" if part[0] == "{" else re.escape(part))
    return f"^{out}$"


@dataclass(frozen=True)
class Selection:
    """Which paths are wanted, and which folders may hold some."""

    include: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    exact: tuple[str, ...] | None = None
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    def wants(self, path: str) -> bool:
        if self.exact is not None and path not in self.exact:
            return False
        if not (all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends)) and all(p in path for p in self.parts)):
            return False
        hit = lambda globs: any(re.match(glob_to_regex(g), path) for g in globs)
        return (not self.include or hit(self.include)) and not hit(self.ignore)

    def enters(self, folder: str) -> bool:
        """Whether a wanted path can lie below the folder: no glob ignores all of it, and no fixed beginning leads elsewhere."""
        if any(g.endswith("/**") and re.match(glob_to_regex(g[:-3]), folder) for g in self.ignore):
            return False
        below = folder + "/"
        leads = lambda fixed: fixed.startswith(below) or below.startswith(fixed)
        if not all(map(leads, self.starts)) or (self.exact is not None and not any(p.startswith(below) for p in self.exact)):
            return False
        return not self.include or any(leads(re.split(r"[*?{]", g, maxsplit=1)[0]) for g in self.include)


def listed(fs: pafs.FileSystem, root: str, folder: str, chosen: Selection) -> tuple[list[str], list[tuple[str, int]]]:
    """Folders to enter and files (path, size) wanted, of one folder; both below root, by name."""
    folders, files = [], []
    for info in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{folder}".rstrip("/"))), key=lambda i: i.path):
        path = f"{folder}/{info.base_name}".lstrip("/")
        if info.type == pafs.FileType.Directory and chosen.enters(path):
            folders.append(path)
        elif info.type == pafs.FileType.File and chosen.wants(path):
            files.append((path, info.size))
    return folders, files


def walked(fs: pafs.FileSystem, root: str, folders: Iterable[str], chosen: Selection) -> Iterator[tuple[str, int]]:
    """The wanted files below some folders."""
    todo = list(folders)[::-1]
    while todo:
        deeper, files = listed(fs, root, todo.pop(), chosen)
        yield from files
        todo += deeper[::-1]


@dataclass
class Share(InputPartition):
    """Folders for a task to list, and files that the driver came by."""

    folders: list[str] = field(default_factory=list)
    files: list[tuple[str, int]] = field(default_factory=list)


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.opens = options.get("content", "true") != "false"
        globs = {k: tuple(filter(None, options.get(k, "").split("\n"))) for k in ("include", "ignore")}
        self.chosen = Selection(**globs)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        held = dict(vars(self.chosen))
        for f in filters:
            kind = {StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "parts"}.get(type(f))
            if getattr(f, "attribute", None) != ("path",):
                yield f
            elif kind:
                held[kind] = (*held[kind], f.value)
            elif isinstance(f, EqualTo | In):
                named = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
                held["exact"] = named if held["exact"] is None else tuple(p for p in held["exact"] if p in named)
            else:
                yield f
        self.chosen = Selection(**held)

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        fs, path = pafs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + self.root.removeprefix("file:"))
        return fs, path.rstrip("/")

    def partitions(self) -> list[Share]:
        fs, root = self._fs()
        folders, files = listed(fs, root, "", self.chosen)
        while folders and len(folders) < FANOUT:
            deeper: list[str] = []
            for f in folders:
                below, found = listed(fs, root, f, self.chosen)
                deeper += below
                files += found
            folders = deeper
        shares = [Share() for _ in range(min(FANOUT, max(1, len(folders) + len(files))))]
        for i, f in enumerate(folders):
            shares[i % len(shares)].folders.append(f)
        for i, f in enumerate(files):
            shares[i % len(shares)].files.append(f)
        return shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, root = self._fs()
        rows: list[tuple[str, int, str]] = []
        held = 0
        for path, size in (*partition.files, *walked(fs, root, partition.folders, self.chosen)):
            content = ""
            if self.opens:
                try:
                    with fs.open_input_stream(f"{root}/{path}") as f:
                        content = f.read().decode("utf-8", "replace")
                except OSError:
                    content = ""
            rows.append((path, size, content))
            held += len(content) + 100
            if held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    path, size, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(content, pa.string())], names=["path", "size", "content"])


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, size long, content string"

    def reader(self, schema: object) -> RepositoryReader:
        return RepositoryReader(dict(self.options))

