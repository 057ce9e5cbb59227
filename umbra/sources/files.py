"""A Spark data source of files and of the members of zip archives: planned over both, pruned before anything is read.

    spark.dataSource.register(Files)
    spark.read.format("umbra_files").option("include", "*.py,*.csv").load("/corpus")
    spark.readStream.format("umbra_files").load("/corpus")  # files as they come

Rows: path (of a member: archive!/member), kind, body, language, size. kind is "text" (body is the text), "schema" (a data set,
of which only the first line is read), "binary" (base64) or "blocked" (not UTF-8, or an archive that can't be read; no body).
Files are dealt into partitions of about partitionBytes by what of them will be read: a data set counts as its header. Of an
archive only the directory at its end is read for planning; a large archive's members go to several partitions.

Options: include, exclude (shell patterns of the path below the root, by commas; * crosses slashes), partitionBytes (64 MB),
headerBytes (the most that is read of a data set's first line, 1 MB), settle (seconds that a file must be old before a stream
takes it, 2). Paths are local or mounted, or what pyarrow.fs opens.
"""

from __future__ import annotations

import base64
import fnmatch
import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from umbra.operators.abstraction import EXTENSIONS
from umbra.sources.readers import BINARY, DATASET

SCHEMA = "path string, kind string, body string, language string, size long"


@dataclass
class Part(InputPartition):
    """What a task reads: (file, member or None, size)."""

    items: list[tuple[str, str | None, int]]


def extension(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


class Tree:
    """The files below a root and how they are read."""

    def __init__(self, options: dict[str, str]) -> None:
        at = {k.lower(): v for k, v in dict(options).items()}
        self.root = at["path"]
        self.patterns = [[p.strip() for p in at.get(name, otherwise).split(",") if p.strip()] for name, otherwise in (("include", "*"), ("exclude", ""))]
        self.most, self.header, self.settle = int(at.get("partitionbytes", 64 << 20)), int(at.get("headerbytes", 1 << 20)), float(at.get("settle", 2))

    def opened(self):
        """The file system, and the root in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def wanted(self, path: str) -> bool:
        include, exclude = self.patterns
        return any(fnmatch.fnmatchcase(path, p) for p in include) and not any(fnmatch.fnmatchcase(path, p) for p in exclude)

    def found(self, after: int = -1, until: int | None = None) -> Iterator[tuple[str, str | None, int]]:
        """What will be read, in order of path; after, until: of the files changed then (nanoseconds) only."""
        from pyarrow import fs

        system, root = self.opened()
        base = root.rstrip("/")
        for f in sorted(system.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda f: f.path):
            if f.type != fs.FileType.File or (f.mtime_ns or 0) <= after or (until is not None and (f.mtime_ns or 0) > until):
                continue
            below = f.path[len(base) + 1 :]
            if extension(below) != "zip":
                if self.wanted(below):
                    yield f.path, None, f.size
                continue
            try:
                with system.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                    members = [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
            except (zipfile.BadZipFile, OSError, ValueError):  # no archive, or one that is cut off
                if self.wanted(below):
                    yield f.path, None, 0
                continue
            yield from ((f.path, name, size) for name, size in members if self.wanted(f"{below}!/{name}") or self.wanted(name))

    def parts(self, after: int = -1, until: int | None = None) -> list[Part]:
        out, held = [Part([])], 0
        for path, member, size in self.found(after, until):
            cost = min(size, 4096) if extension(member or path) in DATASET else size
            if out[-1].items and held + cost > self.most:
                out.append(Part([]))
                held = 0
            out[-1].items.append((path, member, size))
            held += cost
        return out

    def rows(self, part: Part) -> Iterator[tuple]:
        system, _ = self.opened()
        archive, z, raw = None, None, None
        try:
            for path, member, size in part.items:
                name = path if member is None else f"{path}!/{member}"
                language = EXTENSIONS.get("." + extension(name))
                if member is None:
                    if extension(path) == "zip":
                        yield name, "blocked", None, language, size
                        continue
                    with system.open_input_file(path) as stream:
                        yield (name, *self.shown(name, stream), language, size)
                    continue
                if archive != path:
                    if z is not None:
                        z.close()
                        raw.close()
                    raw = system.open_input_file(path)
                    archive, z = path, zipfile.ZipFile(raw)
                try:
                    with z.open(member) as stream:
                        yield (name, *self.shown(name, stream), language, size)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):  # damaged, encrypted, an unknown method
                    yield name, "blocked", None, language, size
        finally:
            if z is not None:
                z.close()
                raw.close()

    def shown(self, name: str, stream) -> tuple[str, str | None]:
        """kind and body of an open file; of a data set no more is read than its first line needs."""
        kind = extension(name)
        if kind in BINARY:
            return "binary", base64.b64encode(stream.read()).decode("ascii")
        if kind in DATASET:
            line = b""
            while b"\n" not in line and len(line) < self.header and (more := stream.read(min(4096, self.header - len(line)))):
                line += more
            line = line.partition(b"\n")[0]
        else:
            line = stream.read()
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError:
            return "blocked", None
        return ("schema", text.strip(" ")) if kind in DATASET else ("text", text)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.tree = Tree(options)

    def partitions(self) -> list[Part]:
        return self.tree.parts()

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.tree.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Files by the time of their last change: each batch has those after the last one's; a file that changes comes again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.tree = Tree(options)

    def initialOffset(self) -> dict:
        return {"after": -1}

    def latestOffset(self) -> dict:
        return {"after": int((time.time() - self.tree.settle) * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [p for p in self.tree.parts(start["after"], end["after"]) if p.items]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.tree.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "umbra_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
