"""Data sources for packages (EPUB and other zip files) and for whole files.

`quire_packages` reads entries of packages: a package is cut into ranges of entries of about
`rangebytes` stored bytes, one input partition each, and every task opens the package and reads
the entries of its range alone, so that no package is a row.  Conditions on book, entry and
suffix decide what is opened and unpacked at all.

`quire_files` writes rows (name, content) as files.  Tasks write to a staging folder; files get
their names when all tasks have ended, after names have been checked, and if one cannot be moved
those before it go back.  A write that fails leaves the folder as it was.

Paths are local or URIs that pyarrow's file systems know.  Defined cases: folders and entries
that are no zip file's are left out; an empty folder has no rows; of entries with one name in a
package the last counts; names may have folders but stay inside the target; null names or
contents fail the write.
"""

from __future__ import annotations

import posixpath
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyarrow import ArrowInvalid, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

ENTRIES = "book string, entry string, suffix string, size long, content binary"
#: Suffixes of packages, and stored bytes of a range of entries.
SUFFIXES, RANGE_BYTES = ".epub,.zip", 1 << 26


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


def suffix_of(name: str) -> str:
    return posixpath.splitext(name)[1].lower()


def ranges(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges [low, high) of items of at most `most` together, or of one larger item."""
    out, low, held = [], 0, 0
    for k, size in enumerate(sizes):
        if k > low and held + size > most:
            out.append((low, k))
            low, held = k, 0
        held += size
    return [*out, (low, len(sizes))] if sizes else []


class Entries(InputPartition):
    """The `part`-th of `parts` ranges of a package."""

    def __init__(self, book: str, path: str, part: int, parts: int) -> None:
        super().__init__((book, path, part, parts))
        self.book, self.path, self.part, self.parts = book, path, part, parts


@dataclass
class Wanted:
    """What pushed conditions ask of a text column: one of `values` where there are some, and all starts and ends."""

    values: set[str] | None = None
    starts: list[str] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)

    def add(self, said: Filter) -> bool:
        if isinstance(said, EqualTo | In):
            values = {said.value} if isinstance(said, EqualTo) else set(said.value)
            if not all(isinstance(v, str) for v in values):
                return False
            self.values = values if self.values is None else self.values & values
        elif isinstance(said, StringStartsWith):
            self.starts.append(said.value)
        elif isinstance(said, StringEndsWith):
            self.ends.append(said.value)
        else:
            return False
        return True

    def __call__(self, text: str) -> bool:
        return (self.values is None or text in self.values) and all(map(text.startswith, self.starts)) and all(map(text.endswith, self.ends))


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", SUFFIXES).split(","))
        self.most = int(options.get("rangebytes", RANGE_BYTES))
        self.wanted = {"book": Wanted(), "entry": Wanted(), "suffix": Wanted()}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for said in filters:
            name = ".".join(getattr(said, "attribute", ()) or ())
            if name not in self.wanted or not self.wanted[name].add(said):
                yield said

    def _books(self) -> Iterator[tuple[str, str, int]]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or not (f is info or f.path.lower().endswith(self.suffixes)):
                continue
            book = self.path if f is info else posixpath.join(self.path, posixpath.relpath(f.path, root))
            if self.wanted["book"](book):
                yield book, f.path, f.size

    def partitions(self) -> list[Entries]:
        # the ranges come from the package itself, in the task; here its size says how many there may be
        return [Entries(book, path, part, parts) for book, path, size in self._books() for parts in [max(1, -(-size // self.most))] for part in range(parts)]

    def read(self, partition: Entries) -> Iterator[tuple]:
        if not isinstance(partition, Entries):  # no package at all
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as source:
            try:
                package = zipfile.ZipFile(source)
            except (zipfile.BadZipFile, ArrowInvalid):  # the latter where a file is too short to look for an end
                return
            with package:
                infos = list({i.filename: i for i in package.infolist() if not i.is_dir()}.values())
                cuts = ranges([i.compress_size for i in infos], self.most)
                # as many ranges as partitions: what is beyond them goes round
                for low, high in cuts[partition.part :: partition.parts]:
                    for info in infos[low:high]:
                        suffix = suffix_of(info.filename)
                        if self.wanted["entry"](info.filename) and self.wanted["suffix"](suffix):
                            yield partition.book, info.filename, suffix, info.file_size, package.read(info.filename)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_packages"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackageReader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: names, and where they are staged."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("files need the columns name and content")
        self.path, self.columns, self.overwrite = options["path"], schema.names, overwrite
        self.run = uuid.uuid4().hex
        system, _, staging = self._folders()
        system.create_dir(staging, recursive=True)  # here alone: a task that outlives the write finds no folder

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        system, root = opened(self.path)
        return system, root, f"{root.rstrip('/')}/.staging-{self.run}"

    def write(self, iterator: Iterator) -> Staged:
        system, _, staging = self._folders()
        at = (self.columns.index("name"), self.columns.index("content"))
        files = []
        for row in iterator:
            name, content = row[at[0]], row[at[1]]
            if name is None or content is None:
                raise ValueError("a file without a name or content")
            clean = posixpath.normpath(name)
            if clean.startswith(("/", "..")) or clean in (".", ""):
                raise ValueError(f"not a name inside the target: {name}")
            staged = f"{staging}/{uuid.uuid4().hex}"
            with system.open_output_stream(staged) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
            files.append((clean, staged))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root, staging = self._folders()
        files = [f for m in messages if m is not None for f in m.files]
        try:
            names = [name for name, _ in files]
            twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
            if twice:
                raise ValueError(f"more than one file of a name: {twice[:5]}")
            targets = [f"{root.rstrip('/')}/{n}" for n in names]
            there = [i.path for i in system.get_file_info(targets) if i.type != fs.FileType.NotFound] if targets else []
            if there and not self.overwrite:
                raise FileExistsError(f"files that are there already: {there[:5]}")
            self._publish(system, files, targets, set(there), f"{staging}/before")
        finally:
            self._cleared(system, staging)

    def _publish(self, system: fs.FileSystem, files: list[tuple[str, str]], targets: list[str], there: set[str], before: str) -> None:
        done: list[tuple[str, str | None]] = []
        try:
            for k, ((_, staged), target) in enumerate(zip(files, targets, strict=True)):
                old = f"{before}/{k}" if target in there else None
                if old:
                    system.create_dir(before, recursive=True)
                    system.move(target, old)
                    done.append((target, old))
                system.create_dir(posixpath.dirname(target), recursive=True)
                system.move(staged, target)
                if not old:
                    done.append((target, None))
        except Exception:
            for target, old in reversed(done):
                if old:
                    system.move(old, target)
                else:
                    system.delete_file(target)
            raise

    def abort(self, messages: list[Staged | None]) -> None:
        system, _, staging = self._folders()
        self._cleared(system, staging)

    @staticmethod
    def _cleared(system: fs.FileSystem, staging: str) -> None:
        for _ in range(20):  # other tasks may still be writing
            try:
                system.delete_dir(staging)
            except FileNotFoundError:
                return
            except OSError:
                time.sleep(0.1)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let conditions reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)
    spark.dataSource.register(FileSink)


def entries(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(book, entry, suffix, size, content) of the packages under a path."""
    register(spark)
    return spark.read.format("quire_packages").options(**options).load(path)


def publish(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write (name, content) as files under a folder; all of them appear, or none."""
    register(files.sparkSession)
    files.select("name", "content").write.format("quire_files").mode("overwrite" if overwrite else "append").save(folder)
