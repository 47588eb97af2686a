"""``epub``: a Spark data source for works exported as EPUB archives, reading and writing.

    register(spark)
    spark.read.format("epub").load(folder)           # (path, document, name, xhtml), documents in the order of the archive
    documents.write.format("epub").save(folder)      # an archive for each path

Archives are listed on the driver, folder by folder, by their names and sizes; tasks open them. A partition is archives of a bounded
size together, their names packed; a large archive is read by several tasks, each a share of its documents. Equality filters on ``path`` are
applied to the listing, those on ``name`` to the tables of contents, before any document is read. Archives are written into folders by a hash
of their names, so that no folder has them all. Files are found and opened through ``pyarrow.fs``, which has local, HDFS and object stores.

Defined results: members that are no (X)HTML are passed over; bytes that are no UTF-8 are replaced; an empty archive or folder has no
rows; a file that is no archive fails the read, with its name.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

SCHEMA = "path string, document int, name string, xhtml string"
_DOCUMENT = re.compile(r"\.x?html?$")
#: A partition has about this many bytes of documents.
PARTITION_BYTES = 16 << 20
#: Opening an archive counts as so many bytes more; documents are so many times larger than in the archive, about.
OPENING_BYTES, PACKED = 64 << 10, 4
#: Archives are written into so many folders; what a task has not committed is in one with this beginning.
FOLDERS, HIDDEN = 256, "_temporary-"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class Archives(InputPartition):
    """Some archives of a folder, by name; or a share, one of several, of the documents of a large one."""

    folder: str
    packed: bytes
    share: int
    shares: int

    def __init__(self, folder: str, names: list[str], share: int = 0, shares: int = 1):
        super().__init__(0)
        self.folder, self.packed, self.share, self.shares = folder, zlib.compress("\n".join(names).encode()), share, shares

    @property
    def names(self) -> list[str]:
        return zlib.decompress(self.packed).decode().split("\n")


def _archives(store: fs.FileSystem, root: str) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Each folder at a path with its archives' (name, bytes) in order; one folder's are held at a time."""
    about = store.get_file_info(root)
    if about.type == fs.FileType.File:
        yield posixpath.dirname(root), [(posixpath.basename(root), about.size)] if root.endswith(".epub") else []
        return
    folders = [root]
    while folders:
        folder = folders.pop()
        found = store.get_file_info(fs.FileSelector(folder))
        folders += sorted((f.path for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(HIDDEN)), reverse=True)
        yield folder, sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".epub"))


class EpubReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", "")
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("path",), ("name",)) and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Archives]:
        store, root = _opened(self.root)
        out: list[Archives] = []
        for folder, found in _archives(store, root):
            some, size = [], 0
            for name, packed in found:
                if self.wanted.get("path", name) != name:
                    continue
                shares = -(-packed * PACKED // self.size)
                if shares > 1:
                    out += [Archives(folder, [name], i, shares) for i in range(shares)]
                    continue
                some.append(name)
                size += OPENING_BYTES + packed * PACKED
                if size >= self.size:
                    out.append(Archives(folder, some))
                    some, size = [], 0
            if some:
                out.append(Archives(folder, some))
        return out

    def read(self, partition: Archives) -> Iterator[tuple]:
        if not isinstance(partition, Archives):  # Spark reads an empty listing as one partition of nothing
            return
        store, _ = _opened(self.root)
        for name in partition.names:
            path = posixpath.join(partition.folder, name)
            try:
                with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
                    documents = [m for m in archive.infolist() if _DOCUMENT.search(m.filename)]
                    whole, before = sum(m.file_size for m in documents) or 1, 0
                    for i, m in enumerate(documents):
                        # a document is in the share in which it begins
                        share = min(before * partition.shares // whole, partition.shares - 1)
                        before += m.file_size
                        if share == partition.share and self.wanted.get("name", m.filename) == m.filename:
                            yield name, i, m.filename, archive.read(m).decode("utf-8", "replace")
            except zipfile.BadZipFile as e:
                raise ValueError(f"{path} is no archive") from e


@dataclass
class Written(WriterCommitMessage):
    """The folder in which a task has left its archives, None if it had none."""

    folder: str | None


class EpubWriter(DataSourceWriter):
    """Tasks write into folders of their own; the commit moves the archives of the tasks that count to their places."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator) -> Written:
        store, root = _opened(self.root)
        hidden = f"{root}/{HIDDEN}{uuid.uuid4().hex}"
        now, archive, raw = None, None, None
        try:
            for row in iterator:
                if row["path"] != now:
                    if archive:
                        archive.close()
                        raw.close()
                    else:
                        store.create_dir(hidden)
                    now = row["path"]
                    raw = store.open_output_stream(f"{hidden}/{now}")
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(row["name"]), row["xhtml"] or "")
        finally:
            if archive:
                archive.close()
                raw.close()
        return Written(hidden if archive else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.root)
        store.create_dir(root)
        if self.overwrite:
            for folder, found in _archives(store, root):
                if folder == root or re.fullmatch(r"[0-9a-f]{2}", posixpath.basename(folder)):
                    for name, _ in found:
                        store.delete_file(f"{folder}/{name}")
        # archives that others have put beside the folders give way to those of the same name
        beside = {f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
        made: set[str] = set()
        for hidden in (m.folder for m in messages if m and m.folder):
            for file in store.get_file_info(fs.FileSelector(hidden)):
                folder = f"{root}/{zlib.crc32(file.base_name.encode()) % FOLDERS:02x}"
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                store.move(file.path, f"{folder}/{file.base_name}")
                if file.base_name in beside:
                    store.delete_file(f"{root}/{file.base_name}")
            store.delete_dir(hidden)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.root)
        for hidden in (m.folder for m in messages if m and m.folder):
            store.delete_dir(hidden)


class EpubSource(DataSource):
    """See the module. Rows to write come sorted by path, then document, within a task; a path must not be in two tasks."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EpubReader:
        return EpubReader(self.options)

    def writer(self, schema, overwrite: bool) -> EpubWriter:
        return EpubWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpubSource)
