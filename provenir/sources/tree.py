"""Object trees as a sink: one file per object at its mirrored path, published as a whole or not at all.

``object_tree`` is a batch sink. Its tasks write into a folder beside the tree, each file under a name of the attempt first
and moved once it is complete; when all tasks are done, the driver swaps the folders. A job that fails leaves the old tree
as it was, and so does a driver that dies: the swap's one step in which no tree stands is undone by the next publication.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from provenir.functions.scalar import safe_file_name
from provenir.operators.history import tree_diff
from provenir.operators.parse import render
from provenir.storage import cut

#: Files that a task reads or writes, about, and folders that one lists; tasks at most; and bytes of files that are handed to Spark at once.
FILES_A_TASK, FOLDERS_A_TASK, TASKS, BATCH_BYTES = 2_000, 16, 10_000, 8 << 20


def mirrored_path(server: Column, database: Column, kind: Column, schema: Column, name: Column, extension: str = "sql") -> Column:
    """``server/database/type/[schema/]name.extension`` with file names made safe; a blank schema has no folder."""
    folder = F.when(F.trim(schema) != "", safe_file_name(schema))
    return F.concat(F.concat_ws("/", safe_file_name(server), safe_file_name(database), safe_file_name(kind), folder, safe_file_name(name)), F.lit(f".{extension}"))


def object_tree(objects: DataFrame) -> DataFrame:
    """(path, text): a file for each of ``objects`` (server, database, type, schema, name, definition), as :func:`publish` takes it."""
    of = {c: F.col(c) for c in ("server", "database", "type", "schema", "name")}
    called = F.concat_ws(".", F.nullif(F.trim("schema"), F.lit("")), "name")
    text = render(of["server"], of["database"], of["type"], called, F.coalesce("definition", F.lit("")))
    return objects.select(mirrored_path(*of.values()).alias("path"), text.alias("text"))


def snapshot_tree(snapshots: DataFrame, *fields: str) -> DataFrame:
    """(path, text): the ``fields`` of each table's snapshot as JSON, at the table's path with ``.json``; null fields stay."""
    of = [F.col(c) for c in ("server", "database", "type", "schema", "name")]
    return snapshots.select(mirrored_path(*of, extension="json").alias("path"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("text"))


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^\w+:/", root):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _exists(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def _restored(files: fs.FileSystem, base: str) -> None:
    """Undo a swap that stopped between its two moves."""
    if not _exists(files, base) and _exists(files, f"{base}.old"):
        files.move(f"{base}.old", base)


def _swept(files: fs.FileSystem, base: str) -> None:
    """Delete what tasks of failed jobs wrote after their job had cleaned up."""
    for info in files.get_file_info(fs.FileSelector(posixpath.dirname(base) or ".", allow_not_found=True)):
        if posixpath.basename(info.path).startswith(f"{posixpath.basename(base)}.new-"):
            files.delete_dir(info.path)


def _checked(path: str) -> str:
    """A relative path that stays inside the tree."""
    parts = path.split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path inside the tree: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class TreeWriter(DataSourceWriter):
    """Writes (path, text) rows into ``<root>.new-<job>`` and swaps it for ``<root>`` at the end."""

    def __init__(self, root: str, columns: list[str]):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex
        self.at = columns.index("path"), columns.index("text")

    def write(self, iterator: Iterator) -> Written:
        files, base = _opened(self.root)
        n = size = 0
        known = set()
        attempt = uuid.uuid4().hex
        files.create_dir(f"{base}.new-{self.job}/part", recursive=True)
        for row in iterator:
            data = (row[self.at[1]] or "").encode()
            target = f"{base}.new-{self.job}/tree/{_checked(row[self.at[0]])}"
            folder = posixpath.dirname(target)
            if folder not in known:
                files.create_dir(folder, recursive=True)
                known.add(folder)
            part = f"{base}.new-{self.job}/part/{attempt}"
            with files.open_output_stream(part) as out:
                out.write(data)
            files.move(part, target)
            n, size = n + 1, size + len(data)
        return Written(n, size)

    def commit(self, messages: list) -> None:
        files, base = _opened(self.root)
        staged = f"{base}.new-{self.job}"
        files.create_dir(f"{staged}/tree", recursive=True)  # a tree without objects is empty
        _restored(files, base)
        if _exists(files, f"{base}.old"):
            files.delete_dir(f"{base}.old")
        if _exists(files, base):
            files.move(base, f"{base}.old")
        files.move(f"{staged}/tree", base)
        for done in (f"{base}.old", staged):
            if _exists(files, done):
                files.delete_dir(done)

    def abort(self, messages: list) -> None:
        files, base = _opened(self.root)
        if _exists(files, f"{base}.new-{self.job}"):
            files.delete_dir(f"{base}.new-{self.job}")


class ObjectTree(DataSource):
    """``df.write.format("object_tree").mode("overwrite").save(root)`` for a frame with ``path`` and ``text``."""

    @classmethod
    def name(cls) -> str:
        return "object_tree"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        if not overwrite:
            raise ValueError("a tree is replaced as a whole: use mode('overwrite')")
        return TreeWriter(self.options["path"], schema.names)


@dataclass(frozen=True)
class Published:
    """What a publication changed; nothing was written where ``changed`` is false."""

    changed: bool
    added: int
    removed: int
    modified: int


def _entries(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what a folder holds; of a local one, entry by entry."""
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((e.path, e.is_dir()) for e in found)
    else:
        yield from ((e.path, e.type == fs.FileType.Directory) for e in files.get_file_info(fs.FileSelector(folder)))


def _listed(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path) of all files below ``base``, listed level by level in tasks: the driver sees no file's name, as it would where Spark's readers list."""

    def listed(batches):
        files, _ = _opened(root)
        entries = ((path, is_folder) for b in batches for folder in b.column("path").to_pylist() for path, is_folder in _entries(files, folder))
        while piece := list(islice(entries, FILES_A_TASK)):
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in piece], "folder": [f for _, f in piece]})

    level, found = spark.createDataFrame([(base, True)], "path string, folder boolean"), []
    while True:
        folders = level.filter("folder").select("path")
        n = folders.count()
        if not n:
            return reduce(DataFrame.unionByName, found)
        tasks = min(TASKS, n // FOLDERS_A_TASK + 1)
        level = cut(folders.repartition(tasks).mapInArrow(listed, "path string, folder boolean"), "listing")
        found.append(level.filter("not folder").select("path"))


def _read(found: DataFrame, root: str, base: str) -> DataFrame:
    """(path below ``base``, content) of listed files, read in tasks; a batch holds few files or bytes."""

    def read(batches):
        files, _ = _opened(root)
        paths, contents, size = [], [], 0
        piece = lambda: pa.RecordBatch.from_pydict({"path": paths, "content": pa.array(contents, pa.binary())})
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            with files.open_input_stream(path) as file:
                contents.append(file.read())
            paths.append(path[len(base) + 1 :])
            size += len(contents[-1])
            if len(paths) >= FILES_A_TASK or size >= BATCH_BYTES:
                yield piece()
                paths, contents, size = [], [], 0
        if paths:
            yield piece()

    tasks = min(TASKS, found.count() // FILES_A_TASK + 1)
    return found.repartition(tasks).mapInArrow(read, "path string, content binary")


def _digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("text", 256).alias("hash"))


def current_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the published tree; none where nothing is published yet."""
    files, base = _opened(root.rstrip("/"))
    _restored(files, base)
    if not _exists(files, base):
        return spark.createDataFrame([], "path string, text string")
    found = _listed(spark, root.rstrip("/"), base)
    return _read(found, root.rstrip("/"), base).select("path", F.col("content").cast("string").alias("text"))


def publish(objects: DataFrame, root: str, *, order: Column | None = None) -> Published:
    """Replace the tree at ``root`` by ``objects`` (path, text): dropped objects' files go too. No difference, no write.

    Where several objects have one path, as safe file names may collide, the last by ``order`` (by default, the greatest
    text) is the file. A null or empty text is a file of one line end, as Spark's readers skip files without bytes; a null path, or one that leaves the tree, fails before anything is
    replaced. ``root`` is a folder that all executors reach, or a URI that Arrow's file systems know. One publication of a
    tree runs at a time.
    """
    spark = objects.sparkSession
    _swept(*_opened(root.rstrip("/")))
    text = F.coalesce(F.nullif("text", F.lit("")), F.lit("\n"))
    one = objects.groupBy("path").agg(F.max_by(text, text if order is None else order).alias("text"))
    changes = tree_diff(_digests(current_tree(spark, root)), _digests(one)).groupBy("status").count()
    n = {r["status"]: r["count"] for r in changes.collect()}  # four rows at most
    told = Published(any(n.get(s) for s in ("added", "removed", "modified")), *(n.get(s, 0) for s in ("added", "removed", "modified")))
    if told.changed:
        total = sum(n.get(s, 0) for s in ("added", "modified", "unchanged"))
        spark.dataSource.register(ObjectTree)
        tasks = min(TASKS, total // FILES_A_TASK + 1)
        one.repartitionByRange(tasks, "path").sortWithinPartitions("path").write.format("object_tree").mode("overwrite").save(root)
    return told
