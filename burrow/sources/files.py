"""Files as roots: single files, globs, folders, and paths that go on inside an archive."""

from __future__ import annotations

import os
from dataclasses import replace
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats.base import Item, Opened
from ..functions.paths import FORK
from ..plans.expand import Event, Options, Walk, batches
from ..schema import EVENTS
from ..scratch import save


class VirtualPath(NamedTuple):
    archive: str
    internal: str | None


def _status(spark: SparkSession, path: str) -> str | None:
    """file, folder, or None; through Hadoop, so that any store will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    return "file" if fs.getFileStatus(at).isFile() else "folder"


def split_virtual_path(spark: SparkSession, path: str) -> VirtualPath:
    """At the first prefix that is a file; the rest goes on inside it. ``.`` and ``..`` don't take part in the probe."""
    scheme, colon, rest = path.partition("://")
    head, rest = (f"{scheme}://", rest) if colon else ("", path)
    root = "/" if rest.startswith("/") else ""
    parts = [p for p in rest.split("/") if p not in ("", ".", "..")]
    for i in range(1, len(parts) + 1):
        prefix = head + root + "/".join(parts[:i])
        if _status(spark, prefix) == "file":
            return VirtualPath(prefix, "/".join(parts[i:]) or None)
    return VirtualPath(path, None)


def plain(path: Column) -> Column:
    """Without the ``file:`` that Spark puts in front."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_files(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """name, content and length of files; pushed-down filters on length and pruned content are Spark's own."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(list(paths)).select(plain(F.col("path")).alias("name"), "content", "length")


def order_of(parts: list[str]) -> list[int]:
    """Numbers that sort like a list of names: the code points of each name, and a zero behind it."""
    return [x for p in parts for x in (*map(ord, p), 0)]


def _hidden(name: str) -> bool:
    """What Spark's own listing passes over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _below(folder: str):
    """Name, whether it is a folder, and length of what is in a folder, one after another."""
    from .datasource import located

    store, inner, _ = located(folder)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(inner) as found:
            for e in found:
                if not _hidden(e.name):
                    try:
                        yield e.name, e.is_dir(), e.stat().st_size
                    except FileNotFoundError:  # gone meanwhile, or a link to nothing
                        continue
        return
    for i in store.get_file_info(fs.FileSelector(inner)):
        if not _hidden(i.base_name):
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0


LISTED = "folder string, name string, inner boolean, length long"
#: Names that leave a task at a time, and bytes and files that one task reads.
LIST_ROWS, PART_BYTES, PART_FILES = 10_000, 64 << 20, 2000


def _list(batches):
    def batch(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.int64())], names=["folder", "name", "inner", "length"])

    for b in batches:
        for folder in b.column(0).to_pylist():
            rows = []
            for x in _below(folder):
                rows.append((folder, *x))
                if len(rows) == LIST_ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def listed_files(spark: SparkSession, base: str, depth: int) -> DataFrame:
    """name and length of the files below a folder. Tasks list it, a level of folders at a time, into saved tables: no names come to the driver."""
    folders, files = spark.createDataFrame([(base,)], "folder string"), None
    for _ in range(depth):
        level = save(folders.mapInArrow(_list, LISTED), "listing")
        path = F.concat(F.col("folder"), F.lit("/"), F.col("name"))
        here = level.where("not inner").select(path.alias("name"), "length")
        files = here if files is None else files.unionByName(here)
        folders = level.where("inner").select(path.alias("folder"))
        n = folders.count()
        if not n:
            break
        folders = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    return files


def read_folder(spark: SparkSession, base: str, depth: int) -> DataFrame:
    """name and content of the files below a folder; through Spark's own reader, whose driver lists them, in stores that only Spark opens."""
    from .datasource import located

    try:
        located(_qualified(spark, base))
    except (pa.ArrowException, ValueError, OSError):
        return read_files(spark, base, recursive=True).select("name", "content")
    files = listed_files(spark, base, depth)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, min(n, 2 * spark.sparkContext.defaultParallelism), n // PART_FILES, size // PART_BYTES)

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                store, inner, _ = located(name)
                with store.open_input_file(inner) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([_local(name)]), pa.array([f.read()], pa.binary())], names=["name", "content"])

    return files.select("name").repartition(int(parts)).mapInArrow(run, "name string, content binary")


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def expand_folder(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The events of a folder as a container: files in the order of their paths, each expanded in the task that reads it.

    An entry's ``ordinal`` starts with its file's name in numbers, so that files are in order without being counted: no bytes are
    shuffled, and tasks list the folder.
    """
    base = path.rstrip("/")
    files = read_folder(spark, base, options.max_depth)
    skip = len(_local(base)) + 1

    def run(found):
        def events():
            for b in found:
                for i in range(b.num_rows):
                    name = b.column(0)[i].as_py()
                    parts = name[skip:].split("/")
                    if len(parts) > options.max_depth:
                        continue
                    folder, _, leaf = name.rpartition("/")
                    one, at = Opened([Item(leaf, b.column(1)[i].as_py() or b"")], 1), order_of(parts)
                    for e in Walk(options, len(at) - 1).entry(one, one.items[0], folder, options.max_depth - len(parts) + 1, at):
                        yield base, e
                        if options.first and e.kind == "entry":
                            break

        yield from batches(events(), options.include_data)

    root = spark.createDataFrame([(base,)], "name string").mapInArrow(lambda found: batches(((base, Event("root", base, format="Directory")) for b in found for _ in range(b.num_rows)), False), EVENTS)
    return root.unionByName(files.mapInArrow(run, EVENTS))


def _local(path: str) -> str:
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


def native_fork(path: str) -> bytes | None:
    """The resource fork that a file system keeps with a local file, if it keeps such things."""
    if "://" in path:
        return None
    try:
        with open(f"{_local(path)}/{FORK}", "rb") as f:
            return f.read() or None
    except OSError:
        return None


def expand_path(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The events of a file, a folder, or a path inside an archive; a missing file is a root failure."""
    from ..plans.expand import expand

    found = split_virtual_path(spark, path)
    if found.internal is not None:
        options = replace(options, prefix=f"{found.archive}/{found.internal}")
    kind = _status(spark, found.archive)
    if kind == "folder":
        return expand_folder(spark, found.archive, options)
    if kind is None:
        row = (found.archive, None)
        return spark.createDataFrame([row], "name string, content binary").mapInArrow(_missing(found.archive), EVENTS)
    roots = read_files(spark, found.archive).withColumn("name", F.lit(found.archive))
    fork = native_fork(found.archive)
    if fork is not None:
        roots = roots.withColumn("resource_fork", F.lit(bytearray(fork)))
    return expand(roots, options)


def _missing(path: str):
    def run(found: list[pa.RecordBatch]):
        for b in found:
            if b.num_rows:
                yield from batches([(path, Event("diag", path, code="RootOpenFailed", message=f"I/O error: No such file or directory: {path}"))], False)

    return run
