"""``spark.read.format("containers").load(path)``: entries of files as a data source of Spark.

Files are listed and read through pyarrow's file systems (local, HDFS, S3, GCS), small ones together in a partition. Filters on ``path`` (a prefix or an equal value) are taken over: the expander doesn't decode what can't match.
Spark asks for that only while ``spark.sql.python.filterPushdown.enabled`` is on; ``register`` switches it on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..plans.expand import Options, Walk, batches
from ..schema import ENTRIES, MAX_DEPTH

COLUMNS = [c.split()[0] for c in ENTRIES.replace(f", metadata {ENTRIES.split('metadata ')[1]}", ", metadata x").split(", ")]


class ContainerSource(DataSource):
    """Options: path (a file, a folder or a glob, with or without a scheme), max_depth, entry_type, numeric, include_data."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(dict(self.options))


#: Bytes and files of a partition, if it has more than one file.
PART_BYTES, PART_FILES = 64 << 20, 1000


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path inside it, and what comes before that in the caller's way to name files."""
    if "://" not in path and not path.startswith("file:/"):
        return fs.LocalFileSystem(), path, ""
    whole = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    store, inner = fs.FileSystem.from_uri(whole)
    return store, inner, whole[: len(whole) - len(inner)] if whole.endswith(inner) else ""


def listed(path: str) -> list[tuple[str, int]]:
    """Files and their sizes: one, those below a folder, or those that a pattern (``*``, ``**``, ``?``, ``[…]``) names."""
    wild = re.search(r"[*?\[]", path)
    base = path[: wild.start()].rpartition("/")[0] or "/" if wild else path
    store, inner, before = located(base)
    top = store.get_file_info(inner)
    if top.type == fs.FileType.File:
        return [(path, top.size)]
    if top.type == fs.FileType.NotFound:
        return []
    found = [(before + i.path, i.size) for i in store.get_file_info(fs.FileSelector(inner, recursive=True)) if i.type == fs.FileType.File]
    return sorted(f for f in found if not wild or PurePosixPath(f[0]).full_match(path))


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.prefix, self.plain = options, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """An equal path or a prefix that ends a segment narrows the walk; all filters are checked again by Spark, which prefixes by characters."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                if isinstance(f, EqualTo):
                    self.prefix = f.value
                elif isinstance(f, StringStartsWith):
                    self.prefix = f.value.rpartition("/")[0] or None
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[FilePartition] = []
        size = 0
        for path, n in listed(self.options["path"]):
            if not out or size + n > PART_BYTES or len(out[-1].paths) >= PART_FILES:
                out.append(FilePartition([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        o = self.options
        data = o.get("include_data", "true").lower() == "true"
        walk = Walk(Options(int(o.get("max_depth", MAX_DEPTH)), o.get("entry_type", "leaves"), self.prefix, o.get("numeric", "false").lower() == "true", data))

        def found():
            for path in partition.paths:
                store, inner, _ = located(path)
                with store.open_input_file(inner) as f:
                    content = f.read()
                yield from ((path, e) for e in walk.root(path, content) if e.kind == "entry")

        for b in batches(found(), data):
            yield b.select(COLUMNS)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerSource)
