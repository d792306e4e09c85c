"""The expander as table functions of Spark SQL.

``SELECT … FROM expand_containers(TABLE(SELECT name, content FROM roots))`` takes a whole table: arguments and rows travel as
Arrow, in batches of bounded size, and the rows are those of ``entries``.

``SELECT … FROM roots r, LATERAL expand_container(r.content, r.name) e`` goes on from each row of a query; Spark gives lateral functions their
arguments, and takes their rows, one by one. The rows are those of ``entries`` without the root's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..plans.expand import SCHEMA, Options, Walk, batches
from ..schema import ENTRIES, MAX_DEPTH

COLUMNS = [n for n in SCHEMA.names if n in ("root_path", "path", "container_path", "depth", "ordinal", "container_format", "size", "data", "metadata")]


class ExpandContainers:
    """Of a table with the columns name and content (and no others that matter)."""

    def eval(self, roots: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        walk, names, contents = Walk(Options(entry_type="all")), roots.column("name"), roots.column("content")

        def events():
            for i in range(roots.num_rows):
                root = names[i].as_py() or ""
                yield from ((root, e) for e in walk.root(root, contents[i].as_py()) if e.kind == "entry")

        for b in batches(events(), True):
            yield b.select(COLUMNS)


class ExpandContainer:
    def eval(self, content: bytes, name: str, max_depth: int = MAX_DEPTH) -> Iterator[tuple]:
        for e in Walk(Options(max_depth=max_depth, entry_type="all")).root(name or "", bytes(content) if content is not None else None):
            if e.kind == "entry":
                yield e.path, e.container_path, e.depth, e.ordinal, e.format, len(e.data), e.data, tuple(e.meta) if e.meta is not None else None


def register(spark: SparkSession, name: str = "expand_container", table: str = "expand_containers") -> None:
    spark.udtf.register(name, udtf(ExpandContainer, returnType=ENTRIES.partition(", ")[2]))
    spark.udtf.register(table, arrow_udtf(ExpandContainers, returnType=ENTRIES))
