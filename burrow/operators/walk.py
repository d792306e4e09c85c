"""Listings over entries: walk, listdir, first leaf, roll-ups of diagnostics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.expand import Options, Walk

WALK = "root_path string, dirpath string, dirnames array<string>, filenames array<string>, seq int"


def groups(rows: Iterable[tuple[str, str, bool]]) -> Iterator[tuple[str, list[str], list[str]]]:
    """Containers of rows (container, name, is_container) in visiting order; each leaves when a row comes that is neither its own nor below it."""
    stack: list[str] = []
    held: dict[str, tuple[list[str], list[str]]] = {}
    for container, name, inner in rows:
        while stack and stack[-1] != container and not container.startswith(stack[-1] + "/"):
            done = stack.pop()
            if done in held:
                yield done, *held.pop(done)
        if not stack or stack[-1] != container:
            stack.append(container)
        held.setdefault(container, ([], []))[0 if inner else 1].append(name)
    while stack:
        done = stack.pop()
        if done in held:
            yield done, *held.pop(done)


def walk(entries: DataFrame, topdown: bool = True) -> DataFrame:
    """A row per container that has entries: names of containers and of leaves, in visiting order.

    ``seq`` is the order in which they come: bottom-up as they are done with, top-down the exact reverse. ``entries``: of all types,
    without data. One root's names are brought together; bytes stay where they are.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ordinal"])
        found = list(groups((r["container_path"], r["name"], r["inner"]) for r in rows))
        if topdown:
            found.reverse()
        root = rows[0]["root_path"] if rows else None
        return pa.table(
            {
                "root_path": pa.array([root] * len(found), pa.string()),
                "dirpath": pa.array([f[0] for f in found], pa.string()),
                "dirnames": pa.array([f[1] for f in found], pa.list_(pa.string())),
                "filenames": pa.array([f[2] for f in found], pa.list_(pa.string())),
                "seq": pa.array(range(len(found)), pa.int32()),
            }
        )

    rows = entries.select("root_path", "container_path", "ordinal", C.name().alias("name"), F.col("container_format").isNotNull().alias("inner"))
    return rows.groupBy("root_path").applyInArrow(run, WALK)


def walk_roots(roots: DataFrame, options: Options = Options(), topdown: bool = True) -> DataFrame:  # noqa: B008
    """``walk`` of the roots in name and content, inside the tasks that decode them: entries come in visiting order there, so nothing is shuffled.

    A root's rows are held until it is done with top-down, and leave one by one bottom-up.
    """
    every = replace(options, entry_type="all", include_data=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Walk(every)
        for b in batches:
            for i in range(b.num_rows):
                root = b.column(0)[i].as_py() or ""
                events = (e for e in one.root(root, b.column(1)[i].as_py()) if e.kind == "entry")
                found = groups((e.container_path, e.path.rpartition("/")[2], e.format is not None) for e in events)
                rows = list(found)[::-1] if topdown else found
                out: list[tuple] = []
                for seq, (path, inner, names) in enumerate(rows):
                    out.append((root, path, inner, names, seq))
                    if len(out) >= 1000:
                        yield table(out)
                        out = []
                if out:
                    yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["root_path", "dirpath", "dirnames", "filenames", "seq"])

    return roots.select("name", "content").mapInArrow(run, WALK)


def listdir(entries: DataFrame, path: str | None = None) -> DataFrame:
    """Last components of what is right inside ``path``, in order, copies and all; without a path, of what is right inside each root."""
    here = entries.where(F.col("container_path") == (F.lit(path) if path is not None else F.col("root_path")))
    names = F.array_sort(F.collect_list(F.struct("root_path", "ordinal", C.name().alias("name"))))
    listed = F.transform(names, lambda x: x["name"]).alias("names")
    return here.agg(listed) if path is not None else here.groupBy("root_path").agg(listed)


def first_leaf(entries: DataFrame) -> DataFrame:
    """The first leaf of each root: of a root's leaves one leaves each task. ``Options.first`` doesn't even decode the others."""
    leaves = entries.where(F.col("container_format").isNull())
    first = leaves.groupBy("root_path").agg(F.min_by(F.struct(*[c for c in entries.columns if c != "root_path"]), "ordinal").alias("first"))
    return first.select("root_path", "first.*").select(*entries.columns)


def ordered(entries: DataFrame) -> DataFrame:
    """In visiting order."""
    return entries.orderBy("root_path", "ordinal")


def rollup(reports: DataFrame, most: int = 5) -> DataFrame:
    """Per root: the first root failure, the number of recoverable diagnostics and the first few of them as text."""
    rest = F.filter("diagnostics", lambda d: ~C.is_root_failure(d["code"]))
    fatal = F.filter("diagnostics", lambda d: C.is_root_failure(d["code"]))

    def shown(d):
        return F.concat(F.lit("["), d["code"], F.lit("] "), d["path"], F.lit(": "), d["message"])

    more = F.when(F.size(rest) > most, F.array(F.concat(F.lit("… and "), (F.size(rest) - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return reports.select("root_path", F.try_element_at(F.transform(fatal, shown), F.lit(1)).alias("failure"), F.size(rest).alias("warnings"), F.concat(F.slice(F.transform(rest, shown), 1, most), more).alias("first"))


def report_text() -> Column:
    """``path: n entries (…)`` of a row of reports."""
    from ..schema import FORMATS

    names = F.create_map(*[F.lit(x) for f in FORMATS for x in (f.variant, f.name)])
    base = F.format_string("%s: %s entries (%s leaves, %s containers)", F.col("root_path"), F.col("visited_entries"), F.col("visited_leaves"), F.col("visited_containers"))
    kind = F.when(F.col("root_format").isNotNull(), F.concat(F.lit(", format="), F.try_element_at(names, F.col("root_format")))).otherwise("")
    n = F.size("diagnostics")
    return F.concat(base, kind, F.when(n > 0, F.format_string(", %s diagnostic(s)", n)).otherwise(""))
