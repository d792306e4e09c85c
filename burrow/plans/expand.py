"""The recursive expansion of containers: a walk inside a task, and the DataFrame operator made of it.

A root's whole tree is walked where its bytes are: every container is decoded once, visited depth first, and
entries leave the task in bounded Arrow batches. Bad data ends in a diagnostic row, never in a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContainerError, DepthExceeded, InvalidFormat, IoFailure, Unsupported
from ..formats import mac
from ..formats.base import Context, Item, Meta, Opened
from ..formats.detect import detect, open_as
from ..functions.paths import FORK, companion, is_sidecar, matches_prefix, sidecars
from ..schema import ENTRIES, EVENTS, MAX_DEPTH, MAX_ENTRY_BYTES, MAX_INT

#: Entries, and bytes of theirs, that leave a task at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


@dataclass(frozen=True)
class Options:
    """How a tree is walked.

    ``entry_type``: leaves, containers or all. ``prefix``: only what is the path, below it or above it (by whole
    segments; the rest isn't even decoded). ``descend``: (path, format, size, depth) -> bool, a veto for offered containers.
    ``include_data`` False leaves the bytes in the task. ``first``: a root's first entry alone; the rest isn't decoded.
    """

    max_depth: int = MAX_DEPTH
    entry_type: str = "leaves"
    prefix: str | None = None
    numeric: bool = False
    include_data: bool = True
    max_entry_bytes: int = MAX_ENTRY_BYTES
    first: bool = False
    descend: Callable[[str, str, int, int], bool] | None = None

    def wants(self, container: bool) -> bool:
        return self.entry_type == "all" or (self.entry_type == "containers") == container


@dataclass
class Event:
    kind: str
    path: str = ""
    container_path: str | None = None
    depth: int = 0
    ordinal: list[int] = field(default_factory=list)
    format: str | None = None
    data: bytes | None = None
    meta: Meta | None = None
    code: str | None = None
    message: str | None = None
    count: int | None = None


def root_code(e: ContainerError) -> str:
    if isinstance(e, IoFailure):
        return "RootOpenFailed"
    return "RootUnsupportedFormat" if isinstance(e, (Unsupported, InvalidFormat)) else "RootTraversalFailed"


class Walk:
    """``shift``: numbers in an ordinal that aren't a depth of their own, namely those that put files of a folder in order."""

    def __init__(self, options: Options, shift: int = 0):
        self.o, self.shift = options, shift

    def root(self, name: str, content: bytes | None, fork: bytes | None = None) -> Iterator[Event]:
        """Everything about one root; the root itself is never an entry."""
        try:
            if content is None:
                raise IoFailure("no content")
            if self.o.max_depth <= 0:
                raise DepthExceeded
            kind = detect(name, content)
            if kind is None and mac.has_ndif(fork):
                kind = "Hfs"
            opened = open_as(kind, content, Context(name, self.o.numeric, lambda n: fork if n == FORK else None))
        except ContainerError as e:
            yield Event("diag", name, code=root_code(e), message=str(e))
        else:
            yield Event("root", name, format=kind, count=opened.count)
            yield from self.container(opened, name, self.o.max_depth, [], True)
        if fork and mac.is_fork(fork) and self.o.entry_type in ("leaves", "all"):
            yield from self.native_fork(name, fork)

    def native_fork(self, name: str, fork: bytes) -> Iterator[Event]:
        """The fork that the file system keeps beside a root, and its resources, after all else."""
        path = f"{name}/{FORK}"
        if self.o.prefix is None or matches_prefix(path, self.o.prefix):
            yield Event("entry", path, name, 1, [MAX_INT], None, fork)
        try:
            found = mac.open_fork(fork, Context(path, self.o.numeric)).items
        except ContainerError as e:
            yield Event("diag", name, code="ResourceForkTraversalFailed", message=str(e))
            return
        for i, r in enumerate(found):
            at = f"{path}/{r.path}"
            if self.o.prefix is None or matches_prefix(at, self.o.prefix):
                yield Event("entry", at, path, 2, [MAX_INT, i], None, r.data)

    def container(self, opened: Opened, prefix: str, left: int, above: list[int], is_root: bool = False) -> Iterator[Event]:
        for i, item in enumerate(opened.items):
            yield from self.entry(opened, item, prefix, left, [*above, i])
        if opened.failure:
            yield Event("diag", prefix, code="RootTraversalFailed" if is_root else "NestedContainerTraversalFailed", message=opened.failure)

    def entry(self, opened: Opened, item: Item, prefix: str, left: int, ordinal: list[int]) -> Iterator[Event]:
        path, data, meta = f"{prefix}/{item.path}", item.data, item.meta
        if self.o.prefix is not None and not matches_prefix(path, self.o.prefix):
            return
        if len(data) > self.o.max_entry_bytes:
            yield Event("diag", path, code="NestedContainerOpenFailed", message=f"Decompression error: more than {self.o.max_entry_bytes} bytes")
            return

        def sibling(name: str) -> bytes | None:
            return opened.siblings.get(name.lower())

        fork = None
        if is_sidecar(path) and mac.is_appledouble(data):
            of = companion(item.path)
            if of is not None and sibling(of) is not None:
                return
        elif opened.siblings:
            beside = mac.sidecar(next((x for x in map(sibling, sidecars(item.path)) if x is not None), None))
            if beside:
                fork = beside.fork
                if beside.type_code is not None and beside.creator_code is not None:
                    meta = (meta or Meta()).typed(beside.type_code, beside.creator_code)
        fork_path = f"{path}/{FORK}"
        kind = detect(path, data)
        if kind is None and (mac.has_ndif(sibling(fork_path)) or mac.has_ndif(fork)):
            kind = "Hfs"
        owner = f"{prefix}/{item.owner}" if item.owner else prefix
        depth = len(ordinal) - self.shift
        go = True
        if self.o.wants(kind is not None):
            yield Event("entry", path, owner, depth, ordinal, kind, data, meta)
            if kind is not None and self.o.descend is not None:
                go = self.o.descend(path, kind, len(data), depth)
        if go and kind is not None and left > 1:
            try:
                inner = open_as(kind, data, Context(path, self.o.numeric, lambda n: (fork if fork is not None else sibling(fork_path)) if n == FORK else None))
            except ContainerError as e:
                yield Event("diag", path, code="NestedContainerOpenFailed", message=str(e))
            else:
                yield from self.container(inner, path, left - 1, ordinal)
        if fork is not None and kind != "Hfs":
            # after the nested entries; whatever entries are asked for, and not descended into
            yield Event("entry", fork_path, owner, depth, [*ordinal, MAX_INT], detect(fork_path, fork), fork)


SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("root_path", pa.string()),
        ("path", pa.string()),
        ("container_path", pa.string()),
        ("depth", pa.int32()),
        ("ordinal", pa.list_(pa.int32())),
        ("container_format", pa.string()),
        ("size", pa.int64()),
        ("data", pa.binary()),
        ("metadata", pa.struct([("compression_method", pa.string()), ("compression_level", pa.string()), ("mode", pa.string()), ("type_code", pa.binary()), ("creator_code", pa.binary())])),
        ("seq", pa.int32()),
        ("code", pa.string()),
        ("message", pa.string()),
        ("entry_count", pa.int64()),
    ]
)


def batches(events: Iterable[tuple[str, Event]], include_data: bool) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size; diagnostics of a root are numbered."""
    rows: list[dict] = []
    size, seq, now = 0, 0, None
    for root, e in events:
        if root != now:
            now, seq = root, 0
        entry, diag = e.kind == "entry", e.kind == "diag"
        rows.append(
            {
                "kind": e.kind,
                "root_path": root,
                "path": e.path,
                "container_path": e.container_path,
                "depth": e.depth if entry else None,
                "ordinal": e.ordinal if entry else None,
                "container_format": e.format,
                "size": len(e.data) if entry else None,
                "data": e.data if entry and include_data else None,
                "metadata": e.meta._asdict() if e.meta is not None else None,
                "seq": seq if diag else None,
                "code": e.code,
                "message": e.message,
                "entry_count": e.count,
            }
        )
        seq += diag
        size += len(e.data) if entry and include_data else 0
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def expand(roots: DataFrame, options: Options = Options(), name: str = "name", content: str = "content", fork: str = "resource_fork", make: Callable[[dict], tuple[str, bytes]] | None = None) -> DataFrame:  # noqa: B008
    """All events (see ``EVENTS``) of the roots in ``name`` and ``content`` (and ``resource_fork``, if there is such a column).

    ``make``: gives name and content of the root that a row stands for, one at a time in the task that expands it, so that bytes of
    roots don't travel.
    """
    has_fork = make is None and fork in roots.columns

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(options)

        def events() -> Iterator[tuple[str, Event]]:
            for b in found:
                for i in range(b.num_rows):  # one root's bytes at a time
                    if make is None:
                        root, raw = b.column(0)[i].as_py() or "", b.column(1)[i].as_py()
                    else:
                        root, raw = make(b.slice(i, 1).to_pylist()[0])
                    for e in walk.root(root, raw, b.column(2)[i].as_py() if has_fork else None):
                        yield root, e
                        if options.first and e.kind == "entry":
                            break

        yield from batches(events(), options.include_data)

    return (roots if make else roots.select(name, content, *[fork] * has_fork)).mapInArrow(run, EVENTS)


def entries(events: DataFrame) -> DataFrame:
    return events.where("kind = 'entry'").select(*[c.split()[0] for c in ENTRIES.split(", ") if c.split()[0] in events.columns])


def diagnostics(events: DataFrame) -> DataFrame:
    return events.where("kind = 'diag'").select("root_path", "seq", "code", "path", "message")


def reports(events: DataFrame) -> DataFrame:
    """A row per root: its format, the entries offered, and the diagnostics in order."""
    entry, leaf = F.col("kind") == "entry", F.col("container_format").isNull()
    found = F.array_sort(F.collect_list(F.when(F.col("kind") == "diag", F.struct("seq", "code", "path", "message"))))
    out = events.groupBy("root_path").agg(
        F.max(F.when(F.col("kind") == "root", F.col("path"))).alias("root_container_path"),
        F.max(F.when(F.col("kind") == "root", F.col("container_format"))).alias("root_format"),
        F.count_if(entry).alias("visited_entries"),
        F.count_if(entry & leaf).alias("visited_leaves"),
        F.count_if(entry & ~leaf).alias("visited_containers"),
        found.alias("found"),
    )
    return out.select(*[c for c in out.columns if c != "found"], F.transform("found", lambda d: F.struct(d["code"].alias("code"), d["path"].alias("path"), d["message"].alias("message"))).alias("diagnostics"))


def container_info(events: DataFrame) -> DataFrame:
    """path, format and number of stored entries of the roots that open."""
    return events.where("kind = 'root'").select("root_path", "path", F.col("container_format").alias("format"), "entry_count")
