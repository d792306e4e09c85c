"""The user's way in: a loader to build a query with, and the four functions that need no builder."""

from __future__ import annotations

import io
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import expand as X
from ..schema import BY_VARIANT, MAX_DEPTH
from ..sources.files import expand_path
from . import walk as W


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@dataclass(frozen=True)
class Loader:
    """One file, folder, virtual path, or bytes with a name; or, by ``of``, any number of roots in a DataFrame."""

    path: str | None = field(default=None, kw_only=True)
    data: bytes | None = field(default=None, kw_only=True)
    name: str | None = field(default=None, kw_only=True)
    roots: DataFrame | None = field(default=None, kw_only=True)
    options: X.Options = field(default=X.Options(), kw_only=True)
    path_prefix: str | None = field(default=None, kw_only=True)
    extensions: tuple[str, ...] | None = field(default=None, kw_only=True)

    def __post_init__(self) -> None:
        if self.roots is not None:
            return
        if self.path is not None and self.data is not None:
            raise ValueError("Cannot specify both path and data")
        if self.path is None and self.data is None:
            raise ValueError("Either path or data must be provided")
        if self.data is not None and self.name is None:
            raise ValueError("name is required when loading from data")

    @classmethod
    def of(cls, roots: DataFrame) -> Loader:
        """Roots in the columns name and content (and resource_fork)."""
        return cls(roots=roots)

    def _with(self, **options) -> Loader:
        return replace(self, options=replace(self.options, **options))

    def with_max_depth(self, depth: int) -> Loader:
        return self._with(max_depth=depth)

    def with_numeric_identifiers(self, on: bool = True) -> Loader:
        return self._with(numeric=on)

    def with_entry_type(self, kind: str) -> Loader:
        return self._with(entry_type=kind)

    def with_path_filter(self, target: str) -> Loader:
        """By whole segments; what can't match isn't decoded."""
        return self._with(prefix=target)

    def with_descend(self, rule: Callable[[str, str, int, int], bool]) -> Loader:
        return self._with(descend=rule)

    def with_mmap_strategy(self, strategy: str) -> Loader:
        """Accepted for callers' sake: Spark reads files its own way."""
        return self

    def with_first(self) -> Loader:
        """The first entry of each root (of each file of a folder) alone; what comes after it isn't decoded."""
        return self._with(first=True)

    def without_data(self) -> Loader:
        return self._with(include_data=False)

    def filter_path(self, prefix: str) -> Loader:
        """By plain prefix of the whole path."""
        return replace(self, path_prefix=prefix)

    def filter_extension(self, extensions: list[str]) -> Loader:
        """Without dots, in either case."""
        return replace(self, extensions=tuple(extensions))

    def events(self) -> DataFrame:
        if self.roots is not None:
            return X.expand(self.roots, self.options)
        if self.data is not None:
            return X.expand(session().createDataFrame([(self.name, bytearray(self.data))], "name string, content binary"), self.options)
        return expand_path(session(), self.path, self.options)

    def entries(self) -> DataFrame:
        out = X.entries(self.events())
        if self.path_prefix is not None:
            out = out.where(F.startswith("path", F.lit(self.path_prefix)))
        if self.extensions is not None:
            out = out.where(F.lower(C.extension()).isin([e.lower() for e in self.extensions]))
        return out

    def diagnostics(self) -> DataFrame:
        return X.diagnostics(self.events())

    def report(self) -> DataFrame:
        return X.reports(self.without_data().events())

    def info(self) -> DataFrame:
        return X.container_info(self.without_data().with_max_depth(1).events())

    def __iter__(self) -> Iterator[Row]:
        """Leaves in visiting order, one partition at a time."""
        return W.ordered(self.entries()).toLocalIterator(prefetchPartitions=True)


def _fail_or_warn(report: Row) -> None:
    bad = [d for d in report["diagnostics"] if d["code"] in C.ROOT_CODES]
    if bad:
        raise FileNotFoundError(f"[{bad[0]['code']}] {bad[0]['path']}: {bad[0]['message']}")
    if report["diagnostics"]:
        d = report["diagnostics"][0]
        warnings.warn(f"{len(report['diagnostics'])} recoverable problem(s); first: [{d['code']}] {d['path']}: {d['message']}", RuntimeWarning, stacklevel=3)


def open(path: str, *, max_depth: int = MAX_DEPTH) -> io.BytesIO:  # noqa: A001
    """The first leaf as a file object with ``path`` and ``metadata``."""
    row = W.ordered(Loader(path=path).with_max_depth(max_depth).with_first().entries()).limit(1).collect()
    if not row:
        raise FileNotFoundError(path)
    out = EntryFile(bytes(row[0]["data"] or b""))
    out.path, out.container_path, out.metadata = row[0]["path"], row[0]["container_path"], row[0]["metadata"]
    return out


class EntryFile(io.BytesIO):
    path: str
    container_path: str
    metadata: Row | None


def walk(path: str, *, max_depth: int = MAX_DEPTH, topdown: bool = True) -> Iterator[Row]:
    loader = Loader(path=path).with_max_depth(max_depth).with_entry_type("all").without_data()
    _fail_or_warn(loader.report().first())
    return iter(W.walk(loader.entries(), topdown).orderBy("seq").select("dirpath", "dirnames", "filenames").collect())


def listdir(path: str) -> list[str]:
    loader = Loader(path=path).with_max_depth(1).with_entry_type("all").without_data()
    _fail_or_warn(loader.report().first())
    return W.listdir(loader.entries(), path).first()["names"]


def detect_format(path: str) -> str | None:
    """The format of a path that opens; None for all else."""
    row = Loader(path=path).info().first()
    return row["format"] if row else None


def format_code(variant: str) -> int:
    return BY_VARIANT.get(variant, BY_VARIANT["Unknown"]).py_code
