"""The other way to expand: level by level, so that one huge root's containers are opened in parallel.

Each level is one pass over the containers that the level before found, which are saved (their bytes, not the leaves'): a container
is opened once to find those inside it and once for its rows, however deep it lies. Siblings matter within a container alone, so
sidecars are dealt with there. Rows equal those of ``expand``, but for disk images whose map is in a fork beside them: those need ``expand``.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContainerError
from ..formats.base import Context
from ..formats.detect import open_as
from ..schema import EVENTS
from ..scratch import save
from .expand import Event, Options, Walk, batches, entries
from .expand import expand as whole


def opened(containers: DataFrame, options: Options) -> DataFrame:
    """Entries of all types right inside the containers (root_path, path, container_format, data, ordinal)."""

    def run(found):
        walk = Walk(options)

        def events():
            for b in found:
                for i in range(b.num_rows):
                    root, path, kind, data, above = (b.column(k)[i].as_py() for k in range(5))
                    try:
                        inner = open_as(kind, data or b"", Context(path, options.numeric))
                    except ContainerError as e:
                        yield root, Event("diag", path, code="NestedContainerOpenFailed", message=str(e))
                        continue
                    for e in walk.container(inner, path, 1, above):
                        yield root, e

        yield from batches(events(), True)

    return entries(containers.select("root_path", "path", "container_format", "data", "ordinal").mapInArrow(run, EVENTS))


def expand(roots: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Entries of ``roots`` (name, content): the first level like ``expand`` with a depth of 1, then container by container."""
    every = replace(options, entry_type="all", max_depth=1, include_data=True)
    levels = [entries(whole(roots, every))]
    for _ in range(options.max_depth - 1):
        containers = levels[-1].where("container_format is not null").select("root_path", "path", "container_format", "data", "ordinal")
        containers = save(containers, "level")
        if containers.isEmpty():
            break
        levels.append(opened(containers, every))
    out = reduce(DataFrame.unionByName, levels)
    if options.entry_type != "all":
        out = out.where(F.col("container_format").isNull() == F.lit(options.entry_type == "leaves"))
    return out
