"""Connected components of an edge table, and those of links that a search finds inside candidate components.

Components come from alternating large-star and small-star steps: each sends every node's neighbours to the smallest one
(large-star: the larger neighbours; small-star: the smaller ones), which takes a partial aggregate and a join, whatever a
node's degree. Each step's edges are written to the shared folder, so that a lost executor costs one step at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, lean, partitions, save

#: One of so many items of a large group is in all of its tasks.
PIVOTS = 8
#: search(item, mask of the wanted) -> places of those of the wanted that link with the item
Search = Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Edges from which on nodes with very many neighbours are looked after: below, all of one node's fit into any task.
MANY = 1 << 20


def star(edges: DataFrame, large: bool, count: int = 0) -> DataFrame:
    """``edges``: a > b. Large-star looks at both directions, small-star at the smaller neighbours alone.

    With more than MANY of them, what the nodes with over an eighth of a task's share of edges need to know is broadcast; there
    are sixteen such nodes for each task at most.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"), "n")
    known, here = least.drop("n"), F.col("a") == F.col("_a")
    if count > MANY:
        hubs = least.where(F.col("n") > max(MANY >> 3, count // (8 * partitions(edges.sparkSession)))).drop("n")
        joined = both.join(F.broadcast(hubs), here).unionByName(both.join(F.broadcast(hubs.select("_a")), here, "left_anti").join(known, here))
    else:
        joined = both.join(known, here)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(known.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """node and root (the smallest node of its component) for every node that isn't a root itself. ``edges``: a and b (long)."""
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), label)
    mark, count = None, now.count()
    while True:
        # done when a round changes nothing: then only stars around the smallest nodes are left
        new = save(star(star(now, True, count), False, count), label)
        drop_saved(now)
        now = new
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if tuple(sums) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, count = tuple(sums), sums[0]


class Union:
    def __init__(self, n: int):
        self.root, self.members = np.arange(n), {}

    def join(self, a: int, b: int) -> int:
        """Relabels the smaller side; the root that stays."""
        a, b = int(self.root[a]), int(self.root[b])
        if a != b:
            x, y = self.members.pop(a, [a]), self.members.pop(b, [b])
            if len(x) < len(y):
                a, x, y = b, y, x
            self.root[y] = a
            x.extend(y)
            self.members[a] = x
        return a


def local_roots(search: Search, items: list[np.ndarray]) -> np.ndarray:
    """Of each item a representative of its component among these items."""
    union, anchor = Union(len(items)), -1
    for q, s in enumerate(items if len(items) > 1 else ()):
        # the anchor is chosen once and its component followed through merges: of a link, either both ends are in it
        # at last, or one is searched
        if anchor >= 0 and union.root[q] == union.root[anchor]:
            continue
        for x in search(s, union.root != union.root[q]).tolist():
            r = union.join(q, x)
            if anchor < 0 and 4 * len(union.members[r]) >= len(items):
                anchor = q
    return union.root


def grouped(df: DataFrame, keys: list[str], into: int, kind: str, run, schema: str) -> DataFrame:
    """``run(group key, node list, role list, items)`` for each group, one at a time. ``kind``: the numbers that an item's data hold."""

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for *k, node, role, data in zip(*(some.column(c).to_pylist() for c in (*keys, "node", "role", "data")), strict=True):
                    if k != now:
                        if rows:
                            yield run(now, *zip(*rows, strict=True))
                        now, rows = k, []
                    if not rows or (rows[-1][0], rows[-1][1]) != (node, role):  # a copy
                        rows.append((node, role, np.frombuffer(data, kind)))
        if rows:
            yield run(now, *zip(*rows, strict=True))

    return df.repartition(into, *keys).sortWithinPartitions(*keys, "role", "node").select(*keys, "node", "role", "data").mapInArrow(lean(stream), schema)


def linked(group: DataFrame, data: DataFrame, kind: str, index: Callable[[list[np.ndarray]], Search], limit: int, into: int) -> DataFrame:
    """node and root of the nodes whose component, by the links that searches find, has another root.

    ``group``: node, root of its candidate component and n, its size (saved). ``data``: node and data (bytes of numbers of ``kind``), copies
    and other nodes among them. ``index(items)`` gives a search over some items. Each candidate component is brought together
    once. One beyond ``limit`` is dealt over several tasks that share some of its items as pivots; what stays outside its largest
    part then is searched against all its items, block by block.
    """
    total = group.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("nodes"))
    tasks = F.ceil(F.col("total") / limit).cast("int")
    total = total.select(F.col("root").alias("_root"), tasks.alias("tasks"), F.greatest(F.floor(F.col("nodes") / PIVOTS), F.lit(1)).alias("_of"))
    placed = group.join(total, F.col("root") == F.col("_root")).drop("_root", "n")
    salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.col("tasks").cast("long")).cast("int")
    pivot = F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("_of")) == 0
    everywhere = F.sequence(F.lit(0), F.col("tasks") - 1)
    placed = placed.withColumn("salts", F.when((F.col("tasks") > 1) & pivot, everywhere).otherwise(F.array(salt)))
    items = data.join(placed, "node")
    large = total.where("tasks > 1").count()
    if large:
        items = save(items, "items")

    def connect(key: list, node: tuple, role: tuple, data: tuple) -> pa.RecordBatch:
        roots = local_roots(index(list(data)), list(data))
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(node), pa.int64()), pa.array(node, pa.int64()), pa.array([node[r] for r in roots], pa.int64())], names=["root", "node", "rep"])

    dealt = items.select("root", F.explode("salts").alias("salt"), "node", F.lit(0).alias("role"), "data")
    links = save(grouped(dealt, ["root", "salt"], into, kind, connect, "root long, node long, rep long"), "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("rep").alias("b")), "linked")
    if not large:
        return roots
    # of the dealt groups: what is outside the largest part against all of the group
    big = items.where("tasks > 1").select(F.col("root").alias("grp"), "node", "tasks", "data")
    part = save(big.select("grp", "node", "tasks").distinct().join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "parts")
    by_part = part.groupBy("grp", "part").agg(F.count("*").alias("n"))
    most = by_part.groupBy("grp").agg(F.max(F.struct("n", "part")).alias("most"))
    outside = part.join(most, "grp").where("part != most.part").select("grp", "node", "part", "tasks")
    blocks = outside.groupBy("grp").agg(F.count("*").alias("out")).join(total.select(F.col("_root").alias("grp"), (F.col("_of") * PIVOTS).alias("have"), F.col("tasks").alias("t")), "grp")
    blocks = blocks.select("grp", F.greatest(F.lit(1), F.ceil(F.col("out") * F.col("t") / F.col("have"))).cast("int").alias("blocks"))
    found = big.join(part.select("node", "part"), "node").join(blocks, "grp")
    here = found.select("grp", F.pmod(F.xxhash64("node", F.lit("salt")), F.col("tasks").cast("long")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", F.lit(0).alias("role"), "data", "part")
    asks = found.join(outside.select("node"), "node", "left_semi")
    asks = asks.select("grp", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks").cast("long")).cast("int").alias("block"), "node", F.lit(1).alias("role"), "data", "part")

    def ask(key: list, node: tuple, role: tuple, data: tuple) -> pa.RecordBatch:
        k = role.index(1) if 1 in role else len(role)
        a, b = [], []
        if 0 < k < len(role):
            search, names = index(list(data[:k])), np.array(node[:k], np.int64)
            for q, s in zip(node[k:], data[k:], strict=True):
                for x in search(s, names != q).tolist():
                    a.append(q)
                    b.append(node[x])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    more = grouped(here.unionByName(asks), ["grp", "salt", "block"], into, kind, ask, "a long, b long")
    return components(links.select(F.col("node").alias("a"), F.col("rep").alias("b")).unionAll(more), "linked")
