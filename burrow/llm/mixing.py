"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed up by membership pattern (the set of sources they belong to). On the driver, word capacity flows
from the patterns to the sources' quotas; each further copy of a pattern's words costs more than the one before
(convex), so a pattern repeats only when quotas can't be met otherwise. Patterns then give whole copies to all their
documents and one copy more to documents in the order of a seeded hash, up to the words still wanted. The driver
sees one row per pattern (sources are a bounded vocabulary), never one per document.

Edge cases: a null text has size 0 and is taken 0 times its size; a null source is a source of its own, after all
others; an array of sources counts each source once and an empty one is a pattern that no quota takes words from.
Rows with equal ids share one decision, and so do rows without an id of one size (``repeated``: rows with equal id and text do). Empty
tables give empty results. Extra columns pass through ``assign`` and ``repeated``, whatever they are called, and stay unread.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named

#: Weights dealt to the sources in the order of their names, and the most copies of a document.
WEIGHTS, MOST_COPIES = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
SEED = 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pattern_key(members: Column) -> Column:
    """A pattern as JSON: sorted, each source once."""
    return F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"})


def unit() -> Column:
    """What is decided on as one, as text: the rows of an id."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("size").cast("string")))


def draw(name: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def targets(sizes: dict, weights: dict, most: int = MOST_COPIES) -> dict:
    """All words shared by weight; no source gets over ``most`` times its size, the excess goes to the others by weight."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        rate = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if rate * weights[s] > most * sizes[s]}
        for s in full or open_:
            out[s] = float(most * sizes[s]) if full else rate * weights[s]
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


@dataclass
class Network:
    """Min-cost flow by cheapest augmenting paths with potentials."""

    edges: list = field(default_factory=list)  # to, room, cost
    at: dict = field(default_factory=dict)

    def add(self, a: object, b: object, room: int, cost: int) -> int:
        for frm, to, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.at.setdefault(frm, []).append(len(self.edges))
            self.at.setdefault(to, [])
            self.edges.append([to, r, c])
        return len(self.edges) - 2

    def used(self, e: int) -> int:
        return self.edges[e ^ 1][1]

    def push(self, s: object, t: object) -> None:
        height = dict.fromkeys(self.at, 0)
        while True:
            cost, via, seen, k, todo = {s: 0}, {}, set(), 0, [(0, 0, s)]
            while todo:
                d, _, a = heapq.heappop(todo)
                if a in seen:
                    continue
                seen.add(a)
                for e in self.at[a]:
                    b, room, c = self.edges[e]
                    new = d + c + height[a] - height[b]
                    if room > 0 and new < cost.get(b, float("inf")):
                        cost[b], via[b], k = new, e, k + 1
                        heapq.heappush(todo, (new, k, b))
            if t not in cost:
                return
            for a, d in cost.items():
                height[a] += d
            path, a = [], t
            while a != s:
                path.append(via[a])
                a = self.edges[via[a] ^ 1][0]
            room = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= room
                self.edges[e ^ 1][1] += room


def route(pattern_sizes: dict[tuple, int], quota: dict, most: int = MOST_COPIES) -> dict[tuple, int]:
    """Words that each pattern gives, all copies together; the k-th copy costs k."""
    net, given = Network(), {}
    net.add("start", "end", 0, 0)
    for s, q in quota.items():
        net.add(("source", s), "end", int(q + 0.5), 0)
    for p, n in pattern_sizes.items():
        given[p] = [net.add("start", ("pattern", p), n, k + 1) for k in range(most)]
        for s in p:
            net.add(("pattern", p), ("source", s), most * n, 0)
    net.push("start", "end")
    return {p: sum(map(net.used, es)) for p, es in given.items()}


def plan(docs: DataFrame, members: Column, weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, decide: Column | None = None) -> DataFrame:
    """One row per pattern: key, its sources' size and target (of the first source), copies for all, and the last draw that gets one more.

    ``docs`` needs doc_id and size (long). ``decide``: a text; rows that share it are taken together.
    """
    spark = docs.sparkSession
    rows = docs.select(pattern_key(members).alias("key"), "size", draw(unit() if decide is None else decide, seed).alias("h"))
    sums = rows.groupBy("key", F.substring("h", 1, 3).alias("cell")).agg(F.sum("size").alias("words"))
    cells = sums.withColumn("before", F.sum("words").over(Window.partitionBy("key").orderBy("cell")) - F.col("words"))
    per = {r["key"]: int(r["n"] or 0) for r in sums.groupBy("key").agg(F.sum("words").alias("n")).collect()}
    patterns = {k: tuple(json.loads(k)) for k in per if k is not None}
    sizes: dict = {}
    for k, p in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + per[k]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    quota = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, most)
    flow = route({p: per[k] for k, p in patterns.items()}, quota, most)
    table = []
    for k, n in per.items():
        p = patterns.get(k, ())
        whole, more = divmod(flow.get(p, 0), n) if n else (0, 0)
        table.append((k, sizes.get(p[0], 0) if p else 0, quota.get(p[0], 0.0) if p else 0.0, whole, more))
    out = spark.createDataFrame(table, "key string, source_size long, target double, copies long, more long")
    cut = cells.join(F.broadcast(out), "key").where("more > before and more <= before + words").select("key", "cell", "before", "more")
    # of each pattern only the documents of one cell of 4096 are put in order
    edge = rows.withColumn("cell", F.substring("h", 1, 3)).join(F.broadcast(cut), ["key", "cell"]).groupBy("key", "h").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("more").alias("more"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("h")) - F.col("size")
    last = edge.withColumn("upto", upto).where("2 * upto + size <= 2 * more").groupBy("key").agg(F.max("h").alias("last_h"))
    found = cut.join(last, "key", "left").select("key", F.col("cell").alias("last_cell"), "last_h")
    return spark.createDataFrame(out.join(found, "key", "left").collect(), out.schema.add("last_cell", "string").add("last_h", "string"))


def _assigned(docs: DataFrame, members: Column, planned: DataFrame, seed: int, decide: Column | None) -> DataFrame:
    """The columns by number (c0, c1, ...) and a struct ``mix``."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], pattern_key(members).alias("key"), draw(unit() if decide is None else decide, seed).alias("h"))
    p = F.broadcast(planned.select(F.col("key").alias("of"), F.struct(*[c for c in planned.columns if c != "key"]).alias("plan")))
    cell = F.substring("h", 1, 3)
    more = (cell < F.col("plan.last_cell")) | ((cell == F.col("plan.last_cell")) & (F.col("h") <= F.col("plan.last_h")))
    out = rows.join(p, F.col("key") == F.col("of"), "left")
    copies = F.coalesce(F.col("plan.copies"), F.lit(0)) + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    return out.withColumn("mix", F.struct(F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), copies.alias("copies")))


def assign(docs: DataFrame, members: Column, planned: DataFrame, seed: int = SEED, decide: Column | None = None) -> DataFrame:
    """``docs`` with a struct ``_mix`` (last): source_size, target and copies of its document."""
    return named(_assigned(docs, members, planned, seed, decide), docs.columns, F.col("mix").alias("_mix"))


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of documents (doc_id, text, source and any other columns), each as often as the mix takes it."""
    decide = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), decide.alias("decide"))
    planned = plan(sized, F.array("source"), seed=seed, decide=F.col("decide"))
    out = _assigned(docs, F.array("source"), planned, seed, decide).where("mix.copies > 0")
    return named(out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))), docs.columns)
