"""N-gram Jaccard join: T-occurrence search with DivideSkip, and the components of its links.

Two texts link if the Jaccard similarity of their sets of word shingles is at least LEAST (as a fraction of integers, so
that nothing is rounded). Texts with equal sets are one node.

1. Shingles are counted in a table of hashed cells of fixed size; the counts only order the shingles, rare ones first.
2. A set of n shingles posts its first n - T + k ones (T = least overlap of any partner, k = 1 + n / EXTRA): sets that link
   share at least min(k) of them. Each posting list goes to one task.
3. Short lists are merged: pairs of like size are counted. Long lists are skipped; a pair is a candidate if its count and
   the number of its skipped lists reach min(k). Sets that could reach k by long lists alone are tied, in each such
   list, to its first one.
4. The candidates' components hold every linked pair. Each is brought together once, whole sets and all, and searched by
   DivideSkip: a query's short lists are merged, its long ones are probed by binary search for those sets that can still
   reach the overlap. Sets that are already connected needn't be compared.
5. A component beyond LIMIT shingles is dealt over several tasks that share some of its sets as pivots; what stays
   outside its largest part then is searched against all its sets, block by block.

Sets are known by 64 bits of a hash; where two different sets share them, by 64 others.

Edge cases: null and empty texts and texts without words have no shingles and link with nothing, not even with each
other; a text of fewer than WIDTH words has one shingle. Repeated rows link with each other. Lists of any length,
copies in any number and texts of any length are handled without caps. Rows without an id take part; their component is
that of the smallest id they lead to, or null. Extra columns are neither read nor returned by ``join``; ``first_of_each`` returns them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph, shingles
from .common import Bits, arrow_type, key_bits, lean, map_batches, maybe_in, mix64, named, numbered, partitions, save, small, spread_join, texts
from .graph import components

#: 100 * overlap >= LEAST * union.
LEAST = 75
CELLS, PARTS = 1 << 21, 16
#: Postings that a task merges: with more, there are more tasks than the session's shuffle partitions.
POSTINGS = 1 << 22
EXTRA, SHORT = 16, 24
#: Lists with more than about 2 ** SALTED entries are dealt over several tasks.
SALTED = 17
LIMIT = 4 << 20
FLUSH_ROWS, FLUSH_DOCS = 1 << 20, 60_000
ID_BITS = np.uint64((1 << 47) - 1)
FLAG = np.uint64(1 << 47)


def least_overlap(n: int, least: int) -> int:
    """The overlap that a set of n needs at least with any partner."""
    return -(-least * n // 100)


def linked(overlap: np.ndarray, a: int, b: np.ndarray, least: int) -> np.ndarray:
    return 100 * overlap >= least * (a + b - overlap)


def summed(df: DataFrame) -> np.ndarray:
    """Adds up vectors of counts that come as rows (part, data, more), part by part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, d, m in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), b.column("more").to_pylist(), strict=True):
                v = total.setdefault(p, np.zeros(len(d), np.uint64))
                v += np.frombuffer(d, np.uint8)
                over = np.frombuffer(m, "<u8").reshape(2, -1)
                v[over[0].astype(np.int64)] += over[1]
        for p, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["part", "data"])

    rows = df.select("part", "data", "more").repartition(PARTS, "part").mapInArrow(lean(run), "part int, data binary").collect()
    return np.concatenate([np.frombuffer(r[1], "<u8") for r in sorted(rows)]) if rows else np.zeros(0, np.uint64)


def in_parts(v: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """A task's counts, a byte each; and, of the cells that a byte can't hold, their places and what is missing."""
    data, more = [], []
    for x in np.split(v, PARTS):
        at = np.flatnonzero(x > 255)
        data.append(np.minimum(x, 255).astype(np.uint8).tobytes())
        more.append(np.concatenate([at, x[at] - 255]).astype("<u8").tobytes())
    return data, more


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Of each row doc_id, hash (of its text), n and node and other (zeros without shingles); and rows (part, data, more) with each task's counts by cell."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names, id_type = ["doc_id", "hash", "n", "node", "other", "part", "data", "more"], arrow_type(docs, "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for b in small(batches):
            n, node, other = [], [], []
            held: list[np.ndarray] = []
            for s in shingles.sets(texts(b), width):
                n.append(len(s))
                x, y = shingles.key(s)
                node.append(x)
                other.append(y)
                held.append((s >> np.uint64(43)).astype(np.int32))
            if held:
                count += np.bincount(np.concatenate(held), minlength=CELLS)
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), *(pa.array(x, pa.int64()) for x in (n, node, other)), pa.array(none, pa.int32()), pa.array(none, pa.binary()), pa.array(none, pa.binary())], names=names)
        none = [None] * PARTS
        data, more = in_parts(count)
        yield pa.RecordBatch.from_arrays([pa.array(none, id_type), *(pa.array(none, pa.int64()) for _ in range(4)), pa.array(range(PARTS), pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary())], names=names)

    found = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return found.mapInArrow(lean(run), f"doc_id {kind}, hash long, n long, node long, other long, part int, data binary, more binary")


def node_of(shingle_set: np.ndarray, twice: frozenset[int]) -> int:
    """``twice``: the nodes that would stand for several sets."""
    a, b = shingles.key(shingle_set)
    return b if a in twice else a


def ranks(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell its place in the order (0 where nothing stands out of the noise of the others, then twice the logarithm of by how many deviations it does), and the logarithm of what stands out."""
    if not len(count):
        return np.zeros(CELLS, np.uint8), np.zeros(CELLS, np.uint8)
    count = count.astype(float)
    mean = count.mean()
    over = np.maximum(count - mean, 0)
    far = over / np.sqrt(max(mean, 1))
    return np.where(far < 1, 0, 1 + 2 * np.log2(np.maximum(far, 1))).astype(np.uint8), np.log2(1 + over).astype(np.uint8)


def postings(docs: DataFrame, rank: np.ndarray, heat: np.ndarray, twice: frozenset[int], width: int, least: int, into: int) -> DataFrame:
    """Rows (part, nodes, sizes, ids, of): each batch's postings for one part, as vectors; ``of`` says which of the nodes posts."""

    def flush(node: list[int], size: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
        own, at = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        part = (mix64(own) % np.uint64(into)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        own, at, part = own[by], at[by], part[by]
        bound = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        nodes, sizes = np.array(node, np.int64), np.array(size, np.int64)
        cols: list[list] = [[], [], [], [], []]
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            used, of = np.unique(at[a:b], return_inverse=True)
            low, high = (own[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), (own[a:b] >> np.uint64(32)).astype("<u2")
            for c, v in zip(cols, (int(part[a]), nodes[used].tobytes(), sizes[used].astype("<u4").tobytes(), low.tobytes() + high.tobytes(), of.astype("<u2").tobytes()), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "nodes", "sizes", "ids", "of"])

    def post(s: np.ndarray, node: int, heads: set) -> np.ndarray:
        n = len(s)
        order = np.sort(rank[s >> np.uint64(43)].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6))[: n - least_overlap(n, least) + 1 + n // EXTRA]
        ids = order & ID_BITS
        # the cell is among the 58 bits of the hash that the order keeps
        cls = heat[order >> np.uint64(37) & np.uint64(CELLS - 1)].astype(np.int64)
        hot = cls > SALTED
        if not hot.any():
            return ids
        salt = np.uint64(node % (1 << 64)) % (np.uint64(1) << (cls[hot] - SALTED).astype(np.uint64))
        with np.errstate(over="ignore"):
            dealt = mix64(ids[hot] * np.uint64(3) + salt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) & ID_BITS | FLAG
        # the first of each dealt list in this batch also posts to the list of heads, which ties the dealt ones together
        first = [i for i, d in enumerate(dealt.tolist()) if d not in heads and not heads.add(d)]
        return np.concatenate([ids[~hot], dealt, mix64(ids[hot][first]) & ID_BITS | FLAG])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, size, ids, rows, seen, heads = [], [], [], 0, set(), set()
        for b in small(batches):
            for s in shingles.sets(texts(b), width):
                if not len(s):
                    continue
                k = node_of(s, twice)
                if k in seen:  # a copy posts once
                    continue
                seen.add(k)
                node.append(k)
                size.append(len(s))
                ids.append(post(s, k, heads))
                rows += len(ids[-1])
                if rows >= FLUSH_ROWS or len(ids) >= FLUSH_DOCS:
                    yield flush(node, size, ids)
                    node, size, ids, rows, seen, heads = [], [], [], 0, set(), set()
        if ids:
            yield flush(node, size, ids)

    return docs.select("text").mapInArrow(lean(run), "part int, nodes binary, sizes binary, ids binary, of binary")


def candidates(posted: DataFrame, least: int, into: int) -> DataFrame:
    """Rows (a, b, shared, need): pairs counted over the short lists of a part; and with shared null the places of b in a long list a."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, size, ids, of, base = [], [], [], [], 0
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(k).to_pylist() for k in ("nodes", "sizes", "ids", "of")), strict=True):
                n = len(d) // 2
                node.append(np.frombuffer(a, "<i8"))
                size.append(np.frombuffer(b, "<u4"))
                ids.append(np.frombuffer(c, "<u4", n) | np.frombuffer(c, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))
                of.append(np.frombuffer(d, "<u2").astype(np.int64) + base)
                base += len(node[-1])
        if not ids:
            return
        node, size, ids, of = (np.concatenate(x) for x in (node, size, ids, of))
        uniq, same = np.unique(node, return_inverse=True)
        n = np.zeros(len(uniq), np.int64)
        n[same] = size
        who = same[of]
        by = np.lexsort((who, ids))
        ids, who = ids[by], who[by]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (who[1:] != who[:-1])]
        ids, who = ids[new], who[new]
        first = np.r_[True, ids[1:] != ids[:-1]]
        start = np.flatnonzero(first)
        length = np.diff(np.r_[start, len(ids)])
        # lists of one set say nothing
        keep = np.repeat(length > 1, length)
        ids, who, first = ids[keep], who[keep], first[keep]
        length = length[length > 1]
        if not len(ids):
            return
        long_ = np.repeat((length > SHORT) | (ids[first] >= FLAG), length)
        lists, places = ids[long_].astype(np.int64), who[long_]
        ids, who = ids[~long_], who[~long_]
        found = []
        for d in range(1, SHORT):
            if d >= len(ids):
                break
            i = np.flatnonzero(ids[d:] == ids[:-d])
            a, b = who[i], who[i + d]
            ok = 100 * np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])
            found.append(a[ok] * len(uniq) + b[ok])
        pair, shared = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
        a, b = pair // len(uniq), pair % len(uniq)
        need = 1 + np.minimum(n[a], n[b]) // EXTRA
        # the least that a partner of any size lets a set share
        alone = 1 + least * n[places] // 100 // EXTRA
        cols = [np.concatenate(x) for x in ((uniq[a], lists), (uniq[b], uniq[places]), (shared, np.zeros(len(lists), np.int64)), (need, alone))]
        nulls = np.arange(len(cols[0])) >= len(pair)
        for k in range(0, len(cols[0]), 100_000):
            p = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][p]), pa.array(cols[1][p]), pa.array(cols[2][p], mask=nulls[p]), pa.array(cols[3][p])], names=["a", "b", "shared", "need"])

    return posted.repartitionById(into, F.col("part")).mapInArrow(lean(run), "a long, b long, shared long, need long")


class Index:
    """Inverted lists over whole sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        by = np.argsort(flat, kind="stable")
        flat, self.owner = flat[by], owner[by]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        self.word, self.start = flat[first], first
        self.length = np.diff(np.r_[first, len(flat)])

    def search(self, s: np.ndarray, wanted: np.ndarray, least: int) -> np.ndarray:
        """The sets, of those ``wanted`` (a mask), that link with ``s``."""
        at = np.searchsorted(self.word, s)
        at[at == len(self.word)] = 0
        lists = at[self.word[at] == s]
        need = least_overlap(len(s), least)
        if len(lists) < need:
            return np.zeros(0, np.int64)
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        # DivideSkip: so many of the longest lists are left to the search by bisection
        skip = min(need - 1, int(need / (0.1 * np.log2(1 + self.length[lists[-1]]) + 1)))
        short, long_ = lists[: len(lists) - skip], lists[len(lists) - skip :][::-1]
        n = self.length[short]
        place = np.arange(int(n.sum())) + np.repeat(self.start[short] - np.r_[0, np.cumsum(n)[:-1]], n)
        seen = np.bincount(self.owner[place], minlength=len(self.size))
        like = wanted & (100 * np.minimum(self.size, len(s)) >= least * np.maximum(self.size, len(s)))
        found = np.flatnonzero(like & (seen >= max(1, need - skip)))
        overlap, left = seen[found], len(long_)
        for i in long_:
            if not len(found):
                break
            part = self.owner[self.start[i] : self.start[i] + self.length[i]]
            k = np.searchsorted(part, found)
            k[k == len(part)] = 0
            overlap = overlap + (part[k] == found)
            left -= 1
            on = 100 * (overlap + left) >= least * (self.size[found] + len(s) - overlap - left)
            found, overlap = found[on], overlap[on]
        return found[linked(overlap, len(s), self.size[found], least)]


def local_roots(sets: list[np.ndarray], least: int) -> np.ndarray:
    """Of each set a representative of its component among these sets."""
    return graph.local_roots(finder(least)(sets), sets)


def finder(least: int):
    """For ``graph.linked``: of some sets a search for those that link with another one."""

    def index(sets: list[np.ndarray]):
        held = Index(sets)
        return lambda s, wanted: held.search(s, wanted, least)

    return index


def whole_sets(docs: DataFrame, nodes: DataFrame, twice: frozenset[int], width: int) -> DataFrame:
    """node and data of the rows whose node is among ``nodes``, and perhaps of some others: a table of bits is asked."""

    packed = key_bits(nodes, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = Bits(packed), set()
        for b in small(batches):
            found = list(shingles.sets(texts(b), width))
            keys = pa.array([node_of(s, twice) for s in found], pa.int64())
            node, data = [], []
            for s, k, on in zip(found, keys.to_pylist(), bits.of(keys).tolist(), strict=True):
                if on and len(s) and k not in seen:
                    seen.add(k)
                    node.append(k)
                    data.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(data, pa.binary())], names=["node", "data"])

    return docs.select("text").mapInArrow(lean(run), "node long, data binary")


def node_roots(docs: DataFrame, sizes: DataFrame, count: np.ndarray, twice: frozenset[int], width: int, least: int, limit: int) -> DataFrame:
    """node and root of the nodes whose component has another root. ``sizes``: node and n."""
    into = partitions(docs.sparkSession)
    dealt = max(into, int(count.sum() * (100 - least + 100 / EXTRA) / 100) // POSTINGS + 1)
    found = candidates(postings(docs, *ranks(count), twice, width, least, dealt), least, dealt)
    found = save(found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")), "candidates")
    places = found.where("shared is null").select("a", "b", "need")
    skipped = save(places.groupBy("b").agg(F.count("*").alias("lists"), F.max("need").alias("need")), "skipped")
    pairs = found.where("shared is not null")
    for c in ("a", "b"):
        pairs = pairs.join(skipped.select(F.col("b").alias("_k"), F.col("lists").alias(f"_{c}")), F.col(c) == F.col("_k"), "left").drop("_k")
    ahead = F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))
    able = skipped.where("lists >= need").select(F.col("b").alias("_b"))
    # the dealt lists of one frequent shingle are tied whoever is in them
    ties = places.join(able, F.col("b") == F.col("_b"), "left").where(F.col("_b").isNotNull() | (F.col("a") >= int(FLAG))).select("a", "b")
    heads = ties.groupBy("a").agg(F.min("b").alias("head")).select(F.col("a").alias("_a"), "head")
    ties = ties.join(heads, F.col("a") == F.col("_a")).where("b != head").select(F.col("head").alias("a"), "b")
    group = components(pairs.where(F.col("shared") + ahead >= F.col("need")).select("a", "b").unionAll(ties), "ties")
    group = group.unionAll(group.select(F.col("root").alias("node"), "root").distinct())
    group = save(group.join(sizes, "node"), "groups")
    return graph.linked(group, whole_sets(docs, group, twice, width), "<u8", finder(least), limit, into)


def linked_rows(docs: DataFrame, width: int, least: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows doc_id, hash, n, node; per node its root, the smallest id, the number ``n`` of its rows; and per root the smallest id and the number ``n`` of its nodes."""
    seen = save(describe(docs, width), "described")
    count = summed(seen.where("part is not null"))
    members = seen.where("part is null")
    some = members.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("id"), F.min("other").alias("low"), F.max("other").alias("high"))
    nodes = save(some, "nodes")
    # among 10 ** 10 sets two or three share 64 bits
    twice = frozenset(r["node"] for r in nodes.where("low != high").select("node").collect())
    if twice:
        members = members.withColumn("node", F.when(F.col("node").isin(*twice), F.col("other")).otherwise(F.col("node")))
        nodes = save(members.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("id")), "nodes")
    roots = node_roots(docs, nodes.select("node", "n"), count, twice, width, least, limit)
    rooted = save(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "id", F.col("rows").alias("n")), "rooted")
    groups = save(rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "components")
    return members.select("doc_id", "hash", "n", "node"), rooted, groups


def join(docs: DataFrame, width: int = shingles.WIDTH, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every row."""
    members, rooted, groups = linked_rows(docs, width, least, limit)
    known = save(spread_join(rooted, groups, "root", ["node"]).select("node", "component_id", "n"), "known")
    rows = members.where("n > 0").select("doc_id", "hash", F.col("n").alias("n_shingles"), "node")
    out = spread_join(rows, known, "node", ["doc_id", "hash", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_each(docs: DataFrame, width: int = shingles.WIDTH, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """The rows, with all their columns, but of linked documents the first one alone: by id (null ids last), then by a hash of its text."""
    members, rooted, _ = linked_rows(docs, width, least, limit)
    rows = members.where("n > 0").groupBy("node", "doc_id", "hash").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "hash")).alias("first")
    # of each set its first row, then of each component its first set
    best = rows.groupBy("node").agg(first).join(rooted, "node").groupBy("root").agg(F.min("first").alias("first"))
    best = best.select("first.doc_id", "first.hash", F.lit(True).alias("stays"))
    alike = F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.hash") == F.col("b.hash"))
    gone = rows.alias("r").join(best.alias("b"), alike, "left").select("r.doc_id", "r.hash", "copies", F.coalesce("stays", F.lit(False)).alias("stays"))
    gone = save(gone.where("copies > 1 or not stays"), "gone")
    bits = key_bits(gone, "hash")
    # most rows stay, and where they are: only those that may go take part in the join
    hashed = numbered(docs).withColumn("_hash", F.xxhash64(f"c{docs.columns.index('text')}"))
    rest = map_batches(hashed, lambda b: [b.filter(pa.array(~Bits(bits).of(b.column("_hash"))))], hashed.schema)
    at = F.col(f"c{docs.columns.index('doc_id')}")
    maybe = maybe_in(hashed, "_hash", bits).join(gone.withColumnsRenamed({"doc_id": "_id", "hash": "_key"}), at.eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left")
    hashable = [f.name for f in hashed.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    one = F.row_number().over(Window.partitionBy(at, "_hash").orderBy(F.xxhash64(*hashable)))
    kept = maybe.withColumn("_at", one).where("stays is null or (stays and _at = 1)")
    return named(rest.unionByName(kept.select(*hashed.columns)), docs.columns)
