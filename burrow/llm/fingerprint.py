"""Document fingerprints by randomised edit embedding, and the groups of near texts that they show.

A walk reads a text: at step j it stands on a character, notes it, and moves on if a random bit that all texts share for
(j, character) is set. Texts at a small edit distance walk in step but for a few places, so edit
distance turns into Hamming distance between the notes. A fingerprint samples the notes: every step belongs to one of
``SLOTS`` slots and has a random rank; a slot keeps a byte of the note at its lowest-ranked step that the text reaches.
Texts of like length therefore sample the same steps, whatever the length.

Groups of near texts: bands of bits, sampled from the fingerprints, make candidates; inside the components of those each
fingerprint is searched for others of likeness LEAST or more, and the components of what is found are the groups. The bits of
a band follow the logarithm of the number of texts, so that chance meetings stay as rare whatever that number is, and the number
of bands follows from the bits: two texts of likeness LEAST share a band with probability RECALL, nearer ones with more.

Edge cases: null counts as empty; an empty text's fingerprint is all zeros, its likeness to another empty one 1, and its group its
own id. Equal texts have equal fingerprints. Rows of equal id are ordered by a hash of their text; null ids come first. With a
single row the next document is the row itself. Empty tables give empty ones. Ids may be of any type that Spark orders.
Extra columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .common import Bits, arrow_type, key_bits, lean, map_batches, mix64, partitions, save, spread_join

SLOTS, SEED = 128, 20_017
#: The walk's random bits repeat after so many steps; characters are folded to so many kinds, the last of which never moves.
PERIOD, KINDS = 512, 4096
STOP = KINDS - 1
#: Below so many walks, a loop over steps beats a vector over walks.
FEW = 24
#: Near texts: the least likeness, the share of such pairs that meet in a band, and bits of a band beyond the logarithm of the number of texts.
LEAST, RECALL, SPARE = 0.85, 0.95, 13
#: Fingerprints of a candidate component that one task compares, and texts whose bands are compared before they leave a task.
LIMIT, FLUSH = 1 << 9, 1 << 14
#: Rows sampled for a range of ids.
SAMPLED = 64
#: Bytes of text walked over at a time, and rows turned into Python objects at a time.
WORK_BYTES, ROWS = 3 << 20, 256


@lru_cache(1)
def moves() -> tuple[np.ndarray, list[bytes]]:
    bits = np.random.default_rng(SEED).integers(0, 2, (PERIOD, KINDS), dtype=np.uint8)
    bits[:, STOP] = 0
    return bits.astype(np.int64), [r.tobytes() for r in bits]


@lru_cache(4)
def samples(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first ``steps``: those that are their slot's lowest-ranked so far, and their slots."""
    h = mix64(np.arange(steps, dtype=np.uint64) + np.uint64(SEED << 20))
    slot = (h % np.uint64(SLOTS)).astype(np.int64)
    by = np.argsort(slot, kind="stable")
    rank, s = (h >> np.uint64(8))[by], slot[by]
    keep = np.ones(steps, bool)
    for a in np.flatnonzero(np.r_[True, s[1:] != s[:-1]]):
        b = np.searchsorted(s, s[a], "right")
        keep[a + 1 : b] = rank[a + 1 : b] < np.minimum.accumulate(rank[a:b])[:-1]
    found = np.sort(by[keep])
    return found, slot[found]


def note(kind: np.ndarray, step: int) -> np.ndarray:
    """A byte, never 0, of a character kind at a step."""
    return (mix64(kind.astype(np.uint64) + np.uint64(step * KINDS + 1)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def fold(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return (((c >> 11) * 977 ^ c) % STOP).astype(np.uint16)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each text."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    if not texts:
        return out
    parts = [fold(t) for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    codes = np.full(int(size.sum()) + len(parts), STOP, np.uint16)
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    for a, p in zip(start, parts, strict=True):
        codes[a : a + len(p)] = p
    lane = np.argsort(-size, kind="stable")
    lane = lane[size[lane] > 0]
    pos, end = start[lane], (start + size)[lane]
    bits, rows = moves()
    step, k = 0, 0
    reach = 1 << max(10, int(4 * size.max() + 64).bit_length())
    at, slots = samples(reach)  # few walks take 4 steps a character
    while len(lane) > FEW:
        if step >= reach:
            reach *= 2
            at, slots = samples(reach)
        for j in range(step, step + 64):
            kind = codes.take(pos)
            if k < len(at) and at[k] == j:
                there = np.flatnonzero(kind != STOP)
                out[lane[there], slots[k]] = note(kind[there], j)
                k += 1
            pos += bits[j % PERIOD].take(kind)
        step += 64
        on = pos < end
        if not on.all():
            lane, pos, end = lane[on], pos[on], end[on]
    for i, p, e in zip(lane.tolist(), pos.tolist(), end.tolist(), strict=True):
        a, n, ahead = int(start[i]), k, reach
        own, p, e, j = codes[a : e + 1].tolist(), p - a, e - a, step
        there, slot = at, slots
        while p < e:
            if j >= ahead:
                ahead *= 2
                there, slot = samples(ahead)
            stop = min(int(there[n]) if n < len(there) else ahead, j + 8192, ahead)
            for j in range(j, stop):  # noqa: B020  goes on from where it is
                p += rows[j % PERIOD][own[p]]
            j = stop
            if n < len(there) and there[n] == j:
                if p < e:
                    out[i, slot[n]] = note(np.array([own[p]]), j)[0]
                n += 1
                p += rows[j % PERIOD][own[p]]
                j += 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal slots among those that either has, by rows."""
    used = ((a != 0) | (b != 0)).sum(1)
    return np.where(used, ((a == b) & (a != 0)).sum(1) / np.maximum(used, 1), 1.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text, which orders rows of equal id) and text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("h"), "text")


def ranges(rows: DataFrame) -> tuple[int, Column]:
    """The number of ranges of (doc_id, h) with about as many rows each, and a row's range.

    Ids that many rows share, or that they lack, fall into several ranges. The bounds come from about SAMPLED rows for a range,
    chosen by a hash.
    """
    n = partitions(rows.sparkSession)
    step = max(1, rows.count() // (SAMPLED * n))
    some = rows.where(F.pmod(F.xxhash64("doc_id", "h", F.lit("range")), F.lit(step)) == 0).groupBy("doc_id", "h").agg(F.count("*").alias("n")).orderBy("doc_id", "h").collect()
    bounds, seen, done, whole = [], 0, 0, sum(r["n"] for r in some)
    for r in some:
        if seen * n // whole > done:
            done = seen * n // whole
            bounds.append((r["doc_id"], r["h"]))
        seen += r["n"]
    if not bounds:
        return 1, F.lit(0)
    kind = rows.schema["doc_id"].dataType

    def fixed(items: list[tuple]) -> Column:
        return F.array(*[F.struct(F.lit(i).cast(kind).alias("doc_id"), F.lit(h).cast("long").alias("h")) for i, h in items])

    # a row is in the range of the last bound that isn't above it; found in two steps of about the root of their number
    here, k = F.struct("doc_id", "h"), max(1, int(len(bounds) ** 0.5))
    c = F.size(F.filter(fixed(bounds[::k]), lambda x: x <= here))
    fine = F.slice(fixed(bounds), F.greatest((c - 1) * k + 1, F.lit(1)), F.lit(k))
    return len(bounds) + 1, F.when(c == 0, 0).otherwise((c - 1) * k + F.size(F.filter(fine, lambda x: x <= here)))


def squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with compressed bytes for ``text``: whole texts go through a shuffle."""
    at = rows.columns.index("text")

    def run(b: pa.RecordBatch):
        c = zstandard.ZstdCompressor(level=1)
        raw = pa.array([c.compress(t) for t in b.column(at).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:at], raw, *b.columns[at + 1 :]], names=b.schema.names)

    return map_batches(rows, run, ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema))


def with_next(docs: DataFrame, printed: DataFrame, links: DataFrame) -> DataFrame:
    """Partitions of rows in order, each followed by the first row of the next one (the last by the very first); before a text, what links say of it.

    doc_id, h, role (0: a link, 1: a text, 2: the row that follows), text (compressed) and near. ``printed`` has doc_id and h of all rows.
    """
    n, place = ranges(printed)
    first = printed.groupBy(place.alias("range")).agg(F.min(F.struct("doc_id", "h")).alias("first")).orderBy("range").collect()
    kind = docs.schema["doc_id"].dataType
    starts = [(first[i - 1]["range"], r["first"]["doc_id"], r["first"]["h"]) for i, r in enumerate(first)]
    guests = docs.sparkSession.createDataFrame(starts, f"range int, id {kind.simpleString()}, start long")
    rows, none = keyed(docs), F.lit(None).cast(kind).alias("near")
    # a row for each range
    sent = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("start"))).groupBy("range", "doc_id", "h").agg(F.first("text").alias("text"))
    every = squeezed(rows).select("doc_id", "h", F.lit(1).alias("role"), "text", none, place.alias("range"))
    every = every.unionByName(squeezed(sent.select("range", "doc_id", "h", "text")).select("doc_id", "h", F.lit(2).alias("role"), "text", none, "range"))
    every = every.unionByName(links.select("doc_id", "h", F.lit(0).alias("role"), F.lit(None).cast("binary").alias("text"), "near", place.alias("range")))
    return every.repartitionById(n, F.col("range")).sortWithinPartitions(F.col("role") == 2, "doc_id", "h", "role").drop("range")


def node_of(one: np.ndarray) -> int | None:
    """The number that stands for a fingerprint; an empty text has none."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(one.tobytes())))) if one.any() else None


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, h, node and print (bytes) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(held: list[pa.RecordBatch], text: list[str]) -> pa.RecordBatch:
        found = fingerprints(text)
        ids, hashes = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "h"))
        return pa.RecordBatch.from_arrays([ids, hashes, pa.array(map(node_of, found), pa.int64()), pa.array([r.tobytes() for r in found], pa.binary())], names=["doc_id", "h", "node", "print"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, text, size = [], [], 0  # many walks at a time cost less each
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                held.append(part)
                text += part.column("text").to_pylist()
                size += part.column("text").nbytes
                if size > WORK_BYTES:
                    yield digest(held, text)
                    held, text, size = [], [], 0
        if held:
            yield digest(held, text)

    return keyed(docs).mapInArrow(lean(run), f"doc_id {kind}, h long, node long, print binary")


def full(found: np.ndarray) -> np.ndarray:
    """Fingerprints without empty slots: those of short texts borrow from the next slot that isn't, mixed with the distance to it."""
    out = found.copy()
    rows = np.flatnonzero((out == 0).any(1))
    for distance in range(1, SLOTS):
        if not len(rows):
            break
        ahead = np.roll(found[rows], -distance, 1)
        some = out[rows]
        out[rows] = np.where((some == 0) & (ahead != 0), ahead * np.uint8(2 * (distance % 128) + 1) ^ np.uint8(distance), some)
        rows = rows[(out[rows] == 0).any(1)]
    return out


def bands_for(texts: int, least: float = LEAST) -> tuple[int, int]:
    """Bits of a band and number of bands for so many texts."""
    bits = min(60, int(texts).bit_length() + SPARE)
    # equal slots agree in all bits, others in half of them
    together = ((1 + least) / 2) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - together))


def band_keys(found: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """A row of keys for each fingerprint."""
    rng, whole = np.random.default_rng(SEED + 1), full(found)
    out = np.empty((len(found), bands), np.uint64)
    for n in range(bands):
        slot, bit = rng.choice(SLOTS, bits, replace=False), rng.integers(0, 8, bits).astype(np.uint8)
        sampled = (whole[:, slot] >> bit & 1).astype(np.uint64) << np.arange(bits, dtype=np.uint64)
        with np.errstate(over="ignore"):
            out[:, n] = mix64(sampled.sum(1, dtype=np.uint64) + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))
    return out


def meetings(printed: DataFrame, bits: int, bands: int) -> DataFrame:
    """Edges (a, b) that connect the nodes which share a band."""

    def flush(held: dict[int, bytes]) -> pa.RecordBatch:
        node = np.array(list(held), np.int64)
        keys = band_keys(np.frombuffer(b"".join(held.values()), np.uint8).reshape(-1, SLOTS), bits, bands).ravel()
        who = np.repeat(node, bands)
        by = np.argsort(keys, kind="stable")
        keys, who = keys[by], who[by]
        first = np.r_[True, keys[1:] != keys[:-1]]
        head = who[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        # of the nodes that meet here one alone stands for them elsewhere
        key = np.where(first, keys.view(np.int64), mix64((who ^ head).view(np.uint64)).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(head, mask=first)], names=["key", "node", "head"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for b in batches:
            for n, d in zip(b.column("node").to_pylist(), b.column("print").to_pylist(), strict=True):
                held[n] = d
                if len(held) >= FLUSH:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    rows = printed.where("node is not null").select("node", "print").mapInArrow(lean(run), "key long, node long, head long")
    before = F.lag("node").over(Window.partitionBy("key").orderBy("node"))
    # a head goes with its own key, whose rows have none
    return rows.select("node", F.coalesce("head", before).alias("b")).where("b is not null and node != b").select(F.col("node").alias("a"), "b")


def near(least: float):
    """For ``graph.linked``: of some fingerprints a search for those of likeness ``least`` or more."""

    def index(items: list[np.ndarray]):
        every = np.stack(items)
        there = every != 0

        def search(one: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(wanted)
            same = ((every[at] == one) & there[at]).sum(1)
            used = (there[at] | (one != 0)).sum(1)
            return at[same >= least * used]

        return search

    return index


def near_groups(printed: DataFrame, least: float = LEAST, limit: int = LIMIT) -> DataFrame:
    """node, near (the smallest id of its group) and n (its rows) of the nodes whose group has several rows. ``printed``: doc_id, node and print (saved)."""
    into = partitions(printed.sparkSession)
    nodes = save(printed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")), "print-nodes")
    edges = meetings(printed, *bands_for(nodes.count(), least))
    group = graph.components(edges, "bands")
    group = group.unionAll(group.select(F.col("root").alias("node"), "root").distinct()).withColumn("n", F.lit(1))
    group = save(group, "print-groups")
    packed = key_bits(group, "node")

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = Bits(packed), set()
        for b in batches:
            node = b.column("node")
            rows = [i for i, (n, on) in enumerate(zip(node.to_pylist(), bits.of(node).tolist(), strict=True)) if on and n not in seen and not seen.add(n)]
            yield b.take(pa.array(rows, pa.int64()))

    data = printed.where("node is not null").select("node", F.col("print").alias("data")).mapInArrow(lean(chosen), "node long, data binary")
    roots = graph.linked(group, data, "u1", near(least), limit, into)
    rooted = save(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "id", F.col("rows").alias("n")), "print-roots")
    groups = rooted.groupBy("root").agg(F.min("id").alias("near"), F.count("*").alias("n"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    return save(spread_join(rooted.select("node", "root", F.col("n").alias("rows")), save(groups, "print-near"), "root", ["node"]).select("node", "near", F.col("rows").alias("n")), "print-known")


def fingerprint(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and near_group of every row.

    near_group: the smallest id of the texts that links of likeness ``least`` or more lead to, its own among them.
    """
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), arrow_type(docs, "doc_id")
    printed = save(prints(docs), "prints")
    known = near_groups(printed, least)
    links = spread_join(printed.select("doc_id", "h", "node"), known, "node", ["doc_id", "h"]).select("doc_id", "h", "near")

    def digest(ids: list, own: list[str], group: list) -> pa.RecordBatch:
        """``own`` has one text more than ``ids``."""
        new = [edited(a, b) for a, b in zip(own, own[1:], strict=False)]
        found = fingerprints(own + new)
        a, b = found[: len(own)], found[len(own) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, id_type),
                pa.array([len(t) for t in own[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
                pa.array([r.tobytes().hex() for r in a[:-1]], pa.string()),
                pa.array([r.tobytes().hex() for r in b], pa.string()),
                pa.array(likeness(a[:-1], b)),
                pa.array(likeness(a[:-1], a[1:])),
                pa.array(group, id_type),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_group"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, ids, own, group, size, guest, link = zstandard.ZstdDecompressor(), [], [], [], 0, False, None
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                for i, h, role, raw, near in zip(*(part.column(c).to_pylist() for c in ("doc_id", "h", "role", "text", "near")), strict=True):
                    if role == 0:
                        link = (i, h, near)
                        continue
                    guest = role == 2
                    own.append(unpack.decompress(raw).decode("utf-8", "surrogatepass"))
                    size += len(own[-1]) + 64
                    if guest:
                        continue
                    ids.append(i)
                    group.append(link[2] if link and link[:2] == (i, h) else i)
                    if size > WORK_BYTES and len(own) > 1:
                        yield digest(ids[:-1], own, group[:-1])
                        ids, own, group, size = ids[-1:], own[-1:], group[-1:], len(own[-1])
        if ids and guest:
            yield digest(ids, own, group)

    return with_next(docs, printed, links).mapInArrow(lean(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_group {kind}")
