"""Best-fit packing by the linear grouping scheme.

1. Texts become token ids and an end id; longer ones than a sequence are cut into pieces of a sequence's length.
2. Large pieces, in descending order of length, fall into GROUPS groups of equal cardinality. A group's pieces count
   as long as its longest one, so that few sizes are left.
3. Configurations (multisets of sizes that fill one sequence) are made from the largest size downwards: the subset
   sum closest to a full sequence, found with bit sets, is used as often as its groups last.
4. Actual pieces take the place of the sizes, by their rank in the descending order.
5. Small pieces go, longest first, into the fullest sequence that still has room, by counts: sequences with equal
   room are one class.

The driver works on histograms alone (one count per length and per room left), whatever the number of pieces.
Pieces learn their place from their rank within equal lengths; ranks are made from counts of sub-buckets, so that no
task gets all pieces of a frequent length.

Edge cases: null and empty texts are one piece that holds the end id. Repeated rows are packed one by one.
An empty table gives an empty result. Extra columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, save, texts
from .tokens import chunk_ids

SEQUENCE, END_ID = 2048, 0
#: Pieces over this share of a sequence are large.
LARGE, GROUPS = 1 / 8, 1024
#: Rows that one sub-bucket of a class should hold about.
BUCKET_ROWS = 1 << 18


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str, room: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(b: pa.RecordBatch):
        cache = chunk_ids(tokenizer)
        row, piece, start, length, crc = [], [], [], [], []
        for i, t in enumerate(texts(b)):
            ids = cache.of(t) + end
            for k, at in enumerate(range(0, len(ids), 4 * room)):
                part = ids[at : at + 4 * room]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Layout:
    """Where ranks go: from ``first`` on, rank r sits in sequence ``base + (r - first) % width``."""

    first: np.ndarray
    base: np.ndarray
    width: np.ndarray
    sequences: int


def subset(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size (ascending) fill ``room`` best; larger ones are preferred."""
    mask, reach, after = (1 << (room + 1)) - 1, 1, []
    for s, n in zip(sizes, counts, strict=True):
        if s > room:
            break
        for _ in range(min(n, room // s)):
            more = reach | (reach << s) & mask
            if more == reach:
                break
            reach = more
        after.append(reach)
    at, used = reach.bit_length() - 1, [0] * len(sizes)
    for i in range(len(after) - 1, -1, -1):
        before, s = (after[i - 1] if i else 1), sizes[i]
        for k in range(min(counts[i], at // s), -1, -1):
            if before >> (at - k * s) & 1:
                used[i], at = k, at - k * s
                break
    return used


def configure(histogram: dict[int, int], room: int = SEQUENCE, groups: int = GROUPS) -> Layout:
    """Places large pieces, given the number of each length; ranks go by descending length."""
    total = sum(histogram.values())
    per = max(1, -(-total // groups))
    sizes: dict[int, list[int]] = {}  # rounded size -> first rank, number
    rank = 0
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            take = min(left, per - rank % per)
            if rank % per == 0:
                top = n
            sizes.setdefault(top, [rank, 0])[1] += take
            rank, left = rank + take, left - take
    order = sorted(sizes)
    left, nxt = [sizes[s][1] for s in order], {s: sizes[s][0] for s in order}
    first, base, width, made = [], [], [], 0
    while order:
        s = order[-1]
        use = subset(order[:-1] + [s], left[:-1] + [left[-1] - 1], room - s)
        use[-1] += 1
        times = min(c // u for c, u in zip(left, use, strict=True) if u)
        for i, u in enumerate(use):
            if u:
                first.append(nxt[order[i]])
                base.append(made)
                width.append(times)
                nxt[order[i]] += u * times
                left[i] -= u * times
        made += times
        keep = [i for i, c in enumerate(left) if c]
        order, left = [order[i] for i in keep], [left[i] for i in keep]
    by = np.argsort(np.array(first, np.int64), kind="stable")
    return Layout(*(np.array(x, np.int64)[by] for x in (first, base, width)), made)


@dataclass
class Fill:
    """Small pieces: from ``first`` on (ranks by descending length), rank r goes to number ``index + r - first`` of room class ``room``, at ``offset``."""

    first: np.ndarray
    room: np.ndarray
    index: np.ndarray
    offset: np.ndarray
    opened: int


def best_fit(histogram: dict[int, int], rooms: dict[int, int], room: int = SEQUENCE) -> Fill:
    """``rooms``: the number of sequences with that much room. Room class ``room`` stands for sequences opened here."""
    free: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if 0 < r < room and n}
    order, opened, rank = sorted(free), 0, 0
    out: list[tuple[int, int, int, int]] = []
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            i = bisect_left(order, n)
            if i == len(order):
                more = -(-left // (room // n))
                free[room], opened = [(room, opened, more)], opened + more
                order.append(room)
            r = order[i]
            kind, at, have = free[r].pop()
            take = min(have, left)
            if take < have:
                free[r].append((kind, at + take, have - take))
            if not free[r]:
                del free[r], order[i]
            out.append((rank, kind, at, room - r))
            rank, left, now = rank + take, left - take, r - n
            if now:
                if now not in free:
                    order.insert(bisect_left(order, now), now)
                free.setdefault(now, []).append((kind, at, take))
    cols = np.array(out, np.int64).reshape(-1, 4).T
    return Fill(*cols, opened)


def ranked(df: DataFrame, key: str, ties: list[str], rows: int, name: str) -> DataFrame:
    """``df`` with the number of each row within its ``key``, from 0."""
    buckets = 16 + rows // BUCKET_ROWS
    df = df.withColumn("_b", F.pmod(F.xxhash64(*ties), F.lit(buckets)))
    n = df.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = n.select(F.col(key).alias("_k"), F.col("_b").alias("_bb"), (F.sum("_n").over(Window.partitionBy(key).orderBy("_b")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*ties)) - 1
    return df.withColumn("_at", at).join(before, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_bb"))).withColumn(name, F.col("_before") + F.col("_at")).drop("_b", "_k", "_bb", "_before", "_at")


def starts(histogram: dict[int, int]) -> Column:
    """The first rank of each length, in descending order."""
    at, out = 0, [0] * (max(histogram, default=0) + 1)
    for n in sorted(histogram, reverse=True):
        out[n], at = at, at + histogram[n]
    return F.element_at(F.lit(np.array(out, np.int64)) if out else F.array(F.lit(0)), F.col("length").cast("int") + 1)


def looked_up(df: DataFrame, columns: dict[str, str], find) -> DataFrame:
    """``df`` with more columns, that ``find`` computes from its ranks."""

    def run(b: pa.RecordBatch):
        found = find(b.column("rank").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in found)], names=[*b.schema.names, *columns])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, run, f"{kinds}, {', '.join(f'{k} {v}' for k, v in columns.items())}")


def counted(df: DataFrame, col: str) -> dict[int, int]:
    return {int(r[0]): r[1] for r in df.groupBy(col).agg(F.count("*").alias("n")).collect()}


def pack(docs: DataFrame, tokenizer: str | None = None, room: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = save(pieces(docs, tokenizer or default_tokenizer(), room), "pieces")
    histogram = counted(cut, "length")
    large = {n: c for n, c in histogram.items() if n > room * LARGE}
    small = {n: c for n, c in histogram.items() if n not in large}
    cols, ties = ["doc_id", "piece", "start", "length", "ids_crc32"], ["doc_id", "piece", "start", "ids_crc32"]
    place = configure(large, room)

    def sequence(rank: np.ndarray) -> list[np.ndarray]:
        i = np.searchsorted(place.first, rank, "right") - 1
        return [place.base[i] + (rank - place.first[i]) % place.width[i]]

    big = ranked(cut.where(F.col("length") > room * LARGE), "length", ties, sum(large.values()), "at").withColumn("rank", starts(large) + F.col("at"))
    big = looked_up(big.select(*cols, "rank"), {"seq": "long"}, sequence)
    # a sequence holds fewer than 1 / LARGE large pieces
    held = big.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("by"), *cols))).alias("held"), (room - F.sum("length")).alias("room"))
    held = save(held, "sequences")
    rooms = counted(held, "room")
    fill = best_fit(small, rooms, room)
    base = {r: i for r, i in zip(sorted(rooms), np.cumsum([0, *(rooms[r] for r in sorted(rooms))]).tolist(), strict=False)}
    opened = sum(rooms.values())
    bases = np.full(room + 1, opened, np.int64)
    for r, i in base.items():
        bases[r] = i

    def filled(rank: np.ndarray) -> list[np.ndarray]:
        i = np.searchsorted(fill.first, rank, "right") - 1
        return [bases[fill.room[i]] + fill.index[i] + rank - fill.first[i], fill.offset[i]]

    held = ranked(held, "room", ["seq"], opened, "at").withColumn("sequence_id", F.element_at(F.lit(bases), F.col("room").cast("int") + 1) + F.col("at"))
    spot = F.expr("transform(held, (x, i) -> struct(x, aggregate(slice(held, 1, i), 0L, (a, y) -> a + y.length) as offset))")
    out = held.select("sequence_id", F.explode(spot).alias("e")).select(*[F.col(f"e.x.{c}").alias(c) for c in cols], "sequence_id", F.col("e.offset").alias("offset"))
    if not small:
        return out
    rest = ranked(cut.where(F.col("length") <= room * LARGE), "length", ties, sum(small.values()), "at").withColumn("rank", starts(small) + F.col("at"))
    rest = looked_up(rest.select(*cols, "rank"), {"sequence_id": "long", "offset": "long"}, filled)
    return out.unionByName(rest.drop("rank"))
