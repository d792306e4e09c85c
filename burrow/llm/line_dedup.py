"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of the last lines ends a chunk wherever it meets a fixed pattern, so that equal runs of
lines are cut alike wherever they stand; SPANS has a window for each of several ways, whose hashes differ. Cuts can miss
short runs, so the shortest runs that count, from each line on and up to each line, are chunks too: a repeated passage of
two lines with words and MULTI_WORDS words at least is covered by those inside it. A line of LONG_WORDS words or more is a
chunk of its own. Chunks that count have two lines and MULTI_WORDS words at least, or are such a long line; in chunks of
several lines WORD_BYTES bytes of a line count as a word where that gives more, for scripts without spaces. Of all chunks with equal hashes the
first (by doc_id, then place) stays; of the others those lines go whose bytes equal the first one's, and with them up to CONTEXT
neighbouring lines on either side that equal the first one's neighbours: chunk bounds rarely meet a passage's ends.
What goes refers to an equal line that comes earlier in that order, so one copy of every line stays.

Edge cases: null texts stay null, empty ones empty; a document may lose all its lines and stays as a row with an empty text.
Rows with equal id and text count as one document and keep the same lines. Rows with equal ids and different texts are documents
of their own, in the order of their texts' hashes; null ids come first. Empty tables give empty ones. Extra columns pass through,
whatever they are called (n_lines and n_removed come last, a second time if the table has such columns).
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Bits, key_bits, map_batches, maybe_in, mix64, named, numbered, partitions, save, texts

SPANS, EVERY = (2, 1, 2, 1, 2, 1), 2
LONG_WORDS, MULTI_WORDS, CONTEXT = 50, 12, 3
WORD_BYTES = 6
#: Copies of a chunk that one task gets at least before the chunk is dealt over several.
COPIES = 256


def text_hash() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))


def runs(words: list[int]) -> set[tuple[int, int]]:
    """Start and number of lines of the shortest runs that count, from each line on and up to each line; lines without words neither begin nor end one."""
    full = [i for i, w in enumerate(words) if w]
    total = list(accumulate((words[i] for i in full), initial=0))
    out: set[tuple[int, int]] = set()
    k = 0
    for j in range(1, len(full)):
        # from each line on: those whose run ends here; the last of them is also the shortest one up to here
        while k < j and total[j + 1] - total[k] >= MULTI_WORDS:
            out.add((full[k], full[j] + 1 - full[k]))
            k += 1
        if k:
            out.add((full[k - 1], full[j] + 1 - full[k - 1]))
    return out


def chunks(lines: list[bytes], words: list[int]) -> list[tuple[int, int]]:
    """Start and number of lines of the chunks that count."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))
    long_ = np.array(words) >= LONG_WORDS
    forced = long_.copy()
    forced[:-1] |= long_[1:]
    forced[-1] = True
    weight = [max(w, len(x) // WORD_BYTES) if w else 0 for x, w in zip(lines, words, strict=True)]
    out = runs(weight)
    for way, span in enumerate(SPANS):
        with np.errstate(over="ignore"):
            roll = h * np.uint64(0x9E3779B97F4A7C15 + 2 * way)
            for k in range(1, span):
                roll[k:] += h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * k)
        ends = np.flatnonzero((mix64(roll) % np.uint64(EVERY) == 0) | forced) + 1
        a = 0
        for b in ends.tolist():
            if (b - a > 1 and sum(weight[a:b]) >= MULTI_WORDS) or words[a] >= LONG_WORDS:
                out.add((a, b - a))
            a = b
    return sorted(out)


def list_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, lines, h1 and h2 of every chunk that counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch):
        row, start, count, h1, h2 = [], [], [], [], []
        for i, t in enumerate(texts(b)):
            lines = t.split(b"\n")
            if len(lines) > 1 or len(t) > LONG_WORDS:
                for a, n in chunks(lines, [len(x.split()) for x in lines]):
                    d = xxhash.xxh3_128_digest(b"\n".join(lines[a : a + n]))
                    row.append(i)
                    start.append(a)
                    count.append(n)
                    h1.append(int.from_bytes(d[:8], "big", signed=True))
                    h2.append(int.from_bytes(d[8:], "big", signed=True))
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_hash").take(take), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["doc_id", "text_hash", "start", "lines", "h1", "h2"])

    return map_batches(docs.select("doc_id", text_hash().alias("text_hash"), "text"), run, f"doc_id {kind}, text_hash long, start int, lines int, h1 long, h2 long")


def same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def repeats(docs: DataFrame) -> tuple[DataFrame, bytes]:
    """doc_id, text_hash and ``parts`` of the documents with repeated chunks: start, lines and the first copy's bytes and neighbours; and a table of bits of their text hashes."""
    listed = save(list_chunks(docs), "chunks")
    first = F.min(F.struct("doc_id", "text_hash", "start", "lines")).alias("first")
    # the first copy by a partial aggregate: a chunk in a third of all documents is one row from each task
    firsts = save(listed.groupBy("h1", "h2").agg(first, F.count("*").alias("n")).where("n > 1"), "firsts")
    wanted = firsts.groupBy("first.doc_id", "first.text_hash").agg(F.collect_list(F.struct("h1", "h2", "n", "first.start", "first.lines")).alias("wanted"))
    # of the texts only those with a first copy go through the join
    keyed = maybe_in(docs.select("doc_id", text_hash().alias("text_hash"), "text"), "text_hash", key_bits(firsts.select("first.text_hash"), "text_hash"))
    held = wanted.alias("w").join(keyed.alias("d"), same("w", "d")).select("w.wanted", "d.text")

    def fetch(b: pa.RecordBatch):
        h1, h2, n, body, before, after = [], [], [], [], [], []
        for t, want in zip(texts(b), b.column("wanted").to_pylist(), strict=True):
            lines = t.split(b"\n")
            for w in want:
                a, z = w["start"], w["start"] + w["lines"]
                h1.append(w["h1"])
                h2.append(w["h2"])
                n.append(w["n"])
                body.append(b"\n".join(lines[a:z]))
                for out, near in ((before, lines[max(0, a - CONTEXT) : a][::-1]), (after, lines[z : z + CONTEXT])):
                    stop = next((k for k, x in enumerate(near) if len(x.split()) >= LONG_WORDS), len(near))
                    out.append(near[:stop])
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary()), pa.array(before, pa.list_(pa.binary())), pa.array(after, pa.list_(pa.binary()))], names=["h1", "h2", "n", "body", "before", "after"])

    # rows of equal id and text would give a first copy more than once
    bodies = map_batches(held, fetch, "h1 long, h2 long, n long, body binary, before array<binary>, after array<binary>").dropDuplicates(["h1", "h2"])
    # frequent chunks are dealt: one has more than an eighth of what a task gets on average, so that eight a task is the most there are
    into = partitions(docs.sparkSession)
    most = max(COPIES, int(firsts.agg(F.sum("n")).first()[0] or 0) // (8 * into))
    salts = F.ceil(F.col("n") / most).cast("int")
    dealt = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    hot = F.broadcast(firsts.where(F.col("n") > most).select("h1", "h2", salts.alias("salts")))
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "start", "lines"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")
    copies = maybe_in(listed, "h1", key_bits(firsts, "h1")).join(hot, ["h1", "h2"], "left").withColumn("salt", salt).drop("salts")
    later = copies.join(firsts.select("h1", "h2", "first", dealt), ["h1", "h2", "salt"])
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("start") == F.col("first.start"))
    # what lies within another chunk that lies alike in the same first copy says nothing more, and its bytes needn't travel; nor do repeated rows'
    end = F.col("start") + F.col("lines")
    alike = Window.partitionBy("doc_id", "text_hash", "first.doc_id", "first.text_hash", F.col("start") - F.col("first.start")).orderBy("start", F.desc("lines")).rowsBetween(Window.unboundedPreceding, -1)
    later = later.where(~own).withColumn("reach", F.max(end).over(alike)).where(F.col("reach").isNull() | (end > F.col("reach")))
    later = save(later.select("doc_id", "text_hash", "start", "lines", "h1", "h2", "salt"), "later")
    parts = later.join(bodies.select("h1", "h2", "body", "before", "after", dealt), ["h1", "h2", "salt"])
    parts = parts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "lines", "body", "before", "after")).alias("parts"))
    return parts, key_bits(later, "text_hash")


def cleaned(text: bytes, parts: list[dict]) -> tuple[bytes, int, int]:
    """The text without repeated lines, the number of its lines and of those that went."""
    lines = text.split(b"\n")
    gone: set[int] = set()
    for p in parts:
        a, z = p["start"], p["start"] + p["lines"]
        if b"\n".join(lines[a:z]) != p["body"]:
            continue
        gone.update(range(a, z))
        for i, near in enumerate(p["before"]):
            if a - 1 - i < 0 or lines[a - 1 - i] != near:
                break
            gone.add(a - 1 - i)
        for i, near in enumerate(p["after"]):
            if z + i >= len(lines) or lines[z + i] != near:
                break
            gone.add(z + i)
    return (b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text), len(lines), len(gone)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows with all their columns, ``text`` without repeated chunks, and the columns n_lines and n_removed (long)."""
    out, more = _dedup(docs), ["n_lines", "n_removed"]
    return named(out, docs.columns, *more)


def dedup_rows(docs: DataFrame) -> DataFrame:
    """The rows with their own columns alone, ``text`` without repeated chunks, but those that consist of nothing else; an integer ``n_chars`` follows the text."""
    out = _dedup(docs)
    text = F.col(f"c{docs.columns.index('text')}")
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col("n_removed") == 0, F.col(n)).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return named(out.where((F.col("n_removed") == 0) | (text != "")), docs.columns)


def _dedup(docs: DataFrame) -> DataFrame:
    """The columns by number (c0, c1, ...), n_lines and n_removed."""
    found, touched = repeats(docs)
    at, n = docs.columns.index("text"), len(docs.columns)
    rows = numbered(docs)
    hashed = rows.withColumn("hash", F.coalesce(F.xxhash64(f"c{at}"), F.lit(0).cast("long")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def cut(b: pa.RecordBatch, parts: list) -> pa.RecordBatch:
        new, lines, gone = [], [], []
        for t, found in zip(b.column(at).cast(pa.binary()).to_pylist(), parts, strict=True):
            x, a, z = cleaned(t or b"", found or [])
            new.append(None if t is None else x)
            lines.append(a if t else 0)
            gone.append(z)
        cols = [*b.columns[:n], pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
        cols[at] = pa.array(new, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:n], "n_lines", "n_removed"])

    def untouched(b: pa.RecordBatch):
        b = b.filter(pa.array(~Bits(touched).of(b.column("hash"))))
        yield cut(b, [None] * b.num_rows)

    # texts that keep all their lines stay where they are
    out = f"{kinds}, n_lines long, n_removed long"
    rest = map_batches(hashed, untouched, out)
    own = F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    joined = maybe_in(hashed, "hash", touched).join(found, own, "left").select(*rows.columns, "parts")
    return rest.unionByName(map_batches(joined, lambda b: [cut(b, b.column("parts").to_pylist())], out))
