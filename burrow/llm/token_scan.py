"""Token counts of documents in flat token files without an index.

A file is a run of fixed-width token ids in which an end id closes every document. Files are cut into blocks
wherever they happen to fall; each block is searched for end ids by one vector comparison. What a block can't know, namely how
many documents and tokens came before it and where the document that is open at its start began, follows from a prefix scan
over the blocks' summaries (three numbers each, no places): within runs of SPAN blocks, then over the runs' totals.

``blocks_of_files`` reads such files, large ones by ranges; ``tokenised`` makes the blocks from texts.

Edge cases: an empty file has no blocks and gives no rows; two end ids in a row close a document of 0 tokens; tokens
after the last end id are a document that is not ``closed``; a block may hold no end id at all, and a document may
span any number of blocks. Bytes at a file's end that don't fill a token are an error. Null and empty texts have 0 tokens;
repeated rows are counted one by one; extra columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_type, lean, map_batches, partitions, save, small, texts
from .packing import default_tokenizer
from .tokens import chunk_ids

#: <|endoftext|> of the default tokenizer, whose ids fit 16 bits.
END_ID, WIDTH = 49_407, 2
BLOCK_TOKENS = 1 << 18
#: Blocks whose summaries one task scans (128 GB of tokens of 512 KB blocks make 256 runs), and the largest file that is read as one value.
SPAN, WHOLE = 1024, 256 << 20


def scan_block(data: bytes, width: int, end: int) -> tuple[int, np.ndarray]:
    """The number of tokens and the places of the end ids."""
    if len(data) % width:
        raise ValueError(f"a block of {len(data)} bytes holds no whole number of {width}-byte tokens")
    ids = np.frombuffer(data, f"<u{width}")
    return len(ids), np.flatnonzero(ids == end)


def document_lengths(blocks: DataFrame, end: int = END_ID, width: int = WIDTH) -> DataFrame:
    """file, document (from 0), n_tokens (without the end id), closed. ``blocks``: file, block (in order), data."""
    kind = blocks.schema["file"].dataType.simpleString()

    def run(b: pa.RecordBatch):
        n, ends = [], []
        for data in b.column("data").to_pylist():
            k, at = scan_block(data or b"", width, end)
            n.append(k)
            ends.append(at)
        count, last = [len(e) for e in ends], [int(e[-1]) + 1 if len(e) else None for e in ends]
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), *(pa.array(x, pa.int64()) for x in (n, count, last)), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "n", "k", "last", "ends"])

    found = map_batches(blocks.select("file", F.col("block").cast("long").alias("block"), "data"), run, f"file {kind}, block long, n long, k long, last long, ends array<long>")
    found = save(found, "ends")
    zero = F.lit(0).cast("long")

    def scanned(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        """``rows`` (n, k, last) with start, documents and open: what comes before each of them within ``by``."""
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("start", F.coalesce(F.sum("n").over(before), zero)).withColumn("documents", F.coalesce(F.sum("k").over(before), zero))
        return rows.withColumn("open", F.max(F.col("start") + F.col("last")).over(before))

    heads = found.select("file", "block", F.floor(F.col("block") / SPAN).alias("run"), "n", "k", "last")
    inner = scanned(heads, ["file", "run"], "block")
    runs = inner.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.col("start") + F.col("last")).alias("last"))
    runs = save(runs, "runs")
    outer = scanned(runs, ["file"], "run").select("file", "run", F.col("start").alias("_start"), F.col("documents").alias("_documents"), F.col("open").alias("_open"))
    known = inner.join(outer, ["file", "run"]).where("k > 0").select(
        "file",
        "block",
        (F.col("start") + F.col("_start")).alias("start"),
        (F.col("documents") + F.col("_documents")).alias("documents"),
        F.coalesce(F.col("_start") + F.col("open"), "_open", zero).alias("open"),
    )
    # the places of the ends stay with their block and take its three numbers
    spans = found.where("k > 0").select("file", "block", "ends").join(known, ["file", "block"])
    begins = F.concat(F.array(F.col("open") - F.col("start")), F.transform("ends", lambda e: e + 1))
    each = F.transform("ends", lambda e, i: F.struct((F.col("documents") + i).alias("document"), (e - F.element_at(begins, i + 1)).alias("n_tokens")))
    closed = spans.select("file", F.explode(each).alias("d")).select("file", "d.document", "d.n_tokens", F.lit(True).alias("closed"))
    whole = scanned(runs, ["file"], "run").groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("document"), F.coalesce(F.max(F.col("start") + F.col("last")), zero).alias("open"))
    rest = whole.where("n > open").select("file", "document", (F.col("n") - F.col("open")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def blocks_of_files(spark: SparkSession, path: str, width: int = WIDTH, tokens: int = BLOCK_TOKENS, whole: int = WHOLE) -> DataFrame:
    """file, block and data of binary token files.

    Files of more than ``whole`` bytes are read by ranges, each a task's, through pyarrow's file systems (local, HDFS, S3, GCS); Spark's
    reader, which makes one value of a file, reads the others from any store.
    """
    size = tokens * width
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    schema = "file string, block long, data binary"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_buffer()
                for k in range(0, data.size, size):
                    yield block(b.column(0)[i].as_py(), k // size, data[k : k + size].to_pybytes())

    def block(file: str, at: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for file, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, at = fs.FileSystem.from_uri("file://" + file[5:] if file.startswith("file:/") and not file.startswith("file://") else file)
                with store.open_input_file(at) as f:
                    for k in range(first, last):
                        yield block(file, k, f.read_at(min(size, f.size() - k * size), k * size))

    small_ones = files.where(F.col("length") <= whole).select(F.col("path").alias("file"), "content").mapInArrow(lean(cut), schema)
    per = max(1, whole // size)
    count = F.ceil(F.col("length") / size)
    first = F.explode(F.sequence(F.lit(0).cast("long"), count - 1, F.lit(per).cast("long"))).alias("first")
    parts = files.where(F.col("length") > whole).select(F.col("path").alias("file"), count.alias("count"), first)
    parts = parts.select("file", "first", F.least(F.col("first") + per, "count").alias("last")).repartition(partitions(spark), "file", "first")
    return small_ones.unionByName(parts.mapInArrow(lean(fetch), schema))


def tokenised(docs: DataFrame, tokenizer: str, end: int = END_ID, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One token file for each partition, in blocks (file, block, data), and its documents' ids in order (file, block null, ids).

    The blocks are cut after ``tokens`` tokens each, regardless of documents.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    close, id_type = np.array([end], "<u2").tobytes(), arrow_type(docs, "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, cache = TaskContext.get().partitionId(), chunk_ids(tokenizer, plain=True)
        names = ["file", "block", "data", "first", "ids"]
        n, done, left = 0, 0, bytearray()

        def out(block, data, first, ids) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(id_type))], names=names)

        for b in small(batches):
            for t in texts(b):
                left += np.frombuffer(cache.of(t), "<u4").astype("<u2").tobytes() + close
                while len(left) >= 2 * tokens:
                    yield out(n, bytes(left[: 2 * tokens]), None, None)
                    del left[: 2 * tokens]
                    n += 1
            yield out(None, None, done, b.column("doc_id").to_pylist())
            done += b.num_rows
        if left:
            yield out(n, bytes(left), None, None)

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"file long, block long, data binary, first long, ids array<{kind}>")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row: the texts go into flat token files, which are then scanned."""
    made = save(tokenised(docs, tokenizer or default_tokenizer()), "tokens")
    spans = document_lengths(made.where("block is not null"))
    names = made.where("first is not null").select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("document"), "doc_id")
    return names.join(spans, ["file", "document"]).select("doc_id", "n_tokens")
