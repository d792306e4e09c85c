"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import scratch
from ..scratch import drop_saved, setting, shared_dir  # noqa: F401  for the operators

#: Bytes of text, and rows, that one step of a batch operator works on at a time: what a worker holds doesn't follow the size of Arrow's batches.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lost executors take no lineage with them. The files go when the session ends."""
    modest(df.sparkSession)
    return scratch.save(df, label)


#: Rows of an Arrow batch: texts are long, and a batch is held several times over on its way. The session's ``burrow.batch.rows``
#: says otherwise; 0 leaves Spark's own setting as it is, and so does a session that has changed Spark's default itself.
BATCH_ROWS = 1000
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def modest(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch for the session: Spark reads them when a query starts, which may be long after an operator has returned."""
    rows = int(setting(spark, "burrow.batch.rows") or BATCH_ROWS)
    if rows and spark.conf.get(_SETTING) == _DEFAULT:
        spark.conf.set(_SETTING, str(rows))


def partitions(spark: SparkSession) -> int:
    modest(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Gives what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


#: What modules keep for a task's next batches; emptied when the task ends.
KEPT_BY_TASKS: list[dict | list] = []


def kept(cache: dict | list) -> dict | list:
    """``cache`` lasts as long as the task that fills it: the worker's next task may be another operator's."""
    KEPT_BY_TASKS.append(cache)
    return cache


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``: a worker that waits for its next task, of which an executor has several for each core, holds no memory of the last one."""

    def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in KEPT_BY_TASKS:
                cache.clear()
            release()

    return released


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_ROWS rows."""
    for b in batches:
        for k in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(k, SLICE_ROWS)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` for each slice of the Arrow batches."""
    modest(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield from fn(b)

    return df.mapInArrow(lean(run), schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(lengths: Iterable[int], most: int = SLICE_BYTES) -> Iterator[slice]:
    """Consecutive runs of rows that hold ``most`` bytes at most, or one row."""
    start = total = i = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n + 64
    if total:
        yield slice(start, i + 1)


#: Of a table of hashed keys: bits for each key, the fewest and the most bits, and bits of one part.
PER_KEY, LEAST_BITS, MOST_BITS, PART_BITS = 64, 1 << 23, 1 << 29, 1 << 20


def _places(column: pa.Array, bits: int) -> np.ndarray:
    return mix64(column.to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(bits - 1)


def key_bits(keys: DataFrame, column: str) -> bytes:
    """A table of bits that says of a long whether it may be in ``column`` of a saved table: it makes joins smaller, and never decides them.

    It has PER_KEY bits for each key up to MOST_BITS (64 MB); with more keys than fit, more rows that nothing needs go through the join.
    """
    found = keys.select(F.col(column).alias("k")).where("k is not null")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (PER_KEY * found.count()).bit_length()))
    parts = bits // PART_BITS

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(0), bits))
            part = (at // np.uint64(PART_BITS)).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(at)] if len(at) else np.zeros(1, int)
            low = (at % np.uint64(PART_BITS)).astype("<u4")
            pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in pairs], pa.int32()), pa.array([low[a:z].tobytes() for a, z in pairs], pa.binary())], names=["part", "data"])

    def united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, d in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                total.setdefault(p, np.zeros(PART_BITS, bool))[np.frombuffer(d, "<u4")] = True
        for p, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(v).tobytes()], pa.binary())], names=["part", "data"])

    marked = found.mapInArrow(lean(mark), "part int, data binary")
    rows = marked.repartition(min(parts, 64), "part").mapInArrow(lean(united), "part int, data binary").collect()
    by_part = {r["part"]: bytes(r["data"]) for r in rows}
    return b"".join(by_part.get(p, bytes(PART_BITS // 8)) for p in range(parts))


class Bits:
    """Answers for a table of ``key_bits``."""

    def __init__(self, packed: bytes):
        self.packed = np.frombuffer(packed, np.uint8)

    def of(self, column: pa.Array) -> np.ndarray:
        at = _places(column, 8 * len(self.packed))
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def maybe_in(df: DataFrame, column: str, packed: bytes) -> DataFrame:
    """The rows whose long in ``column`` (never null) may be among the keys."""
    return map_batches(df, lambda b: [b.filter(pa.array(Bits(packed).of(b.column(column))))], df.schema)


#: Rows of one key that a task gets at least before the key is dealt over several.
DEALT_ROWS = 256


def spread_join(rows: DataFrame, table: DataFrame, on: str, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a saved ``table`` that has one row for each ``on`` and the number ``n`` of rows that ask for it (dropped).

    Keys with more than an eighth of a task's average share are dealt over several tasks by a hash of ``by``; there are eight of them
    for each task at most, which bounds what is broadcast.
    """
    into = partitions(rows.sparkSession)
    most = max(DEALT_ROWS, int(table.agg(F.sum("n")).first()[0] or 0) // (8 * into))
    salts = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(table.where(F.col("n") > most).select(F.col(on).alias("_hot"), salts.alias("_salts")))
    salt = F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")
    salted = rows.join(hot, F.col(on) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("n")
    return salted.join(dealt, [on, "_salt"], how).drop("_salt")


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1 and so on: whatever they are called, nothing clashes with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, columns: list[str], *more: str | Column) -> DataFrame:
    """The columns of ``numbered`` under their names again, and ``more``."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *more)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no model learns from: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: means, deviations, coefficients (intercept first)."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / dev]
    w, weight = np.zeros(z.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (p - y)) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w
