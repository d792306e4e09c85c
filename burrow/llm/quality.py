"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is compressed
with both; the difference of the two sizes over the text's own size, and the smaller of the two over it,
go through a logistic curve that was fitted on labelled texts that built neither dictionary.

Edge cases: a null or empty text has both features 0 and gets the curve's value there. Rows of ``labels`` with a
null or other quality are not learned from; a document with several labels counts as its smallest one. With
fewer than ``LEAST`` labelled texts of either class the score is 0.5 for every row. Repeated rows and ties
of ids are scored one by one; of rows that share an id one text is learned from. Texts of any length are learned from and
scored whole: only the dictionaries' own texts go to the driver, DICT_TEXTS bytes of each class at most (or its LEAST
shortest texts, if even they are longer); the calibration's are compressed where they are. Extra columns are neither read nor
returned by ``score``; ``keep_good`` returns them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, logistic, map_batches, texts

#: Labelled texts of each class that the dictionaries and the calibration learn from, and bytes of the texts that make one dictionary.
DICT_DOCS, CALIBRATION_DOCS, DICT_TEXTS = 2000, 4000, 16 << 20
DICT_BYTES, LEVEL, LEAST = 112_640, 3, 16
#: Added to a text's length in bytes before dividing: frame bytes say nothing on very short texts.
PAD = 16


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    dev: np.ndarray
    coef: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        return made

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.coef[0] + ((x - self.mean) / self.dev) @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(raw: list[bytes], pair: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Per text: (bad size - good size) / length, and the smaller size / length."""
    good, bad = (np.array([len(c.compress(t)) if t else 0 for t in raw], float) for c in pair)
    n = np.array([len(t) + PAD for t in raw], float)
    return np.stack([(bad - good) / n, np.minimum(good, bad) / n], 1).reshape(len(raw), 2)


def chosen(sizes: list[tuple[int, object, int]]) -> list:
    """Of (size, id, text's hash) in order: those that fit into DICT_TEXTS one after the other; where they are fewer than LEAST, the shortest."""
    out, left = [], DICT_TEXTS
    for n, *key in sizes:
        if n <= left:
            out.append(tuple(key))
            left -= n
    return out if len(out) >= LEAST // 2 else [tuple(key) for _, *key in sorted(sizes, key=lambda s: s[0])[: LEAST // 2]]


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model | None:
    """Learns from a bounded sample: at most DICT_DOCS + CALIBRATION_DOCS labelled texts of each class, the first by a hash of the id.

    ``usable`` (over doc_id) says which rows may be learned from.
    """
    spark = docs.sparkSession
    by_doc = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).where("_id is not null and _q in (0, 1)")
    if usable is not None:
        by_doc = by_doc.where(usable(F.col("_id")))
    by_doc = by_doc.groupBy("_id").agg(F.min("_q").cast("int").alias("_q"))
    share = {r["_q"]: r["n"] for r in by_doc.groupBy("_q").agg(F.count("*").alias("n")).collect()}
    most, some = DICT_DOCS + CALIBRATION_DOCS, None
    for q in (0, 1):
        part = by_doc.where(F.col("_q") == q).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(most)
        some = part if some is None else some.unionAll(part)
    # at most 2 * most ids: small enough to send to every task, so the texts are filtered where they are read
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where("_t != ''").withColumn("_x", F.xxhash64("_t"))
    sized = rows.join(F.broadcast(some), "_id").groupBy("_id", "_q", "_h").agg(F.min(F.struct("_x", F.octet_length("_t").alias("n"))).alias("t"))
    found: dict[int, list] = {0: [], 1: []}
    for r in sorted(sized.select("_q", "_h", "_id", "t._x", "t.n").collect(), key=lambda r: (r["_h"], str(r["_id"]))):
        found[r["_q"]].append((r["n"], r["_id"], r["_x"]))
    if min(map(len, found.values())) < LEAST:
        return None
    kind = docs.schema["doc_id"].dataType.simpleString()
    split = {q: min(DICT_DOCS, len(f) // 2) for q, f in found.items()}
    wanted = [(q, i, *key) for q, f in found.items() for i, key in enumerate(chosen(f[: split[q]]))]
    named = F.broadcast(spark.createDataFrame(wanted, f"_q int, _n int, _id {kind}, _x long"))
    texts_of = rows.join(named, ["_id", "_x"]).groupBy("_q", "_n").agg(F.first("_t").alias("_t")).orderBy("_q", "_n").collect()
    built = {}
    for q in (0, 1):
        ts = [r["_t"].encode() for r in texts_of if r["_q"] == q]
        try:
            built[q] = zstandard.train_dictionary(DICT_BYTES, ts).as_bytes()
        except zstandard.ZstdError:  # too few texts to choose from: they are the dictionary themselves
            built[q] = b"".join(ts)[-DICT_BYTES:]
    model = Model(built[1], built[0], np.zeros(2), np.ones(2), np.zeros(3))
    rest = F.broadcast(spark.createDataFrame([(q, *key) for q, f in found.items() for _, *key in f[split[q] :]], f"_q int, _id {kind}, _x long"))

    def measure(b: pa.RecordBatch):
        x = features(texts(b, "_t"), model.compressors())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x[:, 0]), pa.array(x[:, 1])], names=["_q", "_id", "_x", "a", "b"])

    seen = map_batches(rows.join(rest, ["_id", "_x"]).select("_q", "_id", "_x", "_t"), measure, f"_q int, _id {kind}, _x long, a double, b double")
    seen = seen.groupBy("_q", "_id", "_x").agg(F.first("a").alias("a"), F.first("b").alias("b")).select("_q", "a", "b").orderBy("_q", "a", "b").collect()
    x, y = np.array([(r["a"], r["b"]) for r in seen]).reshape(-1, 2), np.array([r["_q"] for r in seen], float)
    weight = np.where(y == 1, share[1] / max(1, y.sum()), share[0] / max(1, (1 - y).sum())) * len(y) / (share[0] + share[1])
    model.mean, model.dev, model.coef = logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""

    def run(b: pa.RecordBatch):
        s = np.full(b.num_rows, 0.5) if model is None else model.score(features(texts(b), pair()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kept: list = []

    def pair() -> list[zstandard.ZstdCompressor]:
        if not kept:
            kept.extend(model.compressors())
        return kept

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more."""
    kept: list = []

    def run(b: pa.RecordBatch):
        if model is None:
            yield b
            return
        if not kept:
            kept.extend(model.compressors())
        yield b.filter(pa.array(model.score(features(texts(b), kept)) >= least))

    return map_batches(docs, run, docs.schema)


def learnable(doc_id: Column) -> Column:
    return ~held_out(doc_id)
