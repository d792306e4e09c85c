"""Language ID: word first, then ever shorter character n-grams.

Learning counts the words of each language's texts and the character n-grams of those words, all of them. A known word gets
its log frequency in each language (add-``ALPHA`` where a language lacks it). An unseen word falls back to its n-grams,
the longest length of which at least half are known: the mean log frequency of those n-grams. A text's
score of a language is the sum over its words; the posterior over languages, cooled for long texts, is its score.

Edge cases: a null text and a text without a letter are ``und`` with score 0. Rows without a language
are not learned from. With nothing to learn from, every row is ``und``. Ties go to the language that is first by
name. Repeated rows are predicted one by one; extra columns are neither read nor returned.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, map_batches, modest, small, texts

#: Documents of each language to learn from, and bytes of their texts (about as many, chosen by a hash): whichever comes first.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
LONGEST_GRAM, ALPHA = 5, 0.5
#: Words at most that count as independent evidence.
EVIDENCE = 12
LETTERS = re.compile(r"[^\W\d_]+")
#: Chunks and words within them that one worker remembers, and the longest that it does.
KEPT, KEPT_WORDS, LONGEST = 250_000, 250_000, 120


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, entry, k) of a task's share of the sample; n 0: words."""
    of: dict[str, Counter] = {}
    for b in small(batches):
        for raw, lang in zip(texts(b), b.column("lang").to_pylist(), strict=True):
            of.setdefault(lang, Counter()).update(LETTERS.findall(raw.decode("utf-8", "replace").lower()))
    for lang, words in of.items():
        for n in range(LONGEST_GRAM + 1):
            c = Counter() if n else words
            if n:
                for w, k in words.items():
                    for g in grams(w, n):
                        c[g] += k
            entries = list(c)
            for k in range(0, len(entries), 50_000):
                part = entries[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([n] * len(part), pa.int32()), pa.array(part, pa.string()), pa.array([c[e] for e in part], pa.int64())], names=["lang", "n", "entry", "k"])


class Model:
    """Log frequencies by kind: entry -> one number per language (plain numbers: rows are too short for vectors to pay)."""

    def __init__(self, found: pa.Table):
        """``found``: lang, n (0: words), entry and k."""
        self.key = uuid.uuid4().hex
        self.langs = sorted(pc.unique(found["lang"]).to_pylist())
        same: dict[tuple[float, ...], tuple[float, ...]] = {}  # most rare entries have the same few counts
        self.kinds: list[dict[str, tuple[float, ...]]] = []
        for n in range(LONGEST_GRAM + 1):
            part = found.filter(pc.equal(found["n"], n)).combine_chunks()
            coded = pc.dictionary_encode(part["entry"].combine_chunks())
            at, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            col = pc.index_in(part["lang"], pa.array(self.langs, pa.string())).to_numpy(zero_copy_only=False)
            k = np.zeros((len(names), len(self.langs)))
            np.add.at(k, (at, col), part["k"].to_numpy())
            logs = np.log((k + ALPHA) / (k.sum(0) + ALPHA * (len(names) + 1)))
            self.kinds.append({e: same.setdefault(t, t) for e, t in zip(names, map(tuple, logs.tolist()), strict=True)})

    def word(self, w: str) -> tuple[float, ...] | None:
        found = self.kinds[0].get(w)
        if found is not None:
            return found
        for n in range(LONGEST_GRAM, 0, -1):
            parts = grams(w, n)
            known = [v for v in map(self.kinds[n].get, parts) if v is not None]
            if known and 2 * len(known) >= len(parts):
                return tuple(sum(c) / len(known) for c in zip(*known, strict=True))
        return None


class ChunkScores(dict):
    """bytes of a chunk -> number of its row in ``rows`` (log frequencies, words, letters)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.langs) + 2), np.float32)
        self.words: dict[str, int] = {}
        self.n = 0

    def add(self, row: np.ndarray) -> int:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = row
        self.n += 1
        return self.n - 1

    def word(self, w: str) -> int:
        at = self.words.get(w)
        if at is None:
            row, v = np.zeros(self.rows.shape[1], np.float32), self.model.word(w)
            row[-1] = len(w)
            if v is not None:
                row[:-2], row[-2] = v, 1
            at = self.add(row)
            if len(w) <= LONGEST:
                self.words[w] = at
        return at

    def __missing__(self, chunk: bytes) -> int:
        found = LETTERS.findall(chunk.decode("utf-8", "replace").lower())
        if len(found) == 1:  # nearly always
            at = self.word(found[0])
        else:
            at = self.add(self.rows[[self.word(w) for w in found]].sum(0))
        if len(chunk) <= LONGEST:
            self[chunk] = at
        return at

    def trim(self) -> None:
        if self.n > KEPT_WORDS:
            self.words.clear()
            self.n = 0
        if len(self) > KEPT or not self.n:
            self.clear()

    def total(self, text: bytes) -> np.ndarray:
        self.trim()
        parts = text.split()
        out = np.zeros(self.rows.shape[1])
        for i in range(0, len(parts), KEPT):  # a text of any length adds KEPT chunks at most at a time
            part = parts[i : i + KEPT]
            ids = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            out += self.rows[ids].sum(0, dtype=np.float64)
            self.trim()
        return out


def learn(docs: DataFrame, usable: Column | None = None) -> Model | None:
    """From about SAMPLE documents, or SAMPLE_BYTES of text, of each language, chosen by a hash of doc_id."""
    modest(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    if usable is not None:
        rows = rows.where(usable)
    have = {r["lang"]: min(1.0, SAMPLE / r["n"], SAMPLE_BYTES / max(1, r["size"])) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if not have:
        return None
    share = F.create_map(*[F.lit(x) for item in have.items() for x in item])
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    found = some.select("text", "lang").mapInArrow(lean(counts), "lang string, n int, entry string, k long").groupBy("lang", "n", "entry").agg(F.sum("k").alias("k")).toArrow()
    return Model(found) if found.num_rows else None


_made: dict[str, ChunkScores] = {}


def chunk_scores(model: Model) -> ChunkScores:
    """One cache for each worker process: that of the model it used last."""
    if model.key not in _made:
        _made.clear()
        _made[model.key] = ChunkScores(model)
    return _made[model.key]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(b: pa.RecordBatch):
        cache = chunk_scores(model)
        names, scores = [], []
        for t in texts(b):
            s = cache.total(t)
            if not s[-1]:
                names.append("und")
                scores.append(0.0)
                continue
            x = s[:-2] / max(1.0, s[-2] / EVIDENCE)
            p = np.exp(x - x.max())
            names.append(model.langs[int(p.argmax())])
            scores.append(float(p.max() / p.sum()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")
