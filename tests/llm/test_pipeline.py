"""The pipeline's stages on the smallest tables, each on its own input, and queries that have SQL."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from burrow.llm import packing, quality
from burrow.llm import queries as Q
from burrow.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for _, f in P.STAGES:
        docs = f(spark, docs, sf).cache()
        out.append((docs.columns, docs.collect()))
    return out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_stages_keep_the_columns(spark, sf, steps):
    want = table(spark, sf, "documents").columns
    assert [c for c, _ in steps[:-1]] == [want] * 4
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_rejected_documents_go(spark, sf, steps):
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"), quality.learnable)
    want = Counter(r["doc_id"] for r in quality.score(docs, model).where(f"score >= {P.LEAST_QUALITY}").collect())
    assert ids(steps[0][1]) == want


def test_repeated_lines_go(steps):
    before = {r["doc_id"]: r for r in steps[0][1]}
    seen = set()
    for r in steps[1][1]:
        assert r["n_chars"] == len(r["text"]) and r["source"] == before[r["doc_id"]]["source"]
        seen |= set(r["text"].split("\n"))
    assert {x for r in before.values() for x in r["text"].split("\n")} <= seen | {""}
    long_ = Counter(x for r in steps[1][1] for x in r["text"].split("\n") if len(x.split()) >= 50)
    assert not long_ or max(long_.values()) == 1


def test_one_of_each_group_stays(steps):
    def sets(rows):
        out = {}
        for r in rows:
            w = r["text"].encode().lower().split()
            out[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        return out

    all_, kept = sets(steps[1][1]), sets(steps[2][1])

    def near(a, b):
        n = len(a & b)
        return n and 100 * n >= 75 * (len(a) + len(b) - n)

    root = {k: k for k in all_}
    for a in all_:
        for b in all_:
            if a < b and near(all_[a], all_[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert set(kept) == set(root.values()) and ids(steps[2][1]).most_common(1)[0][1] == 1


def test_the_mix_takes_whole_copies(steps):
    words = {r["doc_id"]: len(r["text"].encode().split()) for r in steps[2][1]}
    source = {r["doc_id"]: r["source"] for r in steps[2][1]}
    taken, size = Counter(), Counter()
    for k, n in words.items():
        size[source[k]] += n
    for k, n in ids(steps[3][1]).items():
        assert n <= 3
        taken[source[k]] += n * words[k]
    from burrow.llm.mixing import targets

    want = targets(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))})
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(n for k, n in words.items() if source[k] == s)


def test_all_tokens_are_packed(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in steps[4][1]:
        pieces[r["doc_id"], r["piece"]].append((r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = {r["doc_id"]: r["text"] for r in steps[3][1]}
    for k, n in ids(steps[3][1]).items():
        found = np.array([*t.encode(texts[k], add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(found), 2048)):
            part = found[at : at + 2048]
            assert pieces.pop((k, p)) == [(len(part), zlib.crc32(part.tobytes()))] * n
    assert not pieces
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 2048


def test_run_equals_the_stages(spark, sf, steps):
    assert ids(P.run(spark, sf).collect()) == ids(steps[4][1])


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    other = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in other.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in other.fetchall())
    df = Q.queries()[name](spark, sf)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
        ("op2_", "doc_id text n_lines n_removed"),
        ("op3_", "doc_id n_tokens"),
        ("op4_", "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"),
        ("op5_", "doc_id piece start length ids_crc32 sequence_id offset"),
        ("op6_", "doc_id held_out lang_pred score"),
        ("op7_", "doc_id n_assign n_access n_hex n_entropy base_sha256 spans"),
        ("op8_", "doc_id held_out score predicted"),
        ("op9_", "doc_id size source_size target taken"),
        ("op10_", "doc_id n_shingles component_id"),
    ],
)
def test_contract_columns(spark, sf, name, columns):
    found = [q for q in Q.queries() if q.startswith(name)]
    assert len(found) == 1
    df = Q.queries()[found[0]](spark, sf)
    assert df.columns[: len(columns.split())] == columns.split()
    docs = table(spark, sf, "documents").count()
    assert df.select("doc_id").distinct().count() == docs and (name == "op5_" or df.count() == docs)
