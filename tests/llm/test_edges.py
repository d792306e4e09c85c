"""Brute-force versions of the operators that SQL can't express, and the pipeline's stages on tables that hold every odd case."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as P
from burrow.llm import common, language, line_dedup, media, mixing, near_join, quality, token_scan
from burrow.llm.common import held_out

from .test_operators import EDGES, LONG, by_id, components_by_hand, passage, prose

# 2 ---------------------------------------------------------------------------------------------------------------------


def deduped_by_hand(rows):
    """``rows``: (doc_id, hash, text). What goes, by looking at every chunk of every text one after the other."""
    first, every = {}, []
    order = sorted({r for r in rows if r[2]}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (_, _, text) in enumerate(order):
        lines = text.encode().split(b"\n")
        for a, n in line_dedup.chunks(lines, [len(x.split()) for x in lines]):
            body = b"\n".join(lines[a : a + n])
            every.append((k, a, n, body))
            first.setdefault(body, (k, a))
    gone = defaultdict(set)
    for k, a, n, body in every:
        if (one := first[body]) != (k, a):
            mine, other = order[k][2].encode().split(b"\n"), order[one[0]][2].encode().split(b"\n")
            gone[k].update(range(a, a + n))
            for step, at, to in ((-1, a - 1, one[1] - 1), (1, a + n, one[1] + n)):
                for _ in range(line_dedup.CONTEXT):
                    if not (0 <= at < len(mine) and 0 <= to < len(other)) or mine[at] != other[to] or len(other[to].split()) >= line_dedup.LONG_WORDS:
                        break
                    gone[k].add(at)
                    at, to = at + step, to + step
    left = {r: "\n".join(x for i, x in enumerate(r[2].split("\n")) if i not in gone[k]) for k, r in enumerate(order)}
    return [(r[0], left.get(r, r[2]), len(gone[order.index(r)]) if r in left else 0) for r in rows]


def passages(seed):
    """Documents that hold whole passages, parts of them and lines of their own, in any order."""
    r = random.Random(seed)
    pool = [passage(1000 * seed + i, r.choice([2, 3, 5, 9, 14])).split("\n") for i in range(9)] + [[prose(7 * seed + i, 60).replace("\n", " ")] for i in range(3)]
    rows = []
    for i in range(45):
        lines = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(pool)
            a = r.randrange(len(p)) if r.random() < 0.4 else 0
            lines += p[a : a + r.randint(1, len(p))] if r.random() < 0.4 else p
            lines += [prose(9999 * seed + 100 * i + k, r.choice([0, 2, 9])).replace("\n", " ") for k in range(r.randint(0, 2))]
        rows.append((r.choice([i, i, i, 3, None]), "\n".join(lines)))
    return [*rows, rows[5], (60, None), (61, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_by_brute_force(spark, make, monkeypatch, seed):
    """All that goes, whatever the partitions, and with frequent chunks dealt over several tasks."""
    if seed == 3:
        monkeypatch.setattr(line_dedup, "COPIES", 2)
    docs = make(*passages(seed))
    rows = [tuple(r) for r in docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)), "text").collect()]
    want = Counter(deduped_by_hand(rows))
    assert any(n for _, _, n in want)
    for df in (docs, docs.repartition(7)):
        assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup(df).collect()) == want


def test_line_dedup_ties_of_one_id(spark, make):
    p = passage(4)
    texts = [f"{p}\nend {i} of all that {i} was said about it" for i in range(4)]
    out = [r["n_removed"] for r in line_dedup.dedup(make(*((1, t) for t in texts))).collect()]
    assert sorted(out) == [0, 6, 6, 6]


# 3 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_separator_scan_in_runs(spark, monkeypatch, span):
    """Runs of few blocks, documents over several of them, files without any end, and ranges of large files."""
    monkeypatch.setattr(token_scan, "SPAN", span)
    r = random.Random(span)
    files = {f"f{k}": [r.choice([0, 1, 2, 9, 9]) if k else 1 for _ in range(r.randint(0, 60))] for k in range(6)}
    blocks = [(f, i, bytearray(np.array(x[k : k + 4], "<u2").tobytes())) for f, x in files.items() for i, k in enumerate(range(0, len(x), 4))]
    df = spark.createDataFrame(blocks, "file string, block int, data binary").repartition(3)
    got = sorted((x["file"], x["document"], x["n_tokens"], x["closed"]) for x in token_scan.document_lengths(df, end=9).collect())
    want = []
    for f, x in files.items():
        parts = "".join("|" if t == 9 else "." for t in x).split("|")
        want += [(f, i, len(p), True) for i, p in enumerate(parts[:-1])] + [(f, len(parts) - 1, len(parts[-1]), False)] * bool(parts[-1])
    assert got == sorted(want)


def test_large_token_files_are_read_by_ranges(spark, tmp_path):
    r = np.random.default_rng(1)
    for k, n in enumerate((5, 4000, 10_001)):
        (tmp_path / f"{k}.bin").write_bytes(r.integers(0, 20, n).astype("<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")

    def read(whole):
        return sorted((x["file"], x["block"], bytes(x["data"])) for x in token_scan.blocks_of_files(spark, str(tmp_path), tokens=64, whole=whole).collect())

    by_range, at_once = read(1000), read(1 << 20)
    assert by_range == at_once and len(at_once) == 1 + 63 + 157
    assert b"".join(d for f, _, d in at_once if f.endswith("2.bin")) == (tmp_path / "2.bin").read_bytes()


def test_token_counts_of_nothing(spark, make):
    docs = make(*EDGES[:3])
    assert token_scan.token_counts(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).repartition(9)
    assert by_id(token_scan.token_counts(named), "n_tokens") == {"d1": 0, "d2": 0, "d3": 1}


# 4 ---------------------------------------------------------------------------------------------------------------------


def feature_by_hand(raw):
    """Frames, cuts and histograms of a stored file, bit by bit and sample by sample."""
    hist, at = [], raw.index(b"movi") + 4
    while raw[at : at + 4] == b"00dc":
        size = struct.unpack_from("<I", raw, at + 4)[0]
        frame = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
        scan = frame[frame.index(b"\xff\xda") + 10 : -2]
        bins = np.zeros(16)
        for part in re.split(rb"\xff[\xd0-\xd7]", scan):
            bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\0", b"\xff"))
            units = [int(bits[i + 1 : i + 9], 2) for i in range(0, len(bits) // 9 * 9, 9)]
            dc = 0
            for k in range(0, len(units) // 64 * 64, 64):
                c = [u if u >= 128 else u - 255 for u in units[k : k + 64]]
                dc += c[0]
                grid = np.zeros((8, 8))
                grid.ravel()[media.ZIGZAG] = [dc, *c[1:]]
                a = np.array([[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
                pixel = np.clip(np.rint(a.T @ grid @ a) + 128, 0, 255)
                bins += np.bincount((pixel // 16).astype(int).ravel(), minlength=16)
        hist.append(bins / bins.sum())
    return np.array(hist)


def cuts_by_hand(hist):
    out, known = [0], []
    for i in range(1, len(hist)):
        d = float(np.abs(hist[i] - hist[i - 1]).sum())
        last = known[-media.WINDOW :]
        if d > (max(np.mean(last) + media.SPREAD * np.std(last), media.LEAST) if len(last) >= media.HISTORY else media.START):
            out.append(i)
        else:
            known.append(d)
    return out


def test_media_feature_by_hand():
    for text in (b"", prose(1, 900).encode(), prose(2, 300).encode() * 2 + b"\0" * 5000 + "日本語".encode() * 500, bytes(range(256)) * 30):
        raw = media.write_avi(text + bytes(-len(text) % 64 or (0 if text else 64)))
        avi, hist, cuts, _ = media.scan_media(raw)
        want = feature_by_hand(raw)
        assert len(avi.frames) == len(want) and np.abs(hist - want).max() < 0.01
        assert cuts == cuts_by_hand(hist)
        mean = np.array([int(re.search("luma=([0-9a-f]+)", media.feature(hist, cuts))[1][i : i + 4], 16) for i in range(0, 64, 4)]) / 65_535
        assert np.abs(mean - want.mean(0)).max() < 0.01
        clips = media.timed(avi, hist, cuts)
        assert [c["first_frame"] for c in clips] == cuts and sum(c["frames"] for c in clips) == len(hist) and clips[-1]["end_s"] == pytest.approx(len(hist) / media.FPS)


def test_cuts_right_after_one_another_and_at_the_start():
    still, other, third = (np.eye(16)[[k] * 9] for k in (1, 5, 9))
    assert media.shots(np.concatenate([still[:1], other[:2], still, other[:4], third])) == [0, 1, 3, 12, 16]


def test_bits_in_any_order():
    r = random.Random(2)
    bits = "".join(r.choice("01") for _ in range(4000))
    raw = int(bits, 2).to_bytes(500, "big")
    b, at = media.Bits(raw), 0
    codes = media.lookup((((1, 0), 7), ((2, 2), 3), ((3, 6), 5)))
    while at < 3900:
        if r.random() < 0.5:
            n = r.randint(1, 16)
            assert b.take(n) == int(bits[at : at + n], 2)
            at += n
        elif bits[at : at + 3] != "111":
            n, symbol = (1, 7) if bits[at] == "0" else (2, 3) if bits[at + 1] == "0" else (3, 5)
            assert b.symbol(codes) == symbol
            at += n
        else:
            with pytest.raises(media.MediaError):
                b.symbol(codes)
            assert b.take(3) == 7
            at += 3
    with pytest.raises(media.MediaError):
        media.Bits(b"\0").take(9)


def test_segments_of_large_files():
    frames = [media.frames_of(bytes([k]) * media.FRAME_BYTES)[0] for k in range(5)]
    body = lambda some: media.chunk(b"LIST", b"movi" + b"".join(media.chunk(b"00dc", f) for f in some))
    hdrl = media.chunk(b"LIST", b"hdrl" + media.chunk(b"avih", struct.pack("<I", 40_000) + bytes(52)))
    at, rows = 4, b""
    for f in frames[:2]:
        rows += struct.pack("<4sIII", b"00dc", 16, at, len(f))
        at += 8 + len(f) + len(f) % 2
    raw = media.chunk(b"RIFF", b"AVI " + hdrl + body(frames[:2]) + media.chunk(b"idx1", rows)) + media.chunk(b"RIFF", b"AVIX" + body(frames[2:4])) + media.chunk(b"RIFF", b"AVIX" + body(frames[4:]))
    assert [bytes(f) for f in media.read_avi(raw).frames] == frames


# 6 ---------------------------------------------------------------------------------------------------------------------


def language_by_hand(learned, asked):
    words, kinds = {}, []
    for text, lang in learned:
        words.setdefault(lang, Counter()).update(re.findall(r"[^\W\d_]+", text.lower()))
    langs = sorted(words)

    def parts(w, n):
        w = f"<{w}>" if n > 1 else w
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    for n in range(6):
        count = {x: Counter() for x in langs}
        for x in langs:
            for w, k in words[x].items():
                for g in parts(w, n) if n else [w]:
                    count[x][g] += k
        kinds.append((count, {g for c in count.values() for g in c}))

    def score(n, g):
        count, known = kinds[n]
        return [math.log((count[x][g] + 0.5) / (sum(count[x].values()) + 0.5 * (len(known) + 1))) for x in langs]

    def word(w):
        if w in kinds[0][1]:
            return score(0, w)
        for n in range(5, 0, -1):
            known = [g for g in parts(w, n) if g in kinds[n][1]]
            if known and 2 * len(known) >= len(parts(w, n)):
                return np.mean([score(n, g) for g in known], 0).tolist()
        return None

    out = []
    for text in asked:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        scores = [s for s in map(word, found) if s is not None]
        if not found:
            out.append(("und", 0.0))
            continue
        x = np.sum(scores, 0) if scores else np.zeros(len(langs))
        x = x / max(1.0, len(scores) / language.EVIDENCE)
        p = np.exp(x - x.max())
        out.append((langs[int(p.argmax())], float(p.max() / p.sum())))
    return out


def test_language_by_brute_force(spark, make):
    r = random.Random(3)
    pools = {x: ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(80)] for x, letters in (("aa", "abcdeé"), ("bb", "cdefgh"), ("cc", "日本語中文"))}
    rows = [(i, " ".join(r.choices(pools[x], k=r.randint(1, 40))), x) for i, x in enumerate(r.choices(sorted(pools), k=120))]
    rows += [(200, "q" * 130 + " nothing", "aa"), (201, None, "aa"), (202, "abc", None)]
    model = language.learn(make(*rows))
    texts = ["", None, "!!", "q" * 130, "qqq zzz", "xyzw", LONG[:3000], *(" ".join(r.choices(pools[x], k=5) + ["".join(r.choices("abcdefgh", k=6))]) for x in r.choices(sorted(pools), k=60))]
    got = by_id(language.identify(make(*enumerate(texts)), model), "lang_pred", "score")
    want = language_by_hand([(t, x) for _, t, x in rows if t is not None and x is not None], texts)
    for i, (lang, score) in enumerate(want):
        assert got[i][1] == pytest.approx(score, abs=2e-4), texts[i]
        if score > 0.6 or lang == "und":
            assert got[i][0] == lang
    assert language.identify(make(*rows).limit(0), model).count() == 0


def test_language_sample_is_bounded(spark, make, monkeypatch):
    rows = [(i, f"word{'abcdefghij'[i % 10]} " * 50, "en") for i in range(400)]
    monkeypatch.setattr(language, "SAMPLE_BYTES", 30_000)
    model = language.learn(make(*rows))
    assert 0 < len(model.kinds[0]) <= 11


# 8 ---------------------------------------------------------------------------------------------------------------------


def labelled(n=400):
    rows = [(i, prose(i, 80) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 80).split())) for i in range(n)]
    return rows, [(i, int(i % 3 > 0)) for i in range(n)]


def test_quality_score_by_brute_force(spark, make):
    rows, marks = labelled()
    docs, labels = make(*rows, *((1000 + i, t) for i, (_, t) in enumerate(EDGES))), spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(docs, labels, quality.learnable)
    pair = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = by_id(quality.score(docs, model), "score")
    for k, t in [*rows, *((1000 + i, t) for i, (_, t) in enumerate(EDGES))]:
        raw = (t or "").encode()
        good, bad = (len(c.compress(raw)) if raw else 0 for c in pair)
        x = [(bad - good) / (len(raw) + quality.PAD), min(good, bad) / (len(raw) + quality.PAD)]
        z = model.coef[0] + sum(c * (v - m) / d for c, v, m, d in zip(model.coef[1:], x, model.mean, model.dev, strict=True))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_never_learns_from_held_out_rows(spark, make):
    rows, marks = labelled()
    docs = make(*rows)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, q in marks]
    one, two = (quality.fit(d, spark.createDataFrame(m, "doc_id long, quality int"), quality.learnable) for d, m in ((docs, marks), (docs.repartition(6), flipped)))
    assert one.good == two.good and one.bad == two.bad and np.allclose(one.coef, two.coef)


def test_quality_of_long_texts(spark, make, monkeypatch):
    """Texts that are longer than the dictionaries' share are learned from all the same."""
    monkeypatch.setattr(quality, "DICT_TEXTS", 1000)
    rows, marks = labelled(200)
    docs = make(*((k, t + t[::-1]) for k, t in rows))
    model = quality.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert model is not None
    got = by_id(quality.score(docs, model), "score")
    assert sum((got[k] >= 0.3) == bool(q) for k, q in marks) > 0.9 * len(marks)


# 10 --------------------------------------------------------------------------------------------------------------------


def test_shared_hashes_are_told_apart(spark, make, monkeypatch):
    """Different sets whose first 64 bits are equal."""
    whole = near_join.shingles.key
    monkeypatch.setattr(near_join.shingles, "key", lambda s: (whole(s)[0] % 7, whole(s)[1]) if len(s) else (0, 0))
    rows = [(i, prose(i // 2, 40) + (" x" if i % 2 else "")) for i in range(24)] + [(30, None), (31, "")]
    assert by_id(near_join.join(make(*rows)), "n_shingles", "component_id") == components_by_hand(rows)


def test_counts_beyond_a_byte(spark):
    v = np.zeros(near_join.CELLS, np.int64)
    v[[0, 5, near_join.CELLS - 1]] = 255, 256, 10**9
    data, more = near_join.in_parts(v)
    rows = [(i, bytearray(d), bytearray(m)) for _ in range(3) for i, (d, m) in enumerate(zip(data, more, strict=True))]
    got = near_join.summed(spark.createDataFrame(rows, "part int, data binary, more binary"))
    assert (got == 3 * v.astype(np.uint64)).all()


def test_key_bits(spark, monkeypatch):
    monkeypatch.setattr(common, "PART_BITS", 1 << 10)
    monkeypatch.setattr(common, "LEAST_BITS", 1 << 11)
    r = random.Random(6)
    keys = [r.randrange(-(2**63), 2**63) for _ in range(3000)]
    df = spark.createDataFrame([(k, "t") for k in keys] + [(None, "u")], "k long, t string")
    others = [r.randrange(-(2**63), 2**63) for _ in range(3000)]
    asked = spark.createDataFrame([(k,) for k in keys + others], "k long")
    found = {x["k"] for x in common.maybe_in(asked, "k", common.key_bits(df, "k")).collect()}
    assert set(keys) <= found and len(found) < 3000 + 600
    assert common.maybe_in(asked, "k", common.key_bits(df.limit(0), "k")).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------------

CLASHING = ["_id", "_at", "n_removed", "n_lines", "_mix", "_copy", "_hash", "_q", "_x", "stays", "copies", "mix", "key", "h", "size", "parts", "hash", "text_hash", "node", "c0", "c1", "start"]


def odd_documents(spark):
    r, rows = random.Random(8), []
    shared = passage(77, 5)
    for i in range(220):
        text = prose(i, 60 + i % 50) if i % 4 else " ".join(w.upper() + "!!" for w in prose(i, 60).split())
        if i % 9 == 1:
            text = prose(3, 90) + (" more" if i % 2 else "")
        if i % 11 == 2:
            text = f"{text}\n{shared}\n{prose(5000 + i, 20)}"
        rows.append((r.choice([i, i, i, 7, None]), text, r.choice(["en", None]), r.choice(["a", "a", "b", "c", None])))
    rows += [(300, None, "en", "a"), (301, "", None, None), (None, None, None, None), (302, " \n ", "en", "b"), rows[5], rows[6], rows[6]]
    df = spark.createDataFrame([(*x, len(x[1]) if x[1] is not None else None) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("row", F.monotonically_increasing_id()).withColumn("tags", F.create_map(F.lit("k"), F.col("lang")))
    for c in CLASHING:
        df = df.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("row").cast("string")))
    return df


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    odd_documents(spark).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(220)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_on_odd_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    steps = [docs.collect()]
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, odd).cache()
        assert docs.columns == spark.read.parquet(f"{odd}/documents.parquet").columns
        steps.append(docs.collect())
    for r in (x for s in steps for x in s):
        assert all(r[c] == f"{c} of {r['row']}" for c in CLASHING) and (r["tags"] == {"k": r["lang"]})
    start, good, lines, near, mixed = ({x["row"]: x for x in s} for s in steps)
    # each stage keeps rows apart, whatever ids they share
    assert all(len(s) == len(by) for s, by in zip(steps[:4], (start, good, lines, near), strict=True))
    model = quality.fit(spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/labels.parquet"), quality.learnable)
    scores = by_id(quality.score(spark.read.parquet(f"{odd}/documents.parquet").withColumn("doc_id", F.col("row")), model), "score")
    assert set(good) == {k for k, s in scores.items() if s >= P.LEAST_QUALITY}
    hashes = {r["row"]: r["x"] for r in spark.createDataFrame([(k, x["text"]) for k, x in good.items()], "row long, text string").select("row", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("x")).collect()}
    by_hand = deduped_by_hand([(x["doc_id"], hashes[k], x["text"]) for k, x in good.items()])
    want = {k: t for k, (_, t, n) in zip(good, by_hand, strict=True) if t != "" or not n}
    assert {k: x["text"] for k, x in lines.items()} == want and any(want[k] != good[k]["text"] for k in want)
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in lines.values())
    groups = components_by_hand([(k, x["text"]) for k, x in lines.items()])
    members = defaultdict(list)
    for k, (n, g) in groups.items():
        if n:
            members[g].append(k)
    for rows in members.values():
        kept = [k for k in rows if k in near]
        assert len(kept) == 1
        ids = [lines[k]["doc_id"] for k in rows]
        assert near[kept[0]]["doc_id"] == min((i for i in ids if i is not None), default=None)
    assert all(k in near for k, (n, _) in groups.items() if not n)
    words, taken, size = {k: len((x["text"] or "").encode().split()) for k, x in near.items()}, Counter(), Counter()
    times = Counter(x["row"] for x in steps[4])
    assert set(mixed) <= set(near) and max(times.values()) <= 3
    for k, n in words.items():
        size[near[k]["source"]] += n
        taken[near[k]["source"]] += n * times[k]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in mixing.targets(dict(size), dict(zip(names, (5, 2, 1, 5), strict=False))).items():
        assert abs(taken[s] - t) <= max(n for k, n in words.items() if near[k]["source"] == s)
    assert P.run(spark, odd).count() >= len(steps[4])


def test_stages_on_an_empty_table(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, odd).count() == 0, name


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())


def test_held_out_of_nulls(spark):
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(held_out(F.col("id"))).first()[0] is False


def test_workers_keep_no_tables_of_their_last_task():
    """The token cache and the shingles' tables, over 100 MB, would stay beside whatever the worker does next."""
    from burrow.llm import packing, shingles, tokens

    def task(batches):
        for b in batches:
            ids = tokens.chunk_ids(packing.default_tokenizer()).of(b"two words")
            assert tokens._made and len(ids) and len(next(shingles.sets([b"two words"]))) == 1 and shingles._tables
            yield b

    assert len(list(common.lean(task)([1, 2]))) == 2
    assert not tokens._made and not shingles._tables


def test_workers_release_what_they_freed(monkeypatch):
    """A worker gives memory back when a task ends, whether it went through or not."""
    from burrow.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.lean(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and len(calls) == 1

    def fails(batches):
        yield next(iter(batches))
        raise ValueError

    found = common.lean(fails)([1])
    assert next(found) == 1
    try:
        next(found)
    except ValueError:
        pass
    assert len(calls) == 2
