"""Decoders, without Spark: each against bytes from a writer."""

import io
import lzma
import random
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import fixture_writers as W
from burrow.codecs import adc, compactpro, imuse, ppmd, rar, stuffit
from burrow.codecs.huffman import Bits, Code
from burrow.codecs.lzh import unpack as unlzh
from burrow.errors import ContainerError
from burrow.formats import mac
from burrow.formats.common import mode_text
from burrow.formats.detect import detect
from burrow.plans.expand import Options, Walk

MEMBERS = [("a.txt", b"hello world" * 60), ("b.dat", bytes(range(256)) * 3)]


def walk(name, data, **options):
    return list(Walk(Options(**options)).root(name, data))


def found(name, data, **options):
    return {e.path: e.data for e in walk(name, data, **options) if e.kind == "entry"}


@pytest.mark.parametrize(
    ("name", "raw"),
    [
        ("x.zip", W.zip_(MEMBERS)),
        ("x.tar", W.tar(MEMBERS)),
        ("x.pak", W.pak(MEMBERS)),
        ("x.bun", W.bundle(MEMBERS)),
        ("x.ima", W.fat(MEMBERS)),
        ("x.lzh", W.lha_stored(MEMBERS)),
        ("x.rar", W.rar4_stored(MEMBERS)),
        ("x.sit", W.stuffit_stored(MEMBERS)),
        ("x.cpt", W.compactpro_stored(MEMBERS)),
    ],
)
def test_members_come_back(name, raw):
    assert found(name, raw) == {f"{name}/{k}": v for k, v in MEMBERS}


def test_zip_variants():
    stored = walk("s.zip", W.zip_(MEMBERS, zipfile.ZIP_STORED))
    assert all(e.meta is None for e in stored if e.kind == "entry")
    lzma = walk("l.zip", W.zip_(MEMBERS, zipfile.ZIP_LZMA))
    assert {e.meta.compression_method for e in lzma if e.kind == "entry"} == {"compressed"}
    sizes = found("z.zip", W.zip_([("e", b""), ("f", b"12345"), ("g", b"x" * 7000)]))
    assert sorted(map(len, sizes.values())) == [0, 5, 7000]
    assert walk("e.zip", W.zip_([]))[0].code == "RootUnsupportedFormat"
    assert "u.zip/cafè_日本語.txt" in found("u.zip", W.zip_([("cafè_日本語.txt", b"x")]))
    assert set(found("d.zip", W.zip_([("../../etc/passwd", b"x"), ("normal/file.txt", b"y")]))) == {"d.zip/_/_/etc/passwd", "d.zip/normal/file.txt"}


def test_tar_links_and_modes():
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for kind, name in ((tarfile.REGTYPE, "f"), (tarfile.SYMTYPE, "s"), (tarfile.LNKTYPE, "h"), (tarfile.DIRTYPE, "d"), (tarfile.FIFOTYPE, "p")):
            e = tarfile.TarInfo(name)
            e.type, e.linkname, e.mode = kind, "f", 0o755
            t.addfile(e)
    rows = {e.path: e.meta.mode for e in walk("x.tar", out.getvalue()) if e.kind == "entry"}
    assert rows == {"x.tar/f": "-rwxr-xr-x", "x.tar/p": "-rwxr-xr-x"}
    assert mode_text(0o4755) == "-rwsr-xr-x" and mode_text(0o1754) == "-rwxr-xr-T" and mode_text(0o040700) == "drwx------"


def test_single_file_wrappers_take_the_outer_stem():
    assert found("d/test.txt.gz", W.gz(b"abc")) == {"d/test.txt.gz/test.txt": b"abc"}
    assert found("t.tar.xz", W.xz(W.tar(MEMBERS)), max_depth=1, entry_type="all").keys() == {"t.tar.xz/t.tar"}
    two = W.gz(b"first") + W.gz(b"second")
    assert found("m.gz", two) == {"m.gz/m": b"first"}
    assert walk("c.gz", W.gz(b"abc" * 99)[:-9])[0].code == "RootTraversalFailed"


def test_wad_repeats_names_and_counts_empty_lumps():
    raw = W.wad([("THINGS", b"1"), ("EMPTY", b""), ("THINGS", b"22")])
    events = walk("x.wad", raw)
    assert events[0].count == 3
    assert [(e.path, e.data) for e in events[1:]] == [("x.wad/THINGS", b"1"), ("x.wad/THINGS", b"22")]
    assert walk("x.wad", raw[:-5])[0].code == "RootUnsupportedFormat"


def test_scumm_plain_locked_and_damaged():
    assert list(found("x", W.scumm([b"one", b"two"]))) == ["x/SOUN/0000", "x/SOUN/0001"]
    assert list(found("x.lec", W.scumm([b"one"], 0x69))) == ["x.lec/SOUN/0000"]
    assert walk("x", W.scumm([b"one"], 0x69))[0].code == "RootUnsupportedFormat"
    damaged = b"LECF" + struct.pack(">I", 8 + 3 + 11) + b"\xff\xff\xff" + W.chunk(b"SCRP", b"abc")
    assert found("y", damaged) == {"y/SCRP/0000": b"abc"}


def test_speech_without_terminator():
    raw = W.speech([b"abc", b"d" * 70_000])
    assert list(found("x.sou", raw)) == ["x.sou/speech_0000.voc", "x.sou/speech_0001.voc"]
    assert len(found("x.sou", raw[:-1])) == 2
    assert walk("x.sou", raw + b"junk")[0].code == "RootUnsupportedFormat"


def test_bundle_codecs():
    assert imuse.undelta(bytes([1, 1, 1, 1]), 1) == bytes([1, 2, 3, 4])
    assert imuse.undelta(bytes([1, 1, 1, 1]), 2) == bytes([1, 2, 4, 7])
    # literals A and B, a match of 3 two back, then the end mark
    bits = [1, 1, 0, 0, 0, 0, 0, 1] + [0] * 8
    word = sum(b << i for i, b in enumerate(bits)).to_bytes(2, "little")
    assert imuse.unpack(word + b"AB" + b"\xfe" + b"\x00\x00\x00") == b"ABABA"
    track = b"COMP" + struct.pack(">III", 1, 0, 0) + struct.pack(">IIII", 32, 2, 13, 0) + b"zz"
    raw = b"LB83" + struct.pack(">II", 12 + len(track), 1) + track + struct.pack(">8s4sII", b"song", b"imx", 12, len(track))
    assert found("x.bun", raw) == {"x.bun/song.imx": track}


def test_vswap_names_lose_their_slash():
    raw = W.vswap([b"w" * 4096] * 30, [b"s" * 600] * 60, [b"n" * 100] * 20)
    names = list(found("v", raw))
    assert names[0] == "v/wall_0000" and names[30] == "v/sprite_0000" and names[-1] == "v/sound_0019"


def test_fat_details():
    raw = bytearray(W.fat([("A.TXT", b"x" * 700), ("EMPTY", b"")]))
    assert list(found("x.ima", bytes(raw))) == ["x.ima/a.txt"]
    # a chain in a circle ends
    struct.pack_into("<H", raw, 512 + 4, 2)
    assert len(found("x.ima", bytes(raw))["x.ima/a.txt"]) == 700


def test_partitions():
    disk = W.mbr([W.fat(MEMBERS, "DISK"), b"raw" * 300])
    assert {"d/DISK/a.txt", "d/p1.img"} <= set(found("d", disk))
    assert {"d/p0.img/a.txt", "d/p1.img"} <= set(found("d", disk, numeric=True))
    assert {"g/p0.img", "g/p1.img/a.txt"} <= set(found("g", W.gpt([b"raw" * 300, W.fat(MEMBERS)])))


def test_resource_fork_and_envelopes():
    fork = W.resource_fork([(b"STR ", 128, "nm", b"xx"), (b"STR ", -5, None, b"yy"), (b"\1\2\3\4", 1, "a/b", b"z")])
    assert mac.is_fork(fork)
    rows = walk("m.bin", W.macbinary("note", b"data", fork), entry_type="all")
    paths = [e.path for e in rows if e.kind == "entry"]
    base = "m.bin/note/..namedfork/rsrc"
    assert paths == ["m.bin/note", base, f"{base}/STR /nm", f"{base}/STR /#-5", f"{base}/0x01020304/a_b"]
    assert rows[1].meta.type_code == b"TEXT"
    assert f"{base}/STR /#128" in found("m.bin", W.macbinary("note", b"data", fork), numeric=True)
    single = walk("s", W.apple({1: b"data", 9: b"\0" * 32}))
    assert single[1].path == "s/untitled" and single[1].meta is not None and single[1].meta.type_code is None


@given(st.binary(max_size=400), st.binary(max_size=50))
@settings(max_examples=40, deadline=None)
def test_binhex_round_trip(data, fork):
    rows = [e for e in walk("x.hqx", b"From: me\n\n" + W.binhex("nöte", data, fork), max_depth=1, entry_type="all") if e.kind == "entry"]
    assert rows[0].path == "x.hqx/nöte" and rows[0].data == data


def test_binhex_checks_sums():
    raw = bytearray(W.binhex("n", b"some data"))
    raw[60] = ord("!") if raw[60] != ord("!") else ord('"')
    assert walk("x.hqx", bytes(raw))[0].kind == "diag"


def test_hfs_wrappers():
    disk = W.hfs([*MEMBERS, *((f"f{i}", b"z" * i) for i in range(1, 60))])
    plain = found("d.dsk", disk)
    assert plain["d.dsk/F/a.txt"] == MEMBERS[0][1] and len(plain) == 61
    copy = bytearray(84)
    copy[0x52:0x54] = b"\x01\x00"
    assert len(found("d.image", bytes(copy) + disk)) == 61
    disk = disk.ljust(-(-len(disk) // 512) * 512, b"\0")
    part = b"PM" + b"\0\0" + struct.pack(">II", 1, 2)
    apm = (b"ER" + struct.pack(">H", 512)).ljust(512, b"\0") + (part.ljust(48, b"\0") + b"Apple_HFS\0").ljust(512, b"\0") + disk
    assert len(found("d.toast", apm)) == 61
    whole = disk.ljust(-(-len(disk) // 2048) * 2048, b"\0")
    raw_cd = b"".join(b"\0" + b"\xff" * 10 + b"\0\0\0\0\x01" + whole[i : i + 2048] + b"\0" * 288 for i in range(0, len(whole), 2048))
    assert len(found("cd.iso", raw_cd)) == 61


def udif(disk: bytes, kind: int = 0x80000005) -> bytes:
    import base64

    packed = zlib.compress(disk)
    block = struct.pack(">IIQQQQ", kind, 0, 0, len(disk) // 512, 0, len(packed))
    mish = b"mish" + b"\0" * 20 + struct.pack(">Q", 0) + b"\0" * 4 + struct.pack(">I", 7)
    mish = mish.ljust(200, b"\0") + struct.pack(">I", 2) + block + struct.pack(">I", 0xFFFFFFFF) + b"\0" * 36
    xml = b"<key>blkx</key><array><dict><key>Data</key><data>" + base64.encodebytes(mish) + b"</data></dict></array>"
    tail = (b"koly".ljust(216, b"\0") + struct.pack(">QQ", len(packed), len(xml))).ljust(512, b"\0")
    return packed + xml + tail


def test_udif():
    disk = W.hfs(MEMBERS)
    disk = disk.ljust(-(-len(disk) // 512) * 512, b"\0")
    assert found("d.dmg", udif(disk))["d.dmg/F/a.txt"] == MEMBERS[0][1]
    assert "BZ2" in walk("d.dmg", udif(disk, 0x80000006))[0].message


def test_ndif_by_its_fork():
    disk = W.hfs(MEMBERS)
    n = -(-len(disk) // 512)
    disk = disk.ljust(512 * n, b"\0")
    m = struct.pack(">H", 12).ljust(68, b"\0") + struct.pack(">III", n, n, 0)
    m = m.ljust(124, b"\0") + struct.pack(">I", 2) + struct.pack(">I", 2)[:4] + struct.pack(">II", 0, len(disk)) + n.to_bytes(3, "big") + b"\xff" + b"\0" * 8
    fork = W.resource_fork([(b"bcem", 128, None, m)])
    # a plain descriptor: one chunk of raw blocks that starts at the data fork's first byte
    image = disk
    rows = list(Walk(Options()).root("n.img", image, fork))
    assert any(e.path == "n.img/F/a.txt" for e in rows)
    side = W.apple({2: fork}, double=True)
    hidden = W.zip_([("n.img", image), ("._n.img", side)])
    assert "z.zip/n.img/F/a.txt" in found("z.zip", hidden)
    assert not any("namedfork" in p for p in found("z.zip", hidden))


def test_codecs():
    assert stuffit.runs(b"AB\x90\x05", 6) == b"ABBBBB" and stuffit.runs(b"\x90\x00", 1) == b"\x90"
    assert compactpro.runs(b"A\x81\x82\x05", 5) == b"AAAAA"
    assert adc.unpack(b"\x82abc" + b"\x00\x02", 6) == b"abcabc"
    # what comes before the damage is kept: a reference before the start, literals and copies beyond the room, data that end early
    assert adc.unpack(b"\x82abc" + b"\x00\x09", 6) == b"abc"
    assert adc.unpack(b"\x82abc" + b"\x83defg", 6) == b"abc" and adc.unpack(b"\x82abc" + b"\x04\x02", 6) == b"abc"
    assert adc.unpack(b"\x82abc" + b"\x40\x00", 9) == b"abc" and adc.unpack(b"\x82ab", 9) == b""
    code = Code([2, 1, 2])
    assert [code.read(b) for b in [Bits(bytes([0b10011000]))] for _ in range(3)] == [0, 1, 2]
    with pytest.raises(Exception, match="many"):
        Code([1, 1, 1])


def lzw(data: bytes) -> bytes:
    """A plain writer of block-mode codes, for the reader above it."""
    words, bits, out, n, w = {bytes([c]): c for c in range(256)}, 9, 0, 0, b""
    size = 257
    for c in [data[i : i + 1] for i in range(len(data))]:
        if w + c in words:
            w += c
            continue
        out |= words[w] << n
        n += bits
        words[w + c], size = size, size + 1
        if size - 1 < 1 << 14 and size - 1 and (size - 1) & (size - 2) == 0 and size - 1 > 256:
            bits += 1
        w = c
    if w:
        out |= words[w] << n
        n += bits
    return out.to_bytes(-(-n // 8), "little")


@given(st.binary(max_size=300))
@settings(max_examples=40, deadline=None)
def test_lzw_short(data):
    assert stuffit.lzw(lzw(data), len(data)) == data


def lh5_literals(data: bytes) -> bytes:
    """One block of literals with codes of eight bits for all bytes."""
    bits = f"{len(data):016b}" + "00000" + f"{10:05b}" + f"{256:09b}" + "0000" + "0000"
    bits += "".join(f"{c:08b}" for c in data)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_lh5():
    data = bytes(range(200)) + b"hello"
    assert unlzh(lh5_literals(data), b"-lh5-", len(data)) == data
    raw = W.lha_stored([("a", lh5_literals(data))]).replace(b"-lh0-", b"-lh5-")
    fixed = bytearray(raw)
    fixed[11:15] = struct.pack("<I", len(data))
    rows = walk("x.lzh", bytes(fixed))
    assert rows[1].data == data and rows[1].meta.compression_method == "lh5"


def test_what_cannot_be_decoded_is_a_diagnostic():
    packed = W.rar4_stored(MEMBERS).replace(b"\x1d\x30", b"\x1d\x33")
    assert "RAR decompression error" in walk("x.rar", packed)[0].message  # its bytes are text, not codes
    assert walk("x.sit", b"StuffIt (c)1997" + b"\0" * 200)[0].code == "RootUnsupportedFormat"


@given(st.binary(max_size=700), st.sampled_from(["a", "a.zip", "a.dsk", "a.sit", "a.cpt", "a.ima", "a.lzh", "a.rar", "a.bin", "a/..namedfork/rsrc", "a.tar", "a.hqx"]))
@settings(max_examples=150, deadline=None)
def test_any_bytes_end_in_rows(data, name):
    for magic in (b"", b"PK\x03\x04", b"SIT!", b"Rar!\x1a\x07\x01\x00", b"PACK", b"IWAD", b"LB23", b"\x01\x01", b"\x00\x05\x16\x00", b"SOU \0\0\0\0VCTL", b"..-lh5-", b"LECF"):
        for e in Walk(Options()).root(name, magic + data):
            assert e.kind in ("root", "entry", "diag")


def test_detection_order_and_hints():
    assert detect("x/..namedfork/rsrc", None) == "ResourceFork"
    assert detect("x.zip", b"\x1f\x8b" + b"\0" * 20) == "Gzip"
    assert detect("x.txt", b"hello") is None
    old = bytearray(W.tar([("old", b"data")]))
    old[257:265] = b"\0" * 8
    total = sum(old[:148]) + 8 * 32 + sum(old[156:512])
    old[148:156] = f"{total:06o}\0 ".encode()
    assert detect("x.tar", bytes(old)) == "Tar" and detect("x", bytes(old)) is None


# RAR and LHA -----------------------------------------------------------------------------------------------------------


def mixed(seed: int, n: int = 12_000) -> bytes:
    """Text with repeats near and far, noise and runs."""
    r = random.Random(seed)
    words = [bytes(r.choices(b"abcdefgh ", k=r.randint(2, 9))) for _ in range(120)]
    text = b" ".join(r.choice(words) for _ in range(n // 6))
    return text + bytes(r.randrange(256) for _ in range(700)) + b"z" * 900 + text[: n // 3]


@pytest.mark.parametrize("seed", range(4))
def test_rar_coders(seed):
    data = mixed(seed)
    for per_block in (200, 100_000):
        assert rar.Rar5(1 << 20).unpack(W.rar5_packed(data, per_block=per_block), len(data), False) == data
        assert rar.Rar29().unpack(W.rar29_packed(data, per_block=per_block), len(data), False) == data


def test_rar_copies_from_afar():
    r = random.Random(1)
    noise = bytes(r.randrange(256) for _ in range(3000))
    data = noise + bytes(300_000) + noise + b"ab" * 50 + noise
    assert rar.Rar5(1 << 20).unpack(W.rar5_packed(data), len(data), False) == data
    assert rar.Rar29().unpack(W.rar29_packed(data), len(data), False) == data


@given(st.binary(max_size=400), st.integers(1, 40))
@settings(max_examples=40, deadline=None)
def test_rar_coders_on_anything(data, times):
    data = data * times
    assert rar.Rar5(1 << 20).unpack(W.rar5_packed(data, per_block=50), len(data), False) == data
    if data:
        assert rar.Rar29().unpack(W.rar29_packed(data, per_block=50), len(data), False) == data


def test_rar_archives():
    one, two = mixed(1), mixed(2)
    members = [("b/two.bin", two), ("a.txt", one)]
    for raw in (
        W.rar5([(k, v, W.rar5_packed(v)) for k, v in members]),
        W.rar29([(k, v, W.rar29_packed(v)) for k, v in members]),
        W.rar5([("b/two.bin", two, W.rar5_packed(two)), ("a.txt", one, W.rar5_packed(two + one, len(two)))], solid=True),
        W.rar29([("b/two.bin", two, W.rar29_packed(two)), ("a.txt", one, W.rar29_packed(two + one, len(two)))], solid=True),
    ):
        events = [e for e in walk("x.rar", raw) if e.kind == "entry"]
        assert {e.path: e.data for e in events} == {f"x.rar/{k}": v for k, v in members}
        assert {e.meta.compression_method for e in events} == {"normal"}
    cut = W.rar5([("a", one, W.rar5_packed(one)[:-200])])
    assert walk("x.rar", cut)[0].code == "RootTraversalFailed" and "a" in walk("x.rar", cut)[0].message
    ppm = W.rar29([("a", one, b"\x80" * 50)])
    assert "PPMd" in walk("x.rar", ppm)[0].message


@pytest.mark.parametrize("order", [2, 4, 6, 16])
def test_rar_prediction(order):
    data = mixed(order, 3000) + b"\2" * 9 + bytes(range(256))
    packed = W.ppmd_packed(data, order)
    assert rar.Rar29().unpack(packed, len(data), False) == data and len(packed) < len(data) // 2
    events = [e for e in walk("x.rar", W.rar29([("a", data, packed)])) if e.kind == "entry"]
    assert [e.data for e in events] == [data]
    # a model that isn't the writer's shows by the checksum
    raw = bytearray(W.rar29([("a", data, packed)]))
    raw[20 + 16] ^= 1
    assert "checksum" in walk("x.rar", bytes(raw))[0].message


@given(st.binary(max_size=300), st.integers(1, 12))
@settings(max_examples=30, deadline=None)
def test_rar_prediction_of_anything(data, times):
    data = data * times or b"x"
    assert rar.Rar29().unpack(W.ppmd_packed(data, 5), len(data), False) == data


def test_rar_models_that_fill_their_memory(monkeypatch):
    r = random.Random(1)
    noise = bytes(r.randrange(256) for _ in range(9000))
    W.ppmd_packed(noise, 16, 1)
    monkeypatch.setattr(ppmd, "FULL", 0.05)
    with pytest.raises(ContainerError, match="memory"):
        W.ppmd_packed(noise, 16, 1)


def test_rar5_filters():
    """Each filter undoes what the writer does by its definition."""
    r = random.Random(3)
    code = bytearray(mixed(5, 4000))
    for _ in range(200):
        at = r.randrange(len(code) - 8)
        code[at] = r.choice(b"\xe8\xe9")
        code[at + 1 : at + 5] = struct.pack("<i", r.randrange(-len(code), len(code)))
    code = bytes(code)

    def absolute(d: bytes, marks: bytes) -> bytes:
        out, at = bytearray(d), 0
        while at + 4 < len(out):
            at += 1
            if out[at - 1] in marks:
                target = int.from_bytes(out[at : at + 4], "little", signed=True)
                if -at <= target < (1 << 24) - at:
                    out[at : at + 4] = struct.pack("<i", target + at)
                elif (1 << 24) - at <= target < 1 << 24:
                    out[at : at + 4] = struct.pack("<i", target - (1 << 24))
                at += 4
        return bytes(out)

    for kind, marks in ((1, b"\xe8"), (2, b"\xe8\xe9")):
        p = W.rar5_packed(absolute(code, marks), filters=[(0, len(code), kind, 0)])
        assert rar.Rar5(1 << 20).unpack(p, len(code), False) == code
    for channels in (1, 3, 32):
        parts = [code[c::channels] for c in range(channels)]
        apart = b"".join(bytes((a - b) & 255 for a, b in zip(b"\0" + x[:-1], x, strict=True)) for x in parts if x)
        p = W.rar5_packed(apart, filters=[(0, len(code), 0, channels)])
        assert rar.Rar5(1 << 20).unpack(p, len(code), False) == code
    branch = b"".join(struct.pack("<I", 0xEB000000 | (i * 77 & 0xFFFFFF) if i % 3 else i) for i in range(500))
    far = b"".join(struct.pack("<I", 0xEB000000 | ((i * 77) + i & 0xFFFFFF) if i % 3 else i) for i in range(500))
    assert rar.Rar5(1 << 20).unpack(W.rar5_packed(far, filters=[(0, 2000, 3, 0)]), 2000, False) == branch
    with pytest.raises(ContainerError):
        rar.Rar5(1 << 20).unpack(W.rar5_packed(far, filters=[(0, 2001, 3, 0)]), 2000, False)


def test_rar29_filters(monkeypatch):
    """The six programs are known by their checksums; here stand-ins of the writer's own have those."""
    data = bytes(range(256)) * 12
    names = {b"prog-%d" % i: n for i, n in enumerate(("delta", "sound", "picture", "itanium", "e8"))}
    monkeypatch.setattr(rar, "PROGRAMS", {(len(k), zlib.crc32(k)): n for k, n in names.items()})

    def declared(code: bytes, registers: dict[int, int]) -> bytes:
        b = W.BitsOut()
        for v in (0, 0, len(data)):  # a new list of programs, from the start, that many bytes
            b.put(2, 2)
            b.put(v, 16)
        b.put(sum(1 << i for i in registers), 7)
        for v in [*registers.values(), len(code)]:
            b.put(2, 2)
            b.put(v, 16)
        for c in code:
            b.put(c, 8)
        raw = b.bytes()
        return bytes([0x80 | 0x20 | 0x10 | 7]) + struct.pack(">H", len(raw)) + raw

    def unpacked(name: str, raw: bytes, registers: dict[int, int]) -> bytes:
        code = next(k for k, n in names.items() if n == name)
        return rar.Rar29().unpack(W.rar29_packed(raw, program=declared(code, registers)), len(raw), False)

    parts = [data[c::4] for c in range(4)]
    apart = b"".join(bytes((a - b) & 255 for a, b in zip(b"\0" + x[:-1], x, strict=True)) for x in parts)
    assert unpacked("delta", apart, {0: 4}) == data
    # a steady channel is predicted without errors once its weights are known, whatever they are at first
    assert unpacked("sound", bytes(len(data)), {0: 2}) == bytes(len(data))
    assert unpacked("picture", bytes(len(data)), {0: 30, 1: 0}) == bytes(len(data))
    assert unpacked("e8", data, {}) == bytes(rar.jumps(bytearray(data), 0, b"\xe8"))
    assert unpacked("itanium", bytes(len(data)), {}) == bytes(len(data))


def picture_apart(out: bytes, width: int, red: int) -> bytes:
    """The inverse of the picture filter, from its definition."""
    plain = bytearray(out)
    for at in range(red, len(out) - 2, 3):
        plain[at], plain[at + 2] = (out[at] - out[at + 1]) & 255, (out[at + 2] - out[at + 1]) & 255
    rows = []
    for c in range(3):
        for at in range(c, len(out), 3):
            left = plain[at - 3] if at >= 3 else 0
            guess = left
            if at >= width:
                up, corner = plain[at - width + 3], plain[at - width]
                slope = left + up - corner
                a, b, d = abs(slope - left), abs(slope - up), abs(slope - corner)
                guess = left if a <= b and a <= d else up if b <= d else corner
            rows.append((guess - plain[at]) & 255)
    return bytes(rows)


def test_rar_picture_filter():
    r = random.Random(4)
    for width, red in ((30, 0), (60, 3), (6, 1)):
        data = bytes(r.randrange(256) for _ in range(900))
        assert rar.picture(bytearray(picture_apart(data, width, red)), width, red) == data


def test_rar_itanium_filter():
    bundle = 0x12 | 5 << (5 + 37 + 82) | 100 << (5 + 13 + 82)
    data = (bundle.to_bytes(16, "little")) * 4 + bytes(32)
    out = rar.itanium(bytearray(data), 16)
    targets = [int.from_bytes(out[i : i + 16], "little") >> (5 + 13 + 82) & 0xFFFFF for i in range(0, 64, 16)]
    assert targets == [99, 98, 97, 96]


@pytest.mark.parametrize("method", [b"-lh1-", b"-lzs-", b"-lz5-"])
def test_lha_older_methods(method):
    pack = {b"-lh1-": W.lh1, b"-lzs-": W.lzs, b"-lz5-": W.lz5}[method]
    members = [("a.txt", mixed(6)), ("b", b""), ("c", b"x" * 5000)]
    events = [e for e in walk("x.lzh", W.lha([(k, v, pack(v)) for k, v in members], method)) if e.kind == "entry"]
    assert {e.path: e.data for e in events} == {f"x.lzh/{k}": v for k, v in members}
    assert {e.meta.compression_method for e in events} == {method.decode().strip("-")}
    assert walk("x.lzh", W.lha([("a", mixed(9), pack(mixed(9))[:500])], method))[0].kind == "diag"


def test_lh1_weights_are_halved():
    data = mixed(7, 90_000)
    assert unlzh(W.lh1(data), b"-lh1-", len(data)) == data


def test_zip_with_xz():
    """An entry of method 95, which Python's module can't write: its XZ stream in the place of a stored entry's bytes."""
    data = mixed(8)
    packed = lzma.compress(data)
    raw = bytearray(W.zip_([("a.txt", packed)], zipfile.ZIP_STORED))
    for at, shift in ((0, 0), (raw.index(b"PK\x01\x02"), 2)):
        struct.pack_into("<H", raw, at + 8 + shift, 95)
        struct.pack_into("<I", raw, at + 14 + shift, zlib.crc32(data))
        struct.pack_into("<I", raw, at + 22 + shift, len(data))
    events = walk("x.zip", bytes(raw))
    assert {e.path: e.data for e in events if e.kind == "entry"} == {"x.zip/a.txt": data} and events[1].meta.compression_method == "compressed"
    raw[60] ^= 255
    assert walk("x.zip", bytes(raw))[0].kind == "diag"


@pytest.mark.parametrize(("method", "name"), [(1, "rle"), (2, "lzw"), (3, "huffman"), (5, "lzah")])
def test_stuffit_coders(method, name):
    pack = {1: W.rle90, 2: W.lzw, 3: W.huffman_tree, 5: W.lh1}[method]
    members = [(b"a", mixed(1)), (b"b", b"\x90" * 40 + b"q"), (b"c", b"x")]
    raw = W.stuffit([(k, v, pack(v)) for k, v in members], method)
    events = [e for e in walk("x.sit", raw) if e.kind == "entry"]
    assert {e.path: e.data for e in events} == {f"x.sit/{k.decode()}": v for k, v in members}
    assert {e.meta.compression_method for e in events} == {name}


def test_checksums():
    assert stuffit.crc16(b"123456789") == W.crc16_arc(b"123456789") == 0xBB3D and mac.crc16(b"123456789") == 0x31C3
    raw = bytearray(W.stuffit([(b"a", mixed(1), W.lh1(mixed(1)))], 5))
    raw[22 + 102] ^= 1
    assert not found("x.sit", bytes(raw))


@pytest.mark.parametrize("size", [0, 1, 5, 900, 30_000])
def test_compactpro_coders(size):
    data = (mixed(2) + b"\x81\x82" * 9 + b"\x81" * 9)[:size]
    assert compactpro.runs(W.runs81(data), len(data)) == data
    if data:
        assert compactpro.lzh(W.lzh_blocks(W.runs81(data)), len(data)) == data
    assert adc.unpack(W.adc(data), len(data)) == data
    for levels in range(3):
        assert imuse.block(levels + 1, W.imuse(W.differences(data[:8192], levels))) == data[:8192]


def test_images_of_every_kind():
    disk = W.hfs(MEMBERS)
    for name, raw in (("d.dmg", W.udif(disk, 1)), ("d.dmg", W.udif(disk, 0x80000004)), ("d.dmg", W.udif(disk, 0x80000005)), ("d.image", W.diskcopy(disk)), ("d.toast", W.partition_map(disk)), ("d.iso", W.raw_cd(disk))):
        assert found(name, raw) == {f"{name}/F/{k}": v for k, v in MEMBERS}
    assert found("d.dsk", W.mfs(MEMBERS)) == {f"d.dsk/{k}": v for k, v in MEMBERS}
    for packed in (False, True):
        body, fork = W.ndif(disk, packed)
        rows = {e.path: e.data for e in Walk(Options()).root("n.img", body, fork) if e.kind == "entry"}
        assert all(rows[f"n.img/F/{k}"] == v for k, v in MEMBERS)


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def test_two_bytes_by_chance_are_no_volume():
    """a plain file whose bytes 1,024 and 1,025 are a volume's magic; what follows doesn't fit a volume."""
    for magic in (b"BD", b"\xd2\xd7"):
        for data in (noise(1024) + magic + noise(3000, 2), b"plain " + b"x" * 1018 + magic + b"text that goes on " * 90, noise(1024) + magic):
            assert detect("a.zip", data) is None
            events = walk("a.zip", data)
            assert [(e.kind, e.code) for e in events] == [("diag", "RootUnsupportedFormat")]
    assert detect("d", W.hfs(MEMBERS)) == detect("d", W.mfs(MEMBERS)) == "Hfs"


def test_packed_blocks_that_look_like_a_flat_volume():
    """F8: an image's packed bytes hold a flat volume's magic where such a volume has it."""
    disk = bytearray(W.hfs(MEMBERS))
    disk[:1024] = noise(1024)
    disk[0x52:0x54] = b"ab"
    disk[1016:1018] = b"\xd2\xd7"  # behind eight control bytes
    image = W.udif(bytes(disk), 0x80000004)
    assert image[1024:1026] == b"\xd2\xd7"
    assert found("d.dmg", image) == {f"d.dmg/F/{k}": v for k, v in MEMBERS}
    assert found("d.dmg", W.udif(W.mfs(MEMBERS), 0x80000005)) == {f"d.dmg/{k}": v for k, v in MEMBERS}


def test_tables_of_short_codes_are_short():
    """A table holds the strings of the longest code, not of the longest possible one."""
    assert len(rar.Prefix([1, 2, 2]).table) == 4 and len(Code([1, 2, 2]).table) == 4
    for bad in ([1, 1, 1], [0, 1, 2, 2, 3]):
        for make in (rar.Prefix, Code):
            with pytest.raises(ContainerError):
                make(bad)


def test_delta_in_slices():
    """F16: channels as slices give what bytes one by one give, also where there are more channels than bytes."""
    for n, channels in ((0, 3), (1, 4), (7, 3), (500, 31), (64, 1)):
        data, k, want = noise(n, n + channels), 0, bytearray(n)
        for c in range(channels):
            last = 0
            for at in range(c, n, channels):
                last = last - data[k] & 0xFF
                want[at] = last
                k += 1
        assert rar.delta(bytearray(data), channels) == want


def test_adaptive_tree_searches_equal_weights():
    """the last node of a weight is searched for by halves, not passed over node by node."""
    from burrow.codecs.lzh import Adaptive

    class Counted(list):
        reads = 0

        def __getitem__(self, k):
            Counted.reads += 1
            return super().__getitem__(k)

    tree = Adaptive(314)
    tree.weight = Counted(tree.weight)
    tree.grow(0)
    assert Counted.reads < 150 and sorted(tree.weight) == list(tree.weight)


def test_copies_that_overlap():
    """parts of the output are copied as a whole, also where they run into themselves."""
    from burrow.codecs.lzh import copy

    for n, back in ((3, 7), (9, 1), (10, 3), (4, 4), (0, 2)):
        out, want = bytearray(b"abcdefg"), bytearray(b"abcdefg")
        copy(out, n, back)
        for _ in range(n):
            want.append(want[-back])
        assert out == want


def test_wide_contexts_know_their_sums():
    """contexts of many symbols keep their frequencies' sum and their symbols up, through rescaling too."""
    data = b"".join(bytes([c % 251, c * 7 % 256, 65 + c % 9]) for c in range(4000)) + b"a" * 900 + noise(3000)

    class Told(ppmd.Model):
        def place(self, states, scale, skip=False):
            self.coder.range //= scale
            at = 0
            for s in states:
                if not (skip and self.masked[s[0]] == self.escapes):
                    if s[0] == self.want:
                        return at
                    at += s[1]
            return at

    model = Told(W.RangeOut(), 4, 1 << 24)
    root = model.least
    for c in data:
        model.want = c
        model.symbol()
    assert root.sum == sum(s[1] for s in root.states) and set(root.by) == {s[0] for s in root.states}
    assert all(root.by[s[0]] is s for s in root.states)


def test_prediction_in_the_helper(monkeypatch):
    """the helper's model gives the same bytes and errors as Python's, which isn't asked where there is Java."""
    from burrow.codecs import beside

    def noted(f):
        try:
            return bytes(f())
        except ContainerError as e:
            return str(e)

    def results() -> list:
        out, r = [], random.Random(7)
        for data, order in ((mixed(3, 4000), 5), (noise(1500), 16), (bytes(range(256)) * 8, 3), (b"\2" * 300, 2), (b"ab" * 2000, 7), (b"\0", 4)):
            packed = W.ppmd_packed(data, order)
            assert rar.Rar29().unpack(packed, len(data), False) == data
            out.append(packed)
            for _ in range(8):
                damaged = bytearray(packed[: r.randrange(len(packed)) if r.random() < 0.4 else None])
                if len(damaged) > 2:
                    damaged[r.randrange(2, len(damaged))] = r.randrange(256)
                out.append(noted(lambda d=damaged, n=len(data): rar.Rar29().unpack(bytes(d), n, False)))
            # an entry that ends within a block: the next one's bytes go on with its model and its coder
            half = len(data) // 2
            if half:
                s, model = rar.Stream(packed), ppmd.reader(order, 1 << 20)
                s.at = 16
                model.start(s)
                for _ in range(half + data[:half].count(2)):
                    model.symbol()
                solid = rar.Rar29()
                assert solid.unpack(packed[: s.at // 8], half, False) + solid.unpack(packed[s.at // 8 :], len(data) - half, True) == data
        return out

    if beside.helper() is None:
        pytest.skip("no Java compiler here")
    with monkeypatch.context() as m:
        m.setattr(ppmd.Model, "symbol", None)
        far = results()
    monkeypatch.setattr(beside, "helper", lambda: None)
    assert results() == far and any(isinstance(x, str) for x in far)
