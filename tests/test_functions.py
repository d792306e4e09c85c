"""Column expressions against truth tables, and against the plain functions that run inside tasks."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from burrow.functions import columns as C
from burrow.functions import paths as P
from burrow.operators import sinks as S

PATHS = ["a/b/c.txt", "c.tar.gz", ".bashrc", "x.", "Makefile", ".x.y", "a/", "", "a\\b.c", "..", "a/../b", "a:b", ":x:..:y", "/lead", "._x", "d/._x", "__MACOSX/d/._x", "._", "a\x01b", "b\x7fc", "é/ü.Ö", "..namedfork/rsrc", "it's"]


def values(spark, column, cells, name="p"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, {name} string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("column", "plain"),
    [
        (lambda: C.clean_component("p"), P.clean_component),
        (lambda: C.clean_archive_path("p"), P.clean_archive_path),
        (lambda: C.clean_hfs_path("p"), P.clean_hfs_path),
        (lambda: C.last_component("p"), P.last_component),
        (lambda: C.file_stem("p"), P.stem),
        (lambda: C.probe_extension("p"), P.probe_extension),
        (lambda: C.is_sidecar("p"), P.is_sidecar),
        (lambda: C.companion("p"), P.companion),
        (lambda: C.sidecar("p"), lambda p: P.sidecars(p)[0]),
        (lambda: C.matches_prefix("p", "a/b"), lambda p: P.matches_prefix(p, "a/b")),
    ],
)
def test_same_as_in_tasks(spark, column, plain):
    assert values(spark, column(), PATHS) == [plain(p) for p in PATHS]


@given(st.lists(st.text(st.sampled_from("ab._:/\\\x00\x1f\x80é"), max_size=12), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_cleaning_agrees(spark, cells):
    assert values(spark, C.clean_archive_path("p"), cells) == [P.clean_archive_path(c) for c in cells]
    assert values(spark, C.clean_hfs_path("p"), cells) == [P.clean_hfs_path(c) for c in cells]


def test_names_and_extensions(spark):
    assert values(spark, C.extension("p"), ["a.b", ".bashrc", "x.", "Makefile", ".x.y", "d.e/f", "A.TXT"]) == ["b", None, None, None, "y", None, "TXT"]
    assert values(spark, C.name("p"), ["a/b", "a/", "x"]) == ["b", "", "x"]


def test_formats_by_extension(spark):
    assert values(spark, C.format_of_extension("p"), ["ZIP", "gz", "tgz", "toast", "wl6", "", None]) == ["Zip", "Gzip", None, "Hfs", "Wolf3d", None, None]


def test_prefix_rule():
    assert P.matches_prefix("a/file", "a/file") and P.matches_prefix("a/file/x", "a/file") and P.matches_prefix("a", "a/file")
    assert not P.matches_prefix("a/file.mod", "a/file") and not P.matches_prefix("a/sub", "a/subdirectory")


def test_relative_paths(spark):
    df = spark.createDataFrame([("r.zip/a/b", "r.zip"), ("r.zip//a", "r.zip"), ("x/y", "z"), ("r", "r"), ("r.zipped", "r.zip")], "path string, container_path string")
    rows = df.select(C.relative_path().alias("a"), C.relative_path_one().alias("b")).collect()
    assert [tuple(r) for r in rows] == [("a/b", "a/b"), ("a", "/a"), ("x/y", "x/y"), ("", ""), ("ped", "ped")]


META = "metadata struct<compression_method: string, compression_level: string, mode: string, type_code: binary, creator_code: binary>"
CASES = [
    (("lzah", "5", "-rwxr-xr-x", b"APPL", b"MOSS"), "APPL/MOSS, lzah:5, -rwxr-xr-x", "Metadata(APPL/MOSS, lzah:5, -rwxr-xr-x)"),
    ((None, "9", None, None, None), "level:9", "Metadata()"),
    (("deflate", None, None, None, None), "deflate", "Metadata(deflate)"),
    ((None, None, None, b"\x00\x01\x02\x03", b"MOSS"), "0x00010203/MOSS", "Metadata(0x00010203/MOSS)"),
    ((None, None, None, None, b"MOSS"), "/MOSS", "Metadata()"),
    ((None, None, "drwxr-xr-x", b"TEXT", None), "TEXT, drwxr-xr-x", "Metadata(TEXT, drwxr-xr-x)"),
    ((None, None, None, None, None), "", "Metadata()"),
]


def test_metadata_text(spark):
    names = ("compression_method", "compression_level", "mode", "type_code", "creator_code")
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], f"i int, {META}")
    rows = df.select("i", C.metadata_display().alias("d"), C.metadata_repr().alias("r"), C.metadata_is_empty().alias("e"), C.is_directory(F.lit("x")).alias("dir")).orderBy("i").collect()
    assert [(r["d"], r["r"]) for r in rows] == [(c[1], c[2]) for c in CASES]
    assert [r["e"] for r in rows] == [False] * 6 + [True] and rows[5]["dir"]
    assert [S.meta_text(Row(*names)(*c[0])) for c in CASES] == [c[1] for c in CASES]


def test_modes(spark):
    texts = ["-rwxr-xr-x", "-rwsr-xr-x", "-rwxr-sr-x", "-rwxr-xr-t", "-rwSr-----", "short", "drw-r--r-T"]
    assert values(spark, C.mode_bits("p"), texts) == [0o755, 0o4755, 0o2755, 0o1755, 0o4640, None, 0o1644]
    from burrow.formats.common import mode_text

    df = spark.range(0, 1 << 16, 37)
    assert all(r["t"] == mode_text(r["id"]) for r in df.select("id", C.mode_text("id").alias("t")).collect())


def test_flags_sizes_and_quotes(spark):
    row = spark.range(1).select(C.finder_bits(invisible=F.lit(True), locked=F.lit(True)).alias("f"), C.permissions(F.lit(0o4755)).alias("p")).first()
    assert row["f"] == 0x5000 and row["p"] == 0o755
    sizes = [0, 1023, 1024, 464_128, 1 << 20, 3 << 30]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[0] for r in df.select(C.format_size("n")).collect()] == ["0 B", "1023 B", "1.0 KiB", "453.2 KiB", "1.0 MiB", "3.0 GiB"] == [S.size_text(n) for n in sizes]
    assert values(spark, C.shell_quoted("p"), ["", "a'b", "$(x)`y`\n"]) == ["''", "'a'\"'\"'b'", "'$(x)`y`\n'"]
    assert values(spark, C.tsv_escaped("p"), ["a\tb\nc"]) == ["a\\tb\\nc"]
    assert values(spark, C.stripped("p", 1), ["a/b/c", "a"]) == ["b/c", None]


def test_output_paths(spark):
    cells = ["a/../b", "/abs", "C:\\x", "//server/x", "a\\..\\b", "./a/./b", "", "a\\b"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, p string")
    got = [(r["t"]["path"], r["t"]["reason"] is None) for r in df.select("i", S.safe_output("p").alias("t")).orderBy("i").collect()]
    assert got == [(None, False)] * 5 + [("a/b", True), (None, False), ("a/b", True)]


def test_mac_roman():
    assert P.mac_roman(b"caf\x8e \xd2x\xd3 \xdb") == 'café "x" €'
    assert P.os_type(b"TEXT") == "TEXT" and P.os_type(b"\0\1\2\3") == "0x00010203"
